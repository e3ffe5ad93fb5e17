"""Every registered query against its SQL counterpart or a brute-force version."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

from wardline.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id", ignore_index=True)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equal_to_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def simple_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simple_components(ids, fps):
    top = list(range(len(ids)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(ids))]


def test_simhash(spark, sf_dir, documents):
    got = QUERIES["op3_simhash"](spark, sf_dir).toPandas().sort_values("doc_id", ignore_index=True)
    fps = [simple_fingerprint(t) for t in documents.text]
    assert got.doc_id.tolist() == documents.doc_id.tolist()
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == simple_components(documents.doc_id.tolist(), fps)
    assert got.component_id.nunique() < len(got)


def test_token_files(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in documents.text]
    got = QUERIES["op5_token_files"](spark, sf_dir).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.doc_id.tolist() == documents.doc_id.tolist()
    assert got.n_tokens.tolist() == [len(i) for i in ids]
    assert got.start.tolist() == [0, *np.cumsum([len(i) for i in ids])[:-1].tolist()]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]


def test_byte_bpe(spark, sf_dir, documents):
    import tiktoken

    from wardline.llm.byte_bpe import load_ranks

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = QUERIES["op6_byte_bpe"](spark, sf_dir).toPandas().sort_values("doc_id", ignore_index=True)
    ids = [own.encode_ordinary(t) for t in documents.text]
    assert got.n_tokens.tolist() == [len(i) for i in ids]
    assert got.ids_sha256.tolist() == [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert got.decoded_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in documents.text]


def simple_secrets(text):
    """kind, start and end of the contract's three patterns, found by plain scans of the whole text."""
    import re
    kinds = {"assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": 12, "access": 18, "hex": 16}
    found = [(m.start(), list(kinds).index(k), k, m.end()) for k, p in kinds.items() for m in re.finditer(p, text)
             if len(m[2] if k == "assign" else m[0]) >= least[k]]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def check_secrets(got, texts):
    for row, text in zip(got, texts, strict=True):
        want = simple_secrets(text or "")
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (set(joined.split(",")) - {""}) <= set(row.spans.split(","))


def test_secrets(spark, sf_dir, documents):
    got = QUERIES["op7_secrets"](spark, sf_dir).orderBy("doc_id").collect()
    check_secrets(got, documents.text)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 5


def test_secrets_of_odd_texts(spark):
    import random

    from wardline.llm.secret_scan import scan_secrets
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "ApI_KeY", '"', "'", " ", "  ", ":", "=", ":=", "AKIA", "AKIAAKIA", "ABCDEF0123",
             "0123456789abcdef", "deadbeef", "x", "é", "\n", "secret_token=", "abcdefghijkl", "A1b2C3d4E5f6", "K", "ſecret", "-", "."]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_secrets(scan_secrets(docs).orderBy("doc_id").collect(), texts)


def simple_line_dedup(rows):
    """rows: (doc_id, text) by doc_id. Later occurrences of three lines go."""
    met, out = {}, []
    for doc_id, text in rows:
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i:i + 3])
            if any(line.strip(" ") for line in window) and met.setdefault(window, (doc_id, i)) != (doc_id, i):
                gone |= {i, i + 1, i + 2}
        out.append((doc_id, "\n".join(line for i, line in enumerate(lines) if i not in gone)))
    return out


def simple_words(text):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_pipeline(spark, sf_dir, documents):
    """run() against plain Python, the trained model aside: its verdicts are taken from the operator."""
    import tiktoken

    import corpus_pipeline
    from wardline.llm.byte_bpe import load_ranks
    from wardline.llm.tables import table

    good = {r.doc_id for r in corpus_pipeline.keep_good_text(spark, table(spark, sf_dir, "documents"), sf_dir).collect()}
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    assert labels[labels.quality == 1].doc_id.isin(good).mean() > 0.95 and labels[labels.quality == 0].doc_id.isin(good).mean() < 0.3
    rows = simple_line_dedup([(i, t) for i, t in zip(documents.doc_id, documents.text, strict=True) if i in good])
    ids = [r[0] for r in rows]
    rows = [r for r, c in zip(rows, simple_components(ids, [simple_fingerprint(r[1]) for r in rows]), strict=True) if c == r[0]]
    windows = set()
    for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text:
        w = simple_words(t)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(w) for w in windows}
    rows = [(i, t) for i, t in rows for w in [simple_words(t)]
            if not any(tuple(w[p:p + n]) in windows for n in sizes for p in range(len(w) - n + 1))]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: (own.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert 0 < len(got) < len(documents)

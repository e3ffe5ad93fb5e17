"""Alignment against a token-by-token version with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from wardline.llm import alignment
from wardline.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[2])


def simple(rows, libraries):
    a, b = libraries
    shown = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 173 or 174 <= c]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, spelt):
        out, at = [], 0
        for i, s in zip(ids, spelt, strict=True):
            out.append((i, at, at + len(s)))
            at += len(s)
        return out

    docs, holders = [], Counter()
    for doc, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            sa, sb = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia], [bytes_b(i) for i in ib]
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                ta, tb, n = spans(ia, sa), spans(ib, sb), (len(ia), len(ib))
                j = 0
                for i, x, y in ta:
                    while tb[j][2] <= x:
                        j += 1
                    k = j
                    while k < len(tb) and tb[k][1] < y:
                        links.append((i, tb[k][0]))
                        k += 1
                cuts = [0, *sorted({t[2] for t in ta} & {t[2] for t in tb})]
                groups = [[[str(t[0]) for t in side if x <= t[1] < y] for side in (ta, tb)] for x, y in zip(cuts, cuts[1:], strict=False)] if len(ta) < 3000 else None
        holders.update(set(links))
        docs.append((doc, n, links, groups))
    best = defaultdict(int)
    for (i, _), c in holders.items():
        best[i] = max(best[i], c)
    out = []
    for doc, n, links, groups in docs:
        text = ";".join("|".join(map(",".join, g)) for g in groups or [])
        out.append((doc, *n, len(groups) if groups is not None else None, len(links), sum(holders[p] == best[p[0]] for p in links),
                    sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "" if groups is not None else None))
    return out


def equal(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:6])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert [x for x, y in zip(g, w, strict=True) if y is not None] == [y for y in w if y is not None] or (g[0] is None and tuple(g) == w), (g, w)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark, sf_dir, libraries):
    import pandas as pd
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op13_alignment"](spark, sf_dir).select(*NAMES).collect()
    equal([tuple(r) for r in got], simple(list(zip(docs.doc_id, docs.text, strict=True)), libraries))


def test_odd_texts_and_small_blocks(spark, libraries, monkeypatch):
    rng = random.Random(4)
    letters = [*" \n\tabcZé1,.'’日𝄞 \x1c\u0085　s\0", "<|endoftext|>", "<s>", "<0x41>", "  ", " the", "ſ"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no id here"), (1002, "same"), (1002, "same"), (1003, "a▁b stays out"),
             (1004, "word ünïcödé " * 3000), (1005, "x" * 700), (1006, "日本語" * 400)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, block string, total int, place int")
    got = alignment.align_tokenizers(docs.repartition(5), *PATHS, with_groups=True).collect()
    equal([tuple(r[n] for n in NAMES) for r in got], simple(rows, libraries))
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1003].n_a == by[1000].n_links == by[1001].count_sum == 0 and by[1003].groups_sha256 == ""
    assert alignment.align_tokenizers(docs.where("false"), *PATHS).count() == 0


def test_coalescing():
    import numpy as np
    starts, ends, side = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 7, 3, 5, 7]), np.array([0, 0, 0, 1, 1, 1])
    order, group = alignment.coalesce(starts, ends, side)
    assert order.tolist() == [0, 3, 1, 4, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]
    assert alignment.coalesce(starts[:0], ends[:0], side[:0])[1].tolist() in ([], [0])

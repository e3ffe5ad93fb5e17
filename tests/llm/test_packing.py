"""Packing against the tokenizers library and against lower bounds, odd texts and tables included."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import packing
from wardline.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATHS[0])


def simple_pieces(ids, size):
    first = len(ids) % size or size
    cuts = [0, *range(first, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
    return [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def check_sequences(rows, size):
    """No sequence is too long, and its pieces follow each other without gap."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def test_query_equals_the_library(spark, sf_dir, library):
    import pandas as pd
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op12_packing"](spark, sf_dir).collect()
    want = {(d, *p) for d, t in zip(docs.doc_id, docs.text, strict=True)
            for p in simple_pieces([*library.encode(t or "", add_special_tokens=False).ids, 2], 1024)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check_sequences(rows, 1024)
    least = -(-sum(r.length for r in rows) // 1024)
    assert least <= n <= 1.02 * least + 1


ROWS = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "word " * 5000), (5, " \n\t\n  x"), (6, "a<|endoftext|>b"),
        (7, "é ü 日本語 𝄞  don't"), (8, "x" * 300)]


def test_odd_rows_clashing_names_and_ids(spark, library):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], "doc_id long, text string, length int, sequence_id int, ids int")
    packed = packing.pack_documents(docs, *PATHS, 2, size=64, with_ids=True)
    rows = packed.collect()
    encoded = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in ROWS]
    want = sorted(str((d, *p)) for d, ids in encoded for p in simple_pieces(ids, 64))
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    check_sequences(rows, 64)
    whole = packing.sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(len(i) for _, i in encoded) and all(len(r.ids) == r.length <= 64 for r in whole)
    assert packing.pack_documents(docs.where("false"), *PATHS, 2).count() == 0


def test_one_length_over_many_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")).repartition(7)
    rows = packing.pack_documents(docs, *PATHS, 2, size=10).collect()
    assert check_sequences(rows, 10) == 1000 and len(rows) == 3000


def test_plan_uses_the_histogram_up_and_is_near_the_bound():
    rng = np.random.default_rng(5)
    for size, many in ((1024, 300_000), (1024, 800), (100, 5000), (7, 30), (1, 4)):
        for low, high in ((1, size), (size // 2 + 1, size), (1, max(size // 8, 1))):
            stock = np.bincount(rng.integers(low, max(high, low) + 1, many).clip(1, size), minlength=size + 1)
            plan, used = packing.plan_of(stock, size), np.zeros(size + 1, np.int64)
            for pattern, times in plan:
                assert sum(pattern) <= size and times > 0
                np.add.at(used, list(pattern), times)
            assert (used == stock).all()
            n, greedy = sum(t for _, t in plan), sum(t for _, t in packing.best_fit(stock.copy(), size))
            least = max(-(-int(stock @ np.arange(size + 1)) // size), int(stock[size // 2 + 1:].sum()))
            assert least <= n <= 1.003 * greedy + 2 and n <= 1.03 * least + 2


def test_fit_is_the_least_squares():
    """On patterns with one solution, and against clipped coordinate descent."""
    rng = np.random.default_rng(2)
    patterns = packing.patterns_of(np.arange(1, 24), 24)
    stock = rng.integers(0, 500, 25).astype(float)
    stock[[0, 24]] = 0
    m = np.zeros((25, len(patterns)))
    for j, p in enumerate(patterns):
        np.add.at(m[:, j], p[p > 0], 1)
    x = np.zeros(len(patterns))
    for _ in range(3000):
        for j in range(len(x)):
            x[j] = max(0, x[j] + m[:, j] @ (stock - m @ x) / (m[:, j] @ m[:, j]))
    found = packing.fit_counts(patterns, stock, np.ones(25))
    assert (found >= 0).all() and np.linalg.norm(m @ found - stock) <= 1.02 * np.linalg.norm(m @ x - stock) + 1e-6


def test_segments_against_the_library(library):
    rng = random.Random(1)
    letters = [*" \n\tabcZé1,.'’日𝄞 \x1c\u0085　s", "<|endoftext|>", "  ", " the", "▁", "ſ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids, counts = packing.Coder(*PATHS).encode(pa.array(texts), 2)
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]

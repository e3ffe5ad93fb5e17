"""Packing documents into sequences of bounded length by patterns of a few lengths.

A document is its token ids and an end id. One longer than a sequence is cut: all its pieces but the first are full.
The histogram of piece lengths, at most one number per length, is fitted by non-negative least squares: the unknowns
are how often each pattern of two or three lengths that fills a sequence is used. The counts are rounded within
what the histogram still has, and the residual is packed by best fit, longest first, whole runs of equal lengths at
once. The plan is a list of patterns with counts, bounded by the sequence length and not by the data.

Pieces get their places without meeting: each task that encodes numbers its pieces of each length, the numbers of
earlier tasks are added up per length, and the rank of a piece among all of its length says which run of which pattern
holds it. So a length that a third of all pieces share is one of many rows like any other.

Null text is empty: one piece, the end id. Rows that share an id, and rows with a null id, are separate documents
(``row`` tells them apart). Only the named columns are read, so extra columns of any name change nothing. An empty
table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.ragged import Memo, ends_of, gather
from wardline.llm.segments import ByteLevel, Segments
from wardline.llm.tables import chunks, kept

SIZE = 1024
ROUND_UP = 0.95  # the fraction from which a count is rounded up: a doubtful pattern is better left to the packing of the rest
WEIGHTS = (0.0, 0.5)  # powers of its length that a piece weighs
STEPS, STEADY, PROGRESS, IDLE = 60, 1e-3, 1e-3, 4  # steps of one fit at most; the share of the first gradient, and of the loss, that counts as none


# ---- the plan: patterns and counts, from a histogram of lengths ----


def patterns_of(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths, falling, 0 for none, that fill a sequence. ``lengths``: those in stock, rising."""
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    pairs = np.flatnonzero((a >= b) & (a + b <= size))
    a, b = a[pairs], b[pairs]
    c = size - a - b
    there = np.zeros(size + 1, bool)
    there[lengths] = there[0] = True
    full = (c <= b) & there[c]
    return np.stack((a[full], b[full], c[full]), axis=1)


def fit_counts(patterns: np.ndarray, stock: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-negative counts with the least weighted squares between what the patterns use and ``stock``, few of them not 0.

    An active set with many columns a step: the columns with the steepest gradients that share no length enter, the
    entered ones are solved for, and those that turn negative leave until none does. The best step is the result.
    """
    n, many = len(stock), len(patterns)
    best, least, used = np.zeros(many), np.inf, np.zeros(many, bool)
    if not many:
        return best
    held = patterns > 0
    columns, which, counts, gram = np.zeros((n, 0)), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0))
    stop, idle = None, 0
    for _ in range(STEPS):
        rest = weight * stock - columns @ counts
        loss = float(rest @ rest)
        idle = 0 if loss < (1 - PROGRESS) * least else idle + 1
        if loss < least:
            best, least = np.zeros(many), loss
            best[which] = counts
        steep = np.where(used, -np.inf, ((weight * rest)[patterns] * held).sum(axis=1))
        stop = max(STEADY * float(steep.max()), 1e-6) if stop is None else stop
        if len(which) >= n or steep.max() <= stop or idle == IDLE:
            break
        taken, entering = np.zeros(n, bool), []
        first = np.argpartition(-steep, min(4 * n, many - 1))[: 4 * n]
        for j in first[np.argsort(-steep[first], kind="stable")].tolist():
            if steep[j] <= stop:
                break
            own = patterns[j][held[j]]
            if not taken[own].any():
                taken[own] = True
                entering.append(j)
        fresh = np.array(entering[: n - len(which)])
        more = np.zeros((n, len(fresh)))
        for k in range(patterns.shape[1]):
            np.add.at(more, (patterns[fresh, k], np.arange(len(fresh))), weight[patterns[fresh, k]] * held[fresh, k])
        across = columns.T @ more
        gram = np.block([[gram, across], [across.T, more.T @ more]])
        columns, which = np.concatenate((columns, more), axis=1), np.concatenate((which, fresh))
        used[fresh] = True
        while len(which):
            counts = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), columns.T @ (weight * stock))
            stays = counts > 0
            if stays.all():
                break
            used[which[~stays]] = False
            columns, which, gram, counts = columns[:, stays], which[stays], gram[np.ix_(stays, stays)], counts[stays]
    return best


def rounded(patterns: np.ndarray, counts: np.ndarray, stock: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole counts near ``counts`` that ``stock`` has; ``stock`` goes down by what they use."""
    plan = []
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] < ROUND_UP:
            break
        need = np.bincount(patterns[j][patterns[j] > 0])
        own = np.flatnonzero(need)
        times = int(min(np.floor(counts[j] + 1 - ROUND_UP), (stock[own] // need[own]).min()))
        if times > 0:
            stock[own] -= times * need[own]
            plan.append((tuple(int(x) for x in patterns[j] if x), times))
    return plan


def best_fit(stock: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest open sequence that has room; equal lengths and equal sequences move as runs."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in np.flatnonzero(stock)[::-1].tolist():
        left = int(stock[length])
        for space in sorted(s for s in room if s >= length):
            at = space
            while left and at >= length and room[at]:  # what goes in may leave room for one more
                held, times = room[at].pop()
                move = min(times, left)
                if move < times:
                    room[at].append((held, times - move))
                deep = min(at // length, left // move) if move else 0
                room[at - deep * length].append((held + (length,) * deep, move))
                left -= move * deep
        each = size // length
        if left // each:
            room[size - each * length].append(((length,) * each, left // each))
        if left % each:
            room[size - left % each * length].append(((length,) * (left % each), 1))
    return [x for runs in room.values() for x in runs]


def plan_of(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they use the histogram (index: length) up.

    Fitted once with all lengths alike and once with long pieces weighing more: what is left over should be short where
    long pieces are many. The fit that needs fewer sequences is the plan.
    """
    stock = histogram.astype(np.int64).copy()
    plan = [((size,), int(stock[size]))] if stock[size] else []
    stock[size] = 0
    patterns, plans = patterns_of(np.flatnonzero(stock), size), []
    for power in WEIGHTS:
        left = stock.copy()
        counts = fit_counts(patterns, stock.astype(float), (np.arange(size + 1) / size) ** power)
        plans.append(rounded(patterns, counts, left) + best_fit(left, size))
    return plan + min(plans, key=lambda p: sum(times for _, times in p))


class Places:
    """Where the piece with some rank among its length goes."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], size: int):
        runs, first = [], 0
        for pattern, times in plan:
            for length, offset in zip(pattern, ends_of(np.array(pattern)), strict=False):
                runs.append((length, times, first, int(offset)))
            first += times
        runs.sort(key=lambda r: r[0])
        self.length, times, self.first, self.offset = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 4
        ends = ends_of(times)
        begin = np.searchsorted(self.length, self.length, side="left")
        self.start = ends[:-1] - ends[begin]  # rank of the run's first piece among its length
        self.key = self.length << 44 | self.start

    def at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        return self.first[run] + rank - self.start[run], self.offset[run]


# ---- the pieces ----


class Coder:
    def __init__(self, path: str, pattern: str):
        self.letters = ByteLevel(path, pattern, special=True)
        self.memo = Memo(self.letters.encode, 250_000)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; how many each has)."""
        segments = Segments(texts, lead=True)
        found = self.memo.all(segments.distinct)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = sizes[segments.at]
        ids = gather(np.frombuffer(b"".join(found), "<i4"), ends_of(sizes)[:-1][segments.at], each)
        ends = ends_of(each)[segments.bounds]
        special = np.zeros(len(texts), bool)
        for name in self.letters.specials:
            special |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if special.any():  # a special token may stand anywhere in a segment and changes what is around it
            rows = [np.frombuffer(self.letters.encode_whole(texts[i].as_py()), "<i4") if s else ids[ends[i]:ends[i + 1]]
                    for i, s in enumerate(special.tolist())]
            ids, ends = np.concatenate(rows), ends_of(np.fromiter(map(len, rows), np.int64, len(rows)))
        return np.insert(ids, ends[1:], end), np.diff(ends) + 1


@cache
def coder(path: str, pattern: str) -> Coder:
    """Of this worker process, for all its tasks."""
    return Coder(path, pattern)


PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, part int, place long"


def _cutter(path: str, pattern: str, end: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, row = TaskContext.get().partitionId(), coder(path, pattern), 0
        met = np.zeros(size + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            for rows in chunks(batch, "text"):
                ids, counts = encoder.encode(rows["text"], end)
                pieces = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(doc)) - np.repeat(ends_of(pieces)[:-1], pieces)
                lead = (counts - size * (pieces - 1))[doc]  # of the first piece
                start = np.where(number == 0, 0, lead + size * (number - 1))
                length = np.where(number == 0, lead, size)
                order = np.argsort(length, kind="stable")
                among = np.empty(len(order), np.int64)
                among[order] = np.arange(len(order)) - np.searchsorted(length[order], length[order], side="left")
                place = met[length] + among
                met += np.bincount(length, minlength=size + 1)
                cuts = (ends_of(counts)[:-1][doc] + start).tolist()
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(cuts, length.tolist(), strict=True)]
                out = [rows["doc_id"].take(pa.array(doc)), pa.array(row + doc), pa.array(number.astype(np.int32)), pa.array(start),
                       pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(place)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends_of(length), pa.int32()), pa.array(ids.astype(np.int32))))
                row += len(counts)
                yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids)
    return run


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, end: int, size: int = SIZE, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, part and row (which name a row of ``docs``), piece, start, length, ids_crc32, sequence_id, offset, and the ids."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = kept(rows.mapInArrow(_cutter(tokenizer, pattern, end, size, with_ids), PIECE + ", ids array<int>" * with_ids))
    counts = kept(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))  # at most ``size`` rows a task
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("part", "length", before.alias("before"))
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_of(histogram, size), size))  # bounded by ``size``

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.at(batch["length"].to_numpy(), batch["rank"].to_numpy())
            out = {c: batch[c] for c in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    names = [c for c in pieces.columns if c != "place"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "place")
    ranked = pieces.join(first, ["part", "length"]).select(*names, (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(put, kinds + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids, docs (their ids and offsets): the packed sequences, of at most ``size`` ids each.
    ``packed``: pieces with their ids."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), held.alias("held")).select(
        "sequence_id", "length", F.flatten("held.ids").alias("ids"),
        F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("docs"))

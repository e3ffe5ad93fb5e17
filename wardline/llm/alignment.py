"""Alignment of two tokenizers over the same bytes by interval coalescing.

A byte-level tokenizer (A) and a piece model (B) both cut a space and the text into tokens, which are intervals of
bytes. All tokens are sorted by start; the running maximum of their ends is kept, and a group ends where the next
start reaches it, as both cut there. Within a group the overlaps of A with B tokens are expanded. No token of either
crosses a single space between other characters, so texts are cut there and each distinct segment of a chunk is
tokenised and aligned once; a text has the groups and links of its segments, end to end.

How many documents hold a pair of ids linked is counted over the whole corpus. A block is a chunk of documents with
its distinct pairs. A block's counts meet those of other blocks by pair, in a table of one row per pair and block;
the totals go back to the blocks by the same rows, so no document's links are ever rows of a table, and no pair or id
has more rows than there are blocks.

A null or empty text, and one whose tokens of A or B do not spell the space and the text, has no tokens: zeros and the
empty string. Rows that share an id, or have none, are separate documents, one output row each. Only the named columns
are read, so extra columns of any name change nothing. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.ragged import Memo, ends_of, gather, spans
from wardline.llm.segments import ByteLevel, Segments
from wardline.llm.tables import chunks, kept

SHIFT = 32  # a pair is id of A << SHIFT | id of B


class PieceModel:
    """A sentence piece model and the bytes of its tokens."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece of this model crosses a space")
        self.token_bytes = [bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode("utf-8")
                            for i, name in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the tokens by start, number of the group of each in that order)."""
    order = np.lexsort((side, starts))
    start, reach = starts[order], np.maximum.accumulate(ends[order])
    return order, np.cumsum(np.concatenate(([False], start[1:] >= reach[:-1])))


def overlaps(group_a: np.ndarray, group_b: np.ndarray, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (token of A, token of B) whose bytes overlap. ``a``, ``b``: (starts, ends) in order; they tile the same bytes,
    so what a token overlaps is a run of its own group."""
    first = np.searchsorted(b[1], a[0], side="right")
    last = np.searchsorted(b[0], a[1], side="left")
    many = last - first
    left, right = np.repeat(np.arange(len(many)), many), spans(first, many)
    if not (group_a[left] == group_b[right]).all():
        raise ArithmeticError("tokens of two groups overlap")
    return left, right


def _flat(lists: list, count: int) -> np.ndarray:
    return np.fromiter((x for own in lists for x in own), np.int64, count)


class Aligner:
    """Segments to what their tokens are: (numbers of A tokens, B tokens and groups; pairs linked; groups as text)."""

    def __init__(self, letters: str, pattern: str, pieces: str):
        self.a, self.b = ByteLevel(letters, pattern, special=False, held=100_000), PieceModel(pieces)
        self.bytes, self.size, self.start, self.shown = [], [], [], []
        for names in self.a.token_bytes(), self.b.token_bytes:
            size = np.fromiter(map(len, names), np.int64, len(names))
            self.bytes.append(np.frombuffer(b"".join(names), np.uint8))
            self.size.append(size)
            self.start.append(ends_of(size)[:-1])
            # every id before each of the marks that may follow it in a segment
            self.shown.append(pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(len(names))], pa.large_string()))
        self.memo = Memo(self.align, 60_000)

    def _sound(self, ids: list[np.ndarray], counts: list[np.ndarray], plain: list[bytes]) -> np.ndarray:
        """Which segments both tokenizers spell."""
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        sound = size > 0
        for which in 0, 1:
            spelt = gather(self.bytes[which], self.start[which][ids[which]], self.size[which][ids[which]])
            ends = ends_of(self.size[which][ids[which]])[ends_of(counts[which])]
            same = np.diff(ends) == size
            if same.all() and np.array_equal(spelt, np.frombuffer(b"".join(plain), np.uint8)):
                continue
            data = spelt.tobytes()
            sound &= np.array([data[x:y] == p for x, y, p in zip(ends[:-1].tolist(), ends[1:].tolist(), plain, strict=True)], bool)
        return sound

    def align(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        led = [" " + s for s in segments]
        ids_a = self.a.encode(led)
        ids_b = self.b.encode(segments)
        counts = [np.fromiter(map(len, ids_a), np.int64, len(led)) // 4, np.fromiter(map(len, ids_b), np.int64, len(led))]
        ids = [np.frombuffer(b"".join(ids_a), "<i4").astype(np.int64), _flat(ids_b, int(counts[1].sum()))]
        sound = self._sound(ids, counts, [s.encode("utf-8") for s in led])
        if not sound.all():  # those take no part
            ids = [i[np.repeat(sound, c)] for i, c in zip(ids, counts, strict=True)]
            counts = [c * sound for c in counts]
        ends = [np.cumsum(self.size[w][ids[w]]) for w in (0, 1)]
        starts = [e - self.size[w][ids[w]] for w, e in enumerate(ends)]
        side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        order, group = coalesce(np.concatenate(starts), np.concatenate(ends), side)
        of = np.empty(len(order), np.int64)
        of[order] = group
        group_a, group_b = of[:len(ids[0])], of[len(ids[0]):]
        left, right = overlaps(group_a, group_b, (starts[0], ends[0]), (starts[1], ends[1]))
        pairs = ids[0][left] << SHIFT | ids[1][right]
        segment_a = np.repeat(np.arange(len(led)), counts[0])
        links = np.bincount(segment_a[left], minlength=len(led))
        segment_of_group = segment_a[np.flatnonzero(np.diff(group_a, prepend=-1))]  # each group has a token of A, in order
        groups = np.bincount(segment_of_group, minlength=len(led))
        text, cuts = self._written(ids, of, side, starts, segment_of_group, counts)
        numbers = np.stack((*counts, groups), axis=1).astype("<i4")
        numbers[~sound] = -1
        data, at = pairs.astype("<i8").tobytes(), (8 * ends_of(links)).tolist()
        return [(n.tobytes(), data[x:y], text[u:v]) for n, x, y, u, v in
                zip(numbers, at[:-1], at[1:], cuts[:-1], cuts[1:], strict=True)]

    def _written(self, ids, of, side, starts, segment_of_group, counts) -> tuple[bytes, list[int]]:
        """"a1,a2|b1;a3|b2" of all segments, end to end, and where each one's begins and ends."""
        order = np.lexsort((np.concatenate(starts), side, of))  # by group, A before B
        group, which = of[order], side[order]
        inner = (group[1:] == group[:-1], which[1:] == which[:-1])
        same_segment = np.zeros(len(order), bool)
        same_segment[:-1] = segment_of_group[group[1:]] == segment_of_group[group[:-1]] if len(order) else False
        mark = np.full(len(order), 3)
        mark[:-1] = np.where(inner[0] & inner[1], 0, np.where(inner[0], 1, np.where(same_segment[:-1], 2, 3)))
        own = np.concatenate(ids)[order]
        parts = [self.shown[w].take(pa.array(mark[at] * (len(self.shown[w]) // 4) + own[at]))
                 for w in (0, 1) for at in [np.flatnonzero(which == w)]]
        back = np.empty(len(order), np.int64)
        back[np.argsort(which, kind="stable")] = np.arange(len(order))
        joined = pa.concat_arrays(parts).take(pa.array(back))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        text = joined.buffers()[2].to_pybytes() if len(joined) else b""
        return text, offsets[ends_of(counts[0] + counts[1])].tolist()


@cache
def aligner(letters: str, pattern: str, pieces: str) -> Aligner:
    """Of this worker process, for all its tasks."""
    return Aligner(letters, pattern, pieces)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), *((n, pa.list_(pa.int64())) for n in NUMBERS),
                   ("groups_sha256", pa.list_(pa.string())), ("groups", pa.list_(pa.large_string())), ("pairs", pa.list_(pa.int64())),
                   ("holders", pa.list_(pa.int64())), ("distinct", pa.list_(pa.int64())), ("places", pa.binary()), ("times", pa.binary())])


def _squeezed(values: np.ndarray) -> bytes:
    """A compressed column of whole numbers, two bytes each where all fit."""
    wide = len(values) and values.max() > 0xFFFF
    return (b"4" if wide else b"2") + pa.compress(values.astype("<u4" if wide else "<u2").tobytes(), "zstd", asbytes=True)


def _spread(data: bytes, count: int) -> np.ndarray:
    size = int(data[:1])
    raw = pa.decompress(data[1:], count * size, "zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{size}").astype(np.int64)


def align_block(own: Aligner, ids: pa.Array, texts: pa.Array, block: int, with_groups: bool) -> pa.RecordBatch:
    """One row: the documents of a chunk, its distinct pairs with the documents that hold each, and each document's pairs."""
    segments = Segments(texts, lead=False)
    found = own.memo.all(segments.distinct)
    numbers = np.frombuffer(b"".join([f[0] for f in found]), "<i4").reshape(-1, 3).astype(np.int64)
    size = np.fromiter((len(f[1]) for f in found), np.int64, len(found)) // 8
    pairs, number = np.unique(np.frombuffer(b"".join([f[1] for f in found]), "<i8"), return_inverse=True)
    bounds, at = segments.bounds, segments.at
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    bad = np.bincount(doc, numbers[at, 0] < 0, n) > 0
    counts = [np.bincount(doc, numbers[at, k], n).astype(np.int64) * ~bad for k in range(3)]
    counts.append(np.bincount(doc, size[at], n).astype(np.int64) * ~bad)
    good = ~bad[doc]
    kept_at, kept_doc = at[good], doc[good]
    links = gather(number, ends_of(size)[:-1][kept_at], size[kept_at])  # of all documents, as places in ``pairs``
    key = np.sort(np.repeat(kept_doc, size[kept_at]) * max(len(pairs), 1) + links)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(new, len(key)))
    owner, place = np.divmod(key[new], max(len(pairs), 1))
    distinct = np.bincount(owner, minlength=n)
    step = np.diff(place, prepend=0)
    heads = ends_of(distinct)[:-1][distinct > 0]
    step[heads] = place[heads]  # each document's places rise from the start again
    shown, words = [f[2] for f in found], at.tolist()
    whole = [b"" if b else b";".join([shown[i] for i in words[x:y]]) for b, x, y in zip(bad.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    digest = [hashlib.sha256(w).hexdigest() if w else "" for w in whole]
    row = [[block], [ids.to_pylist()], *([c] for c in counts), [digest], [[w.decode() for w in whole] if with_groups else None], [pairs],
           [np.bincount(place, minlength=len(pairs))], [distinct], [_squeezed(step)], [_squeezed(times)]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)


def _blocks(paths: tuple[str, str, str], with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = aligner(*paths), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in chunks(batch, "text", 4 << 20):
                yield align_block(own, rows["doc_id"], rows["text"], number, with_groups)
                number += 1
    return run


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _scored(block: pa.Table, totals: pa.Table) -> pa.Table:
    """Documents of one block, with what the corpus says of their pairs."""
    row = {name: block[name][0] for name in block.column_names}
    at = totals["place"].to_numpy()
    total, best = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
    total[at], best[at] = totals["total"].to_numpy(), totals["best"].to_numpy(zero_copy_only=False)
    distinct = np.array(row["distinct"].values)
    many = int(distinct.sum())
    step, times = _spread(row["places"].as_py(), many), _spread(row["times"].as_py(), many)
    ends = ends_of(distinct)
    run = np.cumsum(step)
    place = run - np.repeat(np.concatenate(([0], run))[ends[:-1]], distinct)
    sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[place])))[ends]) for x in (best, total)]
    own = {"doc_id": row["docs"].values, **{n: row[n].values for n in NUMBERS}, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]),
           "groups_sha256": row["groups_sha256"].values}
    if "groups" in row:
        own["groups"] = row["groups"].values.cast(pa.string())
    return pa.table(own)


def align_tokenizers(docs: DataFrame, letters: str, pattern: str, pieces: str, doc_id: str = "doc_id", text: str = "text",
                     with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups as text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = ", ".join(f"{f.name} {'array<' * pa.types.is_list(f.type)}{_spark(f.type)}{'>' * pa.types.is_list(f.type)}" for f in BLOCK)
    blocks = kept(rows.mapInArrow(_blocks((letters, pattern, pieces), with_groups), kind))
    held = (blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "x"))
            .select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n")))
    totals = held.groupBy("pair").agg(F.sum("n").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.shiftright("pair", SHIFT)))  # at most one row per id of B
    totals = totals.select("pair", "total", (F.col("total") == most).alias("best"))
    back = held.select("block", "place", "pair").join(totals, "pair").select(F.col("block").alias("of"), "place", "total", "best")
    wanted = blocks.drop("pairs", "holders") if with_groups else blocks.drop("pairs", "holders", "groups")
    return (wanted.groupBy("block").cogroup(back.groupBy("of"))
            .applyInArrow(_scored, RESULT + ", groups string" * with_groups))


def _spark(kind: pa.DataType) -> str:
    kind = kind.value_type if pa.types.is_list(kind) else kind
    return "long" if kind == pa.int64() else "binary" if kind == pa.binary() else "string"

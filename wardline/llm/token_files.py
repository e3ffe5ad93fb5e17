"""Token ids in binary files of patched frame-of-reference blocks.

A segment is a run of whole documents with at least ``SEGMENT`` ids (the last may be shorter; one long
document may make a longer one). Its bytes, little-endian throughout:

    magic PFR1 | documents, ids, blocks: 3 x u32 | doc lengths: u32 each | block starts: u32 each | blocks

A block holds up to 128 ids: minimum u32, bit width u8, number of exceptions u8, the ids less the minimum
packed at that width (low bits first; an exception packs its low bits), then the exceptions: positions u8
each and high parts u32 each. The width is the one that the ``PERCENTILE`` share of the block fits in.
Block starts allow the block of any id to be read alone.

Documents are put in id order by a range partition; each partition writes its segments as rows of a
Parquet table in the shared folder, so that Spark's own commit protocol covers lost executors. Null text is
empty; rows with equal ids follow each other in text order. Null ids come first.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.ragged import Memo, Pieces, ends_of, gather
from wardline.llm.tables import chunks, kept

MAGIC = b"PFR1"
BLOCK = 128
SEGMENT = 1 << 16
PERCENTILE = 0.9


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values to rows of 16 * width bytes, low bits first."""
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), BLOCK * width), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def encode_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of one segment."""
    n = -(-len(ids) // BLOCK)
    grid = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    fits = np.sort(rest, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1]
    width = np.ceil(np.log2(fits.astype(np.float64) + 1)).astype(np.uint32)
    over = rest >> width[:, None] if n else rest
    over[:, :] = np.where(width[:, None] >= 32, 0, over)
    outliers = (over > 0).sum(axis=1)
    sizes = 6 + 16 * width.astype(np.int64) + 5 * outliers
    starts = ends_of(sizes)
    out = np.zeros(int(starts[-1]), np.uint8)
    head = np.concatenate((low.astype("<u4")[:, None].view(np.uint8), width.astype(np.uint8)[:, None],
                           outliers.astype(np.uint8)[:, None]), axis=1)
    out[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            out[starts[own, None] + 6 + np.arange(16 * w)] = _pack(rest[own], w)
    block, place = np.nonzero(over)
    rank = np.arange(len(block)) - np.repeat(ends_of(outliers)[:-1], outliers)
    base = starts[block] + 6 + 16 * width[block].astype(np.int64)
    out[base + rank] = place
    out[(base + outliers[block] + 4 * rank)[:, None] + np.arange(4)] = over[block, place].astype("<u4")[:, None].view(np.uint8)
    return (MAGIC + struct.pack("<3I", len(lengths), len(ids), n) + lengths.astype("<u4").tobytes()
            + starts[:-1].astype("<u4").tobytes() + out.tobytes())


def _layout(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, ids, n = struct.unpack_from("<3I", data, 4)
    lengths = np.frombuffer(data, "<u4", docs, 16)
    starts = np.frombuffer(data, "<u4", n, 16 + 4 * docs).astype(np.int64)
    return ids, n, lengths, starts, np.frombuffer(data, np.uint8, offset=16 + 4 * docs + 4 * n)


def _blocks(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    head = body[starts[:, None] + np.arange(6)]
    low, width, outliers = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0], head[:, 4], head[:, 5].astype(np.int64)
    grid = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            grid[own] = _unpack(body[starts[own, None] + 6 + np.arange(16 * w)], w)
    block = np.repeat(np.arange(len(starts)), outliers)
    rank = np.arange(len(block)) - np.repeat(ends_of(outliers)[:-1], outliers)
    base = starts[block] + 6 + 16 * width[block].astype(np.int64)
    high = np.ascontiguousarray(body[(base + outliers[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    grid[block, body[base + rank]] += high << width[block].astype(np.uint32)
    return grid + low[:, None]


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, document lengths)."""
    ids, n, lengths, starts, body = _layout(data)
    return (_blocks(body, starts).ravel()[:ids] if n else np.empty(0, np.uint32)), lengths


def read_ids(data: bytes, start: int, count: int) -> np.ndarray:
    """``count`` ids from ``start`` on, from only the blocks that hold them."""
    total, _, _, starts, body = _layout(data)
    end = min(start + count, total)
    if end <= start:
        return np.empty(0, np.uint32)
    first = start // BLOCK
    return _blocks(body, starts[first:-(-end // BLOCK)]).ravel()[start - first * BLOCK:end - first * BLOCK]


class Encoder:
    """Texts to ids by pieces between spaces. The tokenizer's own splitter drops white space and no token
    spans it, so a text's ids are those of its pieces, end to end; each distinct piece is encoded once a call.

    In a piece of ASCII and Latin-1 letters, which need no normalising but lower case, the splitter's
    stretches are found here, of all such pieces at once, and go straight to the tokenizer's model; any other
    piece takes its whole path.
    """

    PLAIN = "\\A[\n!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+\\z"  # as Arrow reads it
    STRETCH = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^\n a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+| ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.latin = {c: "".join(t for t, _ in shown(chr(c))) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
        self.stretches = Memo(self._stretches, 120_000)
        self.others = Memo(self._others, 120_000)

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        tokenize, latin = self.tokenizer.model.tokenize, self.latin
        out = []
        for s in stretches:
            tokens = tokenize(s if s.isascii() else s.translate(latin))
            out.append(tokens[0].id.to_bytes(4, "little") if len(tokens) == 1 else np.array([t.id for t in tokens], "<u4").tobytes())
        return out

    def _others(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _plain(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of plain pieces, how many each has). Their stretches are found in one text of all, at whose spaces pieces end."""
        found = self.STRETCH.findall(" ".join(pieces.to_pylist()).lower())
        coded = pa.array(found, pa.string()).dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        space = names.index(" ") if len(pieces) > 1 else -1
        known = self.stretches.all([s for s in names if s != " "])
        if space >= 0:
            known.insert(space, b"")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        each = sizes[at]
        ids = gather(np.frombuffer(b"".join(known), "<u4"), ends_of(sizes)[:-1][at], each)
        cuts = np.concatenate(([0], np.flatnonzero(at == space), [len(at)]))
        return ids, np.diff(ends_of(each)[cuts])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces, how many each has)."""
        plain = pc.and_(pc.match_substring_regex(pieces, self.PLAIN), pc.invert(pc.match_substring(pieces, "<|")))
        own = plain.to_numpy(zero_copy_only=False)
        sizes, parts = np.zeros(len(pieces), np.int64), []
        if own.any():
            ids, sizes[own] = self._plain(pieces.filter(plain))
            parts.append(ids)
        if not own.all():
            found = self.others.all(pieces.filter(pc.invert(plain)).to_pylist())
            sizes[~own] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            parts.append(np.frombuffer(b"".join(found), "<u4"))
        if len(parts) < 2:
            return (parts or [np.empty(0, np.uint32)])[0], sizes
        starts = np.empty(len(pieces), np.int64)
        starts[own] = ends_of(sizes[own])[:-1]
        starts[~own] = ends_of(sizes[~own])[:-1] + len(parts[0])
        return gather(np.concatenate(parts), starts, sizes), sizes

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; how many each has)."""
        pieces = Pieces(texts)
        values, sizes = self._pieces(pieces.coded)
        each = sizes[pieces.at]
        ids = gather(values, ends_of(sizes)[:-1][pieces.at], each)
        counts = np.diff(ends_of(each)[pieces.bounds])
        last = ends_of(counts)[1:]
        return np.insert(ids, last, end), counts + 1


@cache
def coder(path: str) -> Encoder:
    """Of this worker process, for all its tasks."""
    return Encoder(path)


def _writer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, number = TaskContext.get().partitionId(), coder(path), 0
        docs, ids, lengths, held = [], [], [], 0

        def closed():
            data = encode_segment(np.concatenate(ids), np.concatenate(lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "segment", "docs", "n_ids", "data"])

        for batch in batches:
            for rows in chunks(batch, "text", 8 << 20):
                own, counts = encoder.encode(rows["text"], end)
                names, ends, at = rows["doc_id"].to_pylist(), ends_of(counts), 0
                while at < len(names):  # up to the document that fills the segment
                    stop = min(int(np.searchsorted(ends, ends[at] + SEGMENT - held)), len(names))
                    docs += names[at:stop]
                    ids.append(own[ends[at]:ends[stop]])
                    lengths.append(counts[at:stop])
                    held += int(ends[stop] - ends[at])
                    at = stop
                    if held >= SEGMENT:
                        yield closed()
                        number, held, docs, ids, lengths = number + 1, 0, [], [], []
        if docs:
            yield closed()
    return run


def write_token_files(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table: part, segment, docs (their ids in order), n_ids, data."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return kept(ordered.mapInArrow(_writer(tokenizer, end), "part int, segment long, docs array<long>, n_ids long, data binary"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, lengths = decode_segment(row["data"])
            ends = ends_of(lengths.astype(np.int64))
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(ends[:-1] + row["first"]), pa.array(lengths.astype(np.int64)),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def document_index(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files."""
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n_ids"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = (parts.alias("p").join(parts.alias("q"), F.col("q.part") < F.col("p.part"), "left")  # one row per partition
              .groupBy("p.part").agg(F.coalesce(F.sum("q.n"), F.lit(0)).alias("before")))
    from pyspark.sql import Window

    own = Window.partitionBy("part").orderBy("segment")
    first = sizes.select("part", "segment", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("inside")).join(before, "part")
    placed = files.join(first.select("part", "segment", (F.col("before") + F.col("inside")).alias("first")), ["part", "segment"])
    return placed.select("docs", "data", "first").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")

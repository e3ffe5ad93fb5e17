"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a 23-bit word. The binary
Golay code is perfect: every word lies within three bits of exactly one codeword. The fuzzy keys of a
word are the codewords of all words within one bit of it (one key or six). Words within one bit of each
other hold each other's own codeword among their keys; words within two bits share a key, that of a word
between them.

Four errors over three segments leave two segments with at most one error each, or one segment without
error and another with at most two. So a fingerprint is filed, for each pair of segments, under
(own codeword, key) and (key, own codeword), and, for each segment, under (its bits, key of the next):
every linked pair meets in some file, and each meeting is verified by counting bits.

Exact copies of a fingerprint are merged first. A file gives a spanning forest of its links, not all
pairs; a file with more than ``FILE`` members is dealt into blocks, and each pair of blocks is one task's
group. Components come from ``components``. Null text has no words; a null id never is a component's id
unless all ids of it are null; rows that share an id are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wardline.llm.components import components
from wardline.llm.tables import by_chunk, chunks, kept, resident

SHINGLE = 4
SEED = 42
DISTANCE = 4
FILE = 4096
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the (23, 12) Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII space only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(),
                                                                 strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    resident(None)
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(_bits(part["text"].to_pylist()))], ["doc_id", "fp"])


@cache
def _nearest() -> np.ndarray:
    """For each 23-bit word, the number of the codeword within three bits of it."""
    code = np.zeros(1 << 12, np.int64)
    for i in range(12):
        code ^= np.where(np.arange(1 << 12) >> i & 1, GENERATOR << i, 0)
    errors = np.array([sum(1 << i for i in c) for n in range(4) for c in combinations(range(23), n)])
    table = np.empty(1 << 23, np.uint16)
    for e in errors:
        table[code ^ e] = np.arange(1 << 12)
    return table


def segments(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    return [(bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index into ``words``, key), each once."""
    flips = np.concatenate(([0], 1 << np.arange(23)))
    keys = np.sort(_nearest()[words[:, None] ^ flips], axis=1)
    fresh = np.concatenate((np.ones((len(words), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
    return np.nonzero(fresh)[0], keys[fresh].astype(np.int64)


def files_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(file, fp) rows: every file that each fingerprint belongs to."""
    words = segments(fps)
    own = [_nearest()[w].astype(np.int64) for w in words]
    fuzzy = [fuzzy_keys(w) for w in words]
    files, members = [], []
    for tag in range(3):
        a, b = tag, (tag + 1) % 3
        (ia, ka), (ib, kb) = fuzzy[a], fuzzy[b]
        other = kb != own[b][ib]  # (own, own) is there already
        files += [tag << 40 | ka << 12 | own[b][ia], tag << 40 | own[a][ib][other] << 12 | kb[other],
                  (tag + 3) << 40 | words[a][ib] << 12 | kb]
        members += [ia, ib[other], ib]
    return np.concatenate(files), fps[np.concatenate(members)]


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch["fp"].to_numpy()
        for i in range(0, len(fps), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in files_of(fps[i:i + 5000])], ["file", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``."""
    left, ends_a, ends_b = fps, [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _near(left, at)
            found = left[near]
            ends_a.append(np.full(len(found), at))
            ends_b.append(found)
            todo += found.tolist()
            left = left[~near]
    none = [np.empty(0, np.int64)]
    return np.concatenate(ends_a or none), np.concatenate(ends_b or none)


def _links(file: np.ndarray, part: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within each file of rows sorted by (file, part)."""
    new = np.concatenate(([True], (file[1:] != file[:-1]) | (part[1:] != part[:-1]), [True]))
    bounds = np.flatnonzero(new)
    sizes = np.diff(bounds)
    run = np.repeat(np.where(sizes <= 8, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    out = []
    for d in range(1, min(8, len(fps))):
        same = np.flatnonzero((run[d:] == run[:-d]) & (run[d:] >= 0))
        if not len(same):
            break
        same = same[_near(fps[same], fps[same + d])]
        out.append((fps[same], fps[same + d]))
    out += [forest(np.unique(fps[a:b])) for a, b in zip(bounds[:-1][sizes > 8], bounds[1:][sizes > 8], strict=True)]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
    held: list[list[np.ndarray]] = []

    def result(rows):
        for a, b in _links(*rows):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        held.append([batch[c].to_numpy() for c in ("file", "part", "fp")])
        if sum(len(h[0]) for h in held) < 100_000:
            continue
        rows = [np.concatenate([r, *x]) for r, x in zip(rest, zip(*held, strict=True), strict=True)]
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = last[-1] + 1 if len(last) else 0  # the last file may go on in the next batch
        rest, held = [r[cut:] for r in rows], []
        yield from result([r[:cut] for r in rows]) if cut else ()
    rows = [np.concatenate([r, *x]) for r, x in zip(rest, zip(*held, strict=True), strict=True)] if held else rest
    if len(rows[0]):
        yield from result(rows)


def links(fps: DataFrame, file: int = FILE) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect all that are linked."""
    filed = kept(fps.select("fp").mapInArrow(_filed, "file long, fp long"))
    size = filed.groupBy("file").agg(F.count("*").alias("n"))
    large = kept(size.where(F.col("n") > file))
    if large.isEmpty():
        dealt = filed.withColumn("part", F.lit(0))
    else:
        blocks = F.ceil(F.col("n") / (file // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
        dealt = (filed.join(large.select("file", blocks.alias("blocks")), "file", "left")
                 .withColumn("own", own)
                 .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                                                .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
                 .select("file", "fp", F.when(F.col("blocks").isNull(), 0).otherwise(
                     1 + F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("int").alias("part")))
    return (dealt.repartition("file", "part").sortWithinPartitions("file", "part")
            .select("file", "part", "fp").mapInArrow(_linked, "a long, b long").distinct())


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the group), component_id (its smallest doc_id): one row per row of ``docs``."""
    rows = kept(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
                .mapInArrow(_fingerprints, "doc_id long, fp long"))
    classes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(classes)).select(F.col("node").alias("fp"), "label")
    rooted = classes.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(kept(rooted.join(groups, "root").select("fp", "root", "component_id")), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each group; of rows that share that id, one."""
    found = near_groups(docs)
    stays = kept(found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                 .groupBy("doc_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "kept_id"))
    out = docs.join(stays.drop("n"), docs["doc_id"].eqNullSafe(stays["kept_id"]), "left_semi")
    if stays.where("n > 1").isEmpty():
        return out
    root = found.select(F.col("doc_id").alias("found_id"), F.col("fp").alias("found_fp"), "root").distinct()
    rows = (docs.join(stays.drop("n"), docs["doc_id"].eqNullSafe(stays["kept_id"]), "left_semi")
            .select(F.struct("*").alias("row_"), F.col("doc_id").alias("id_"), _fingerprint(F.col("text")).alias("fp_")))
    rooted = rows.join(root, rows["id_"].eqNullSafe(root["found_id"]) & (rows["fp_"] == root["found_fp"]))
    return rooted.dropDuplicates(["id_", "root"]).select("row_.*")


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(by_chunk(lambda part: _bits(part.to_pylist()), texts).astype(np.int64))


def _bits(texts: list[str | None]) -> np.ndarray:
    return np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)

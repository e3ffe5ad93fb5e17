"""Secret scan: keyword prefilter, anchored expressions near the hits, checksums.

An Aho-Corasick automaton finds the keywords in the text with ASCII letters in lower case; an expression
anchored at the hit decides. Runs of hexadecimal digits have no keyword of their own: each character is
mapped to its class first, and sixteen digits in a row are the keyword. Matches of a kind do not overlap:
a hit inside an earlier match of its kind, kept or failed, is passed over, as a left-to-right search would.

Base kinds: ``assign``, ``access``, ``hex``. The checksum kinds are only kept when the sum that the token
carries is right: ``github`` and ``npm`` tokens end in the CRC-32 of their random part, in base 62. All
offsets are code points, end exclusive. Null text is empty. Every row gives one row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import chunks

# Kinds in the order of ties, their keywords and expressions.
KINDS = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": (("akia",), rb"AKIA[A-Z0-9]+"),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": (("npm_",), rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
ORDER = ("assign", "access", "hex", "github", "npm")
BASE = 3
ASSIGNED, ACCESS, HEX = 12, 18, 16
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CLASSES = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(".") for i in range(256))


def checksum(body: bytes) -> bytes:
    """CRC-32 of ``body`` in six base-62 digits."""
    value, out = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.encode()


def _valid(kind: str, match: re.Match[bytes]) -> bool:
    if kind == "assign":
        return len(match[1]) >= ASSIGNED
    if kind == "access":
        return len(match[0]) >= ACCESS
    return checksum(match[1]) == match[2]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, (words, _) in KINDS.items():
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()
        self.expressions = {kind: re.compile(expression) for kind, (_, expression) in KINDS.items()}

    def _hits(self, data: bytes) -> list[tuple[int, str]]:
        lower = data.lower().decode("latin-1")  # a character for each byte
        return sorted((end + 1 - size, kind) for end, (kind, size) in self.automaton.iter(lower))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind as listed."""
        data = text.encode("utf-8", "surrogatepass")
        found, free = [], dict.fromkeys(KINDS, 0)
        for start, kind in self._hits(data):
            if start >= free[kind] and (match := self.expressions[kind].match(data, start)):
                free[kind] = match.end()
                if _valid(kind, match):
                    found.append((start, match.end(), kind))
        classes, at = data.translate(CLASSES), 0
        while (start := classes.find(b"h" * HEX, at)) >= 0:
            at = classes.find(b".", start)
            at = len(classes) if at < 0 else at
            found.append((start, at, "hex"))
        if found and len(data) != len(text):
            found = self._in_characters(data, found)
        return sorted(found, key=lambda s: (s[0], ORDER.index(s[2])))

    @staticmethod
    def _in_characters(data: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        place, before, chars = {}, 0, 0
        for at in sorted({x for s in found for x in s[:2]}):
            chars += len(data[before:at].decode("utf-8", "surrogatepass"))
            before = at
            place[at] = chars
        return [(place[a], place[b], kind) for a, b, kind in found]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        for rows in chunks(batch, "text"):
            spans = [scanner.spans(t or "") for t in rows["text"].to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in own) for own in spans], pa.int64()) for k in ORDER]
            told = [[f"{kind}:{a}:{b}" for a, b, kind in own] for own in spans]
            base = [",".join(t for t, s in zip(ts, own, strict=True) if s[2] in ORDER[:BASE])
                    for ts, own in zip(told, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]),
                 pa.array([",".join(t) for t in told], pa.string())],
                ["doc_id", *(f"n_{k}" for k in ORDER), "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the base spans, all spans."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = "".join(f", n_{k} long" for k in ORDER)
    return rows.mapInArrow(_scanned, f"doc_id {kind}{counts}, base_sha256 string, spans string")

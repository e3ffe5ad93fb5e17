"""Texts cut where no token of a space-led vocabulary can cross: before a single space between two characters that are not space.

Each distinct segment is encoded once for a chunk of texts; results of a text are those of its segments, end to end.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from wardline.llm.ragged import Memo, Pieces, ends_of

CUT = re.compile(r"(?<=\S)(?= \S)")
OTHER = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"  # space besides " "
ODD, ODD_LED = rf"^$|^[ {OTHER}]|[ {OTHER}]$", rf"^ ?$|^ [ {OTHER}]|^[{OTHER}]|[ {OTHER}]$"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


class Segments:
    """``distinct`` segments of a column of texts, each once; ``at[bounds[i]:bounds[i + 1]]`` are those of text i.

    With ``lead`` the space before a segment, but for a text's first, is part of it; else it is left out.
    """

    def __init__(self, texts: pa.Array, lead: bool):
        pieces = Pieces(texts, lead)
        self.distinct, self.at, self.bounds = pieces.distinct, pieces.at, pieces.bounds
        odd = pc.match_substring_regex(pa.array(self.distinct, pa.large_string()), ODD_LED if lead else ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return
        strange = np.add.reduceat(odd[self.at], self.bounds[:-1]) > 0 if len(self.at) else np.zeros(0, bool)
        number = {d: i for i, d in enumerate(self.distinct)}
        rows = []
        for i, is_strange in enumerate(strange.tolist()):
            if is_strange:
                first, *rest = CUT.split(texts[i].as_py() or "")
                own = [first, *(rest if lead else (s[1:] for s in rest))]
                rows.append(np.array([number.setdefault(s, len(number)) for s in own], np.int64))
            else:
                rows.append(self.at[self.bounds[i]:self.bounds[i + 1]])
        used, self.at = np.unique(np.concatenate(rows), return_inverse=True)
        names = list(number)
        self.distinct = [names[i] for i in used.tolist()]
        self.bounds = ends_of(np.fromiter(map(len, rows), np.int64, len(rows)))


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = {b: chr(b) for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}
    hidden = (b for b in range(256) if b not in shown)
    return shown | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE tokenizer file. Segments of ASCII and Latin letters are cut by the pattern here and each distinct
    stretch goes to the tokenizer's model; any other segment takes the tokenizer's whole path.

    ``special``: whether strings of special tokens inside texts become those tokens.
    """

    WORD, MARKED, PLAIN = f"^ ?[{LETTERS}]+$", f"^ ?[{LETTERS}]+[.,;:!?]$", f"^[\t\n !-~{LETTERS}]*$"

    def __init__(self, path: str, pattern: str, special: bool, held: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        cutter = made["pre_tokenizer"] or {}
        if made.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normaliser or prefix space is needed")
        self.specials = [t["content"] for t in made["added_tokens"]] if special else []
        self.letters = byte_letters()
        self.pattern = regex.compile(pattern)
        self.stretches = Memo(self._stretches, held)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        byte = {c: b for b, c in self.letters.items()}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            known = all(c in byte for c in token)
            out[i] = bytes(byte[c] for c in token) if known else token.encode("utf-8")
        return out

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        tokenize, letters, space = self.tokenizer.model.tokenize, self.letters, self.letters[32]
        shown = (s.replace(" ", space) if s.isascii() and s.isprintable() else s.encode("utf-8").decode("latin-1").translate(letters)
                 for s in stretches)
        return [array("i", [t.id for t in tokenize(s)]).tobytes() for s in shown]

    def encode(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, as the bytes of int32."""
        if not segments:
            return []
        texts = pa.array(segments, pa.large_string())
        word = pc.match_substring_regex(texts, self.WORD).to_numpy(zero_copy_only=False)
        whole = self.stretches.all(words := [segments[i] for i in np.flatnonzero(word).tolist()])  # a word is one stretch
        if len(words) == len(segments):
            return whole
        rows = np.flatnonzero(~word)
        texts, segments = texts.take(pa.array(rows)), [segments[i] for i in rows.tolist()]
        marked, plain = (pc.match_substring_regex(texts, p).to_pylist() for p in (self.MARKED, self.PLAIN))
        cut = self.pattern.findall
        parts = [(s[:-1], s[-1]) if m else cut(s) if p else () for s, m, p in zip(segments, marked, plain, strict=True)]
        known = dict(zip(all_ := list(set(chain.from_iterable(parts))), self.stretches.all(all_), strict=True))
        other = [s for s, p in zip(segments, plain, strict=True) if not p]
        rest = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else ())
        cuts = iter([known[c[0]] if len(c) == 1 else b"".join([known[x] for x in c]) if p else array("i", next(rest).ids).tobytes()
                     for c, p in zip(parts, plain, strict=True)])
        words = iter(whole)
        return [next(words) if w else next(cuts) for w in word.tolist()]

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

"""Texts cut into pieces that recur, and gathers of rows of unequal length."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s : s + n] of each (s, n), end to end."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """s, s + 1 ... s + n - 1 of each (s, n), end to end."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return at


def ends_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


class Pieces:
    """The pieces between spaces of a column of texts: the distinct ones, and where each text has them.

    ``lead`` puts the space before each piece but a text's first back into it.
    """

    def __init__(self, texts: pa.Array, lead: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = lead and not pc.any(pc.match_substring(texts, "\0")).as_py()
        if marked:  # a mark before each space keeps the space in its piece
            texts = pc.replace_substring(texts, " ", "\0 ")
        lists = pc.split_pattern(texts, "\0" if marked else " ")
        self.bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        if lead and not marked:
            first = np.zeros(len(flat), bool)
            first[self.bounds[:-1]] = True
            empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
            flat = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(empty, flat, space))
        coded = flat.dictionary_encode()
        self.coded = coded.dictionary
        self.at = coded.indices.to_numpy()

    @cached_property
    def distinct(self) -> list[str]:
        return self.coded.to_pylist()


class Memo:
    """Results by piece, computed for all missing ones at once. Holds two generations of ``limit`` pieces or one call's:
    what is used stays, the rest goes with its generation."""

    def __init__(self, compute, limit: int):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def all(self, pieces: list) -> list:
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        absent = [i for i, x in enumerate(out) if x is None]
        if absent:
            asked = [pieces[i] for i in absent]
            known = list(map(old.get, asked))
            missing = [p for p, x in zip(asked, known, strict=True) if x is None]
            made = iter(self.compute(missing) if missing else ())
            known = [next(made) if x is None else x for x in known]
            young.update(zip(asked, known, strict=True))
            for i, x in zip(absent, known, strict=True):
                out[i] = x
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out

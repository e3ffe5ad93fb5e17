"""What the tables of a byte-level BPE worker take."""

import random

import numpy as np
import public_tokenizers
import pytest

from wardline.llm import byte_bpe


def test_the_transducer_grows_without_a_copy():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own, table = byte_bpe.Transducer(ranks), None
    dice = random.Random(5)
    letters = [bytes([b]) for b in range(33, 115)]
    known = [b"".join(dice.choices(letters, k=dice.randint(2, 30))) for _ in range(4_000)]
    own.encode([b"".join(letters[i:i + 41]) for i in (0, 41)])  # 82 bytes met: 64 columns are not enough, 96 are
    assert own.moves.shape[1] == 96
    table, before = own.moves, len(own.states)
    first = own.encode(known)
    assert len(own.states) > before + 4096 and own.moves is table
    assert own.encode(known) == first
    assert [b"".join(own.bytes_of[i] for i in np.frombuffer(ids, "<i4").tolist()) for ids in first] == known


@pytest.mark.parametrize("states", [1, 500])
def test_a_transducer_that_starts_anew_gives_equal_ids(states, monkeypatch):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    dice = random.Random(7)
    known = [bytes(dice.choices(range(256), k=dice.randint(2, 60))) for _ in range(300)]
    whole = byte_bpe.Transducer(ranks).encode(known)
    monkeypatch.setattr(byte_bpe.Transducer, "STATES", states)  # calls pass the table's rows, too
    small = byte_bpe.Transducer(ranks)
    assert [small.encode([s])[0] for s in known] == whole
    assert small.encode(known) == whole

"""Byte-level BPE by a lazily determinised transducer, and streaming decode by a UTF-8 state machine.

The pattern cuts a text into stretches; each is encoded on its own. A sequence of tokens is what the
merges give for its bytes exactly when each neighbouring pair is what they give for the pair's bytes, so
a transducer needs to remember only its last token and how far it is into the next one. It guesses
where tokens end; its states are sets of guesses, made and remembered when first met. Tokens before
the open token of the only guess left are settled and emitted: the look-ahead is bounded by the open
tokens that the vocabulary allows. A stretch that is itself a token is that token.

Texts are encoded by pieces between single spaces, where no stretch can continue; each distinct piece is
run once per chunk of texts. A text with other white space at a piece's edge is cut by the pattern as a whole.

Null text is empty. Every row gives one row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.ragged import Memo, Pieces, ends_of, gather
from wardline.llm.tables import chunks, resident

NONE = -1
UNMERGED = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    """Bytes of one stretch to token ids.

    A guess is (last closed token, trie node of the open one); a state is the guesses that the bytes so far
    allow, from the longest open token to the shortest. At most one guess of a state can close, since one
    encoding of the bytes so far is right; ``closing`` holds the length of that token. Once a state has a
    single guess, all that lies before its open token is settled.
    """

    STATES, PAIRS, ROW, COLUMNS = 120_000, 300_000, 48, 32

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at, self.depth = [NONE], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if (below := self.child.get(key)) is None:
                    below = self.child[key] = len(self.token_at)
                    self.token_at.append(NONE)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.token_at[node] = rank
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.closing, self.closed = np.zeros(4096, np.int16), np.zeros(4096, np.int32)
        self.column = np.full(256, NONE, np.int16)  # of ``moves``, for the bytes met so far
        # the next state plus one, so that zero is none; by far the largest table: memory is taken as rows are first
        # written, and it grows without a copy beside it until a call passes STATES by a fourth
        self.moves = np.zeros((max(4096, self.STATES * 5 // 4), 2 * self.COLUMNS), np.int32)
        self.start = self._number((self._guess(NONE, 0),))

    @staticmethod
    def _guess(last: int, node: int) -> int:
        return last + 1 << 24 | node

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand in turn at one edge while merges build ``token``, each with the rank that ends it."""
        found = self.edges.get((token, right))
        if found is None:
            parts, found = [self.bytes_of[token][i:i + 1] for i in range(len(self.bytes_of[token]))], []
            at = -1 if right else 0
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, UNMERGED), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == UNMERGED:
                    break
                if i == (len(parts) - 2 if right else 0):
                    found.append((parts[at], rank))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            # an empty list marks a token that the merges never build
            found = [*found, (parts[0], UNMERGED)] if len(parts) == 1 else []
            self.edges[token, right] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges keep a border between two tokens. Merges run by rank, the leftmost of equals first, so one
        crosses the border if its rank comes before those that replace the tokens at the border's sides."""
        a, b = self._edge(left, True) if left != NONE else [(b"", 0)], self._edge(right, False)
        return bool(a and b) and (left == NONE or not any(
            (rank := self.ranks.get(x + y)) is not None and rank < until and rank <= as_long
            for x, until in a for y, as_long in b))

    def _number(self, state: tuple[int, ...]) -> int:
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.states)
            self.states.append(state)
            size, token = 0, NONE
            for guess in state:
                node = guess & 0xFFFFFF
                own = self.token_at[node]
                if own == NONE:
                    continue
                pair = guess >> 24 << 24 | own
                if (ends := self.pairs.get(pair)) is None:
                    ends = self.pairs[pair] = self._apart((guess >> 24) - 1, own)
                if ends:
                    if size:
                        raise ValueError("these ranks do not give one encoding")
                    size, token = self.depth[node], own
            if at == len(self.closing):
                self.closing, self.closed = (np.concatenate((x, np.zeros_like(x))) for x in (self.closing, self.closed))
            if at == len(self.moves):
                self._widen(at + at // 4, self.moves.shape[1])
            self.closing[at], self.closed[at] = size, token
        return at

    def _widen(self, rows: int, columns: int) -> None:
        known, width = min(len(self.states), len(self.moves)), self.moves.shape[1]
        moves = np.zeros((rows, columns), np.int32)
        moves[:known, :width] = self.moves[:known]
        self.moves = moves

    def _moved(self, state: int, byte: int) -> int:
        """The next state, found in ``moves`` or made."""
        if (column := self.column[byte]) == NONE:
            column = self.column[byte] = self.column.max() + 1
            if column == self.moves.shape[1]:
                self._widen(len(self.moves), column + self.COLUMNS)
        if (after := int(self.moves[state, column]) - 1) == NONE:
            child = self.child
            guesses = [g >> 24 << 24 | below for g in self.states[state]
                       if (below := child.get((g & 0xFFFFFF) << 8 | byte)) is not None]
            if self.closing[state]:
                guesses.append(self._guess(int(self.closed[state]), child[byte]))
            after = self._number(tuple(guesses))
            self.moves[state, column] = after + 1
        return after

    def _fresh(self) -> None:
        if len(self.states) > self.STATES:
            self.reset()
        if len(self.pairs) > self.PAIRS:
            self.pairs.clear()

    def _tokens(self, states: list[int], start: int, end: int) -> list[int]:
        out = []
        while end > start:
            out.append(int(self.closed[states[end - 1]]))
            end -= int(self.closing[states[end - 1]])
        return out[::-1]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens as soon as they are settled."""
        self._fresh()
        state, met, settled = self.start, [], 0
        for byte in data:
            met.append(state := self._moved(state, byte))
            guesses = self.states[state]
            if len(guesses) == 1 and (begun := len(met) - self.depth[guesses[0] & 0xFFFFFF]) > settled:
                yield self._tokens(met, settled, begun)
                settled = begun
        yield self._tokens(met, settled, len(met))

    def encode(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of each stretch, as the bytes of int32. Short stretches are run together, byte by byte."""
        out: list[bytes] = [b""] * len(stretches)
        short = []
        for i, data in enumerate(stretches):
            if (token := self.ranks.get(data)) is not None:
                out[i] = token.to_bytes(4, "little")
            elif len(data) <= self.ROW:
                short.append(i)
            else:
                out[i] = np.array([t for part in self.stream(data) for t in part], "<i4").tobytes()
        for a in range(0, len(short), 20_000):
            own = sorted(short[a:a + 20_000], key=lambda i: -len(stretches[i]))
            for i, ids in zip(own, self._together([stretches[i] for i in own]), strict=True):
                out[i] = ids
        return out

    def _together(self, stretches: list[bytes]) -> list[bytes]:
        """``stretches`` by falling length."""
        self._fresh()
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        grid = np.zeros((len(stretches), sizes[0]), np.uint8)
        grid[np.arange(sizes[0]) < sizes[:, None]] = np.frombuffer(b"".join(stretches), np.uint8)
        met = np.zeros((sizes[0], len(stretches)), np.int32)
        state = np.full(len(stretches), self.start, np.int32)
        for j in range(sizes[0]):
            on = int(np.searchsorted(-sizes, -j, side="left"))  # those longer than j
            state, byte = state[:on], grid[:on, j]
            column = self.column[byte]
            after = np.where(column == NONE, NONE, self.moves[state, np.maximum(column, 0)] - 1)
            new = np.flatnonzero(after == NONE)
            if len(new):
                pairs, back = np.unique(state[new].astype(np.int64) << 8 | byte[new], return_inverse=True)
                after[new] = np.array([self._moved(p >> 8, p & 255) for p in pairs.tolist()], np.int32)[back]
            met[j, :on] = state = after
        ends, rows, columns = sizes.copy(), [], []
        while len(live := np.flatnonzero(ends)):
            at = met[ends[live] - 1, live]
            rows.append(live)
            columns.append(self.closed[at])
            ends[live] -= self.closing[at]
        row, token = np.concatenate(rows)[::-1], np.concatenate(columns)[::-1]
        order = np.argsort(row, kind="stable")
        data = token[order].astype("<i4").tobytes()
        cuts = (4 * ends_of(np.bincount(row, minlength=len(stretches)))).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _utf8_table() -> np.ndarray:
    """next[state, byte]: 0 between characters; 1, 2, 3 continuation bytes to come; 4 to 7 after E0, ED, F0, F4,
    whose next byte has a narrower range; 8 is an error."""
    table = np.full((9, 256), 8, np.uint8)
    table[0, :0x80] = 0
    table[0, 0xC2:0xE0], table[0, 0xE1:0xF0], table[0, 0xF1:0xF4] = 1, 2, 3
    table[0, [0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    table[1, 0x80:0xC0], table[2, 0x80:0xC0], table[3, 0x80:0xC0] = 0, 1, 2
    table[4, 0xA0:0xC0], table[5, 0x80:0xA0], table[6, 0x90:0xC0], table[7, 0x80:0x90] = 1, 1, 2, 2
    return table


class Decoder:
    """Ids to bytes, and to text as they come in.

    ``effect[state, token]`` is where the UTF-8 machine stands after a token's bytes; most tokens hold whole
    characters and leave it where it was, so a run of those needs no steps.
    """

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = ends_of(self.sizes)[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        table, self.effect = _utf8_table(), np.tile(np.arange(9, dtype=np.uint8)[:, None], size)
        for depth in range(int(self.sizes.max())):
            own = np.flatnonzero(self.sizes > depth)
            self.effect[:, own] = table[self.effect[:, own], self.bytes[self.starts[own] + depth]]
        self.whole = self.effect[0] == 0

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``."""
        return gather(self.bytes, self.starts[ids], self.sizes[ids])

    def sound(self, ids: np.ndarray) -> bool:
        """Whether the ids spell whole characters; only tokens that do not are stepped through."""
        broken = np.flatnonzero(~self.whole[ids])
        state, after = 0, -1
        for at in broken.tolist():
            if state and at != after:
                return False  # a whole token came in the middle of a character
            state, after = int(self.effect[state, ids[at]]), at + 1
            if state == 8:
                return False
        return state == 0

    def stream(self, parts) -> Iterator[str]:
        """Text of each part of ids as soon as its characters are complete; broken bytes become U+FFFD."""
        held, state = b"", 0
        for ids in parts:
            data = held + self.decode(np.asarray(ids, np.int64)).tobytes()
            for i in np.asarray(ids, np.int64).tolist():
                state = int(self.effect[state, i])
            if state == 0:
                held = b""
            elif state == 8:  # look again from the last byte that can begin a character
                tail = next((n for n in range(1, min(4, len(data)) + 1) if data[-n] >= 0xC0), 0)
                table, state = _utf8_table(), 0
                for byte in data[len(data) - tail:] if tail else b"":
                    state = int(table[state, byte])
                if state in (0, 8):
                    tail, state = 0, 0
                data, held = data[:len(data) - tail], data[len(data) - tail:]
            else:
                tail = next(n for n in range(1, 5) if data[-n] >= 0xC0)
                data, held = data[:-tail], data[-tail:]
            yield data.decode("utf-8", "replace")
        if held:
            yield held.decode("utf-8", "replace")


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.pattern = regex.compile(pattern)
        self.stretches = Memo(self.transducer.encode, 60_000)
        self.memo = Memo(self._pieces, 60_000)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        cut = [[s.encode("utf-8", "surrogatepass") for s in self.pattern.findall(p)] for p in pieces]
        known = dict(zip(all_ := list({s for c in cut for s in c}), self.stretches.all(all_), strict=True))
        return [b"".join([known[s] for s in c]) for c in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self._pieces([text])[0], "<i4").tolist()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        pieces = Pieces(texts, lead=True)
        odd = np.array([not (p := d.removeprefix(" ")) or p[0].isspace() or p[-1].isspace() for d in pieces.distinct])
        found = self.memo.all(pieces.distinct)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = sizes[pieces.at]
        ids = gather(np.frombuffer(b"".join(found), np.int32), ends_of(sizes)[:-1][pieces.at], each)
        ends = ends_of(each)[pieces.bounds]
        if not odd.any():
            return ids, np.diff(ends)
        strange = np.add.reduceat(odd[pieces.at], pieces.bounds[:-1]) > 0
        rows = [np.array(self.encode(texts[i].as_py() or ""), np.int32) if s else ids[ends[i]:ends[i + 1]]
                for i, s in enumerate(strange.tolist())]
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))


def coders(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Of this worker process, for all its tasks of this operator."""
    def build():
        encoder = Encoder(path, pattern)
        return encoder, Decoder(encoder.ranks)

    return resident(("byte-level BPE", path, pattern), build)


def _runner(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(path, pattern)
        names = pa.array([str(i) for i in range(len(decoder.sizes))])
        for batch in batches:
            for rows in chunks(batch, "text", 3 << 20):
                ids, counts = encoder.encode_column(rows["text"])
                ends = ends_of(counts)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(ids))), " ")
                data = decoder.decode(ids)
                cuts = ends_of(decoder.sizes[ids])[ends]
                out = [rows["doc_id"], pa.array(counts),
                       pa.array([hashlib.sha256(s.as_buffer()).hexdigest() for s in joined]),
                       pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]),
                       pa.array([decoder.sound(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(out, COLUMNS[:len(out)])
    return run


COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_sound", "ids"]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them, whether these are sound UTF-8, and the ids."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_sound boolean"
    return rows.mapInArrow(_runner(ranks, pattern, with_ids), schema + ", ids array<int>" * with_ids)

"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end the encoding of that prefix, and it
is the one whose pairing with the last token of the shorter prefix survives the merges. Keeping that token for
each prefix gives the encoding by walking back from the end, makes an append continue where the piece
ended, and makes an edit redo only the prefixes from the edit on, until the kept tokens agree again.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from waymark.llm.common import list_array, map_batches, ranges, texts_of, tidy, with_fields

#: Pieces whose encoding a worker keeps in each of two generations; used pieces move to the younger one.
CACHE_PIECES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (lines of base64 and id)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PrefixBPE:
    """Encoder and decoder for one set of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        # finds all tokens that end at each byte in one pass
        self.ending = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (i, len(token)))
        self.ending.make_automaton()
        self._spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _merge(self, data: bytes, stop: int) -> list[bytes]:
        """Plain merging by rank until ``stop`` parts are left or nothing merges; only used on single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte, (-1, -1) if merges never make it."""
        if token not in self._splits:
            data = self.bytes_of[token]
            if len(data) == 1:
                self._splits[token] = None
            else:
                parts = self._merge(data, 2)
                known = [self.ranks.get(p) for p in parts]
                self._splits[token] = (known[0], known[1]) if len(parts) == 2 and None not in known else (-1, -1)
        return self._splits[token]

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(part, rank at which it is merged away) along one edge of the token's merge tree, smallest part first."""
        key = (token, right)
        if key not in self._spines:
            out, at, until = [], token, 1 << 60
            while True:
                out.append((at, until))
                split = self._split(at)
                if split is None or split[0] < 0:
                    break
                until, at = at, split[1] if right else split[0]
            self._spines[key] = out[::-1]
        return self._spines[key]

    def reachable(self, token: int) -> bool:
        split = self._split(token)
        return split is None or split[0] >= 0

    def pair_holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again: no merge crosses their border."""
        key = left << 20 | right
        if (known := self._pairs.get(key)) is not None:
            return known
        if not self.reachable(right):
            self._pairs[key] = False
            return False
        a, b = self._spine(left, True), self._spine(right, False)
        i = j = 0
        holds = True
        get, name = self.ranks.get, self.bytes_of
        while True:
            (x, gone_x), (y, gone_y) = a[i], b[j]
            crossing = get(name[x] + name[y])
            # at equal ranks the leftmost merge goes first
            if crossing is not None and crossing < gone_x and crossing <= gone_y:
                holds = False
                break
            if gone_x == gone_y == 1 << 60:
                break
            if gone_x <= gone_y:
                i += 1
                j += gone_x == gone_y
            else:
                j += 1
        if len(self._pairs) >= 4_000_000:
            self._pairs.clear()
        self._pairs[key] = holds
        return holds

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Completes ``last`` (the last token of each prefix, from length 1) for the prefixes of ``data``."""
        stop, done, pair_of = len(data) if upto is None else upto, len(last), self._pairs.get
        if done >= stop:
            return last
        for end, (token, length) in self.ending.iter(data.decode("latin-1"), max(0, done - self.longest), stop):
            if end < done:
                continue
            if end > done:
                break
            start = end + 1 - length
            if start:
                left = last[start - 1]
                holds = pair_of(left << 20 | token)
                if holds is None:
                    holds = self.pair_holds(left, token)
            else:
                holds = self.reachable(token)
            if holds:
                last.append(token)
                done += 1
        if done < stop:
            raise ValueError("a byte has no token")
        return last

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of ``data`` read back from its prefixes' last tokens."""
        out, end = [], len(data)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes_of[token])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.tokens(data, self.extend(data, [])) if data else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of many id lists at once (ids one after another, and how many each list has): a binary column."""
        if self._table is None:
            known = sorted(self.bytes_of)
            sizes = np.zeros(known[-1] + 1 if known else 1, np.int64)
            sizes[known] = [len(self.bytes_of[i]) for i in known]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self._table = np.frombuffer(b"".join(self.bytes_of[i] for i in known), np.uint8), starts, sizes
        data, starts, sizes = self._table
        lengths = sizes[ids]
        if len(ids) and not lengths.all():
            raise KeyError("an id has no token")
        out = data[ranges(starts[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


class Buffer:
    """A piece under edit: its bytes and each prefix's last token. Appends cost only the new bytes."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b"") -> None:
        self.bpe, self.data = bpe, data
        self.last = bpe.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes [start, end); returns how many prefixes were computed again.

        Prefixes before ``start`` stay. Behind the edit, once as many prefixes in a row as the longest token
        has bytes carry the tokens they had before, all later ones do too.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        last, same, redone = old[:start], 0, 0
        while len(last) < len(self.data):
            self.bpe.extend(self.data, last, len(last) + 1)
            redone += 1
            at = len(last) - 1
            same = same + 1 if at >= start + len(new) and old[at - shift] == last[-1] else 0
            if same >= self.bpe.longest:
                last += old[len(last) - shift :]
                break
        self.last = last
        return redone

    def ids(self) -> list[int]:
        return self.bpe.tokens(self.data, self.last)


class PieceCodec:
    """Texts to ids and back, by pieces; remembers the ids of frequent pieces."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        self.bpe = PrefixBPE(read_ranks(ranks_path))
        self.find = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            coded = self.bpe.encode_piece(piece.encode())
            ids = pack(f"<{len(coded)}i", *coded)
        if len(piece) <= 64:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        pieces = self.find(text)
        try:
            return b"".join(map(self.young.__getitem__, pieces))
        except KeyError:
            learn, out = self._learn, []
            for piece in pieces:
                ids = self.young.get(piece)
                out.append(learn(piece) if ids is None else ids)
            return b"".join(out)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> PieceCodec:
    """One codec for each worker process and vocabulary."""
    return PieceCodec(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` array<int>: the ids of every whole text, each match of ``pattern`` encoded separately.

    Null texts count as empty, and empty ones have no ids. Repeated rows are encoded each. A column
    named ``ids`` in ``df`` is replaced. ``ranks_path`` must be readable on every worker.
    """
    df = tidy(df, [text_col], ["ids"])
    schema = with_fields(df, "ids array<int>")

    def make():
        own = codec(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [own.encode(t) for t in texts_of(batch.column(text_col))]
            flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            return batch.append_column("ids", list_array(flat, np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))))

        return step

    return map_batches(df, make, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` binary: the bytes that the ids stand for; null lists give empty bytes.

    Ids outside the vocabulary raise. A column named ``decoded`` in ``df`` is replaced.
    """
    df = tidy(df, [ids_col], ["decoded"])
    schema = with_fields(df, "decoded binary")

    def make():
        own = codec(ranks_path, pattern).bpe

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = [x or () for x in batch.column(ids_col).to_pylist()]
            flat = np.asarray([i for x in lists for i in x], np.int64)
            if len(flat) and flat.min() < 0:
                raise KeyError("an id is below 0")
            return batch.append_column("decoded", own.decode_all(flat, np.asarray([len(x) for x in lists], np.int64)))

        return step

    return map_batches(df, make, schema)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: replaces the text by ``ids`` and ``decoded``.

    The same results as calling both, without sending the ids to the workers a second time.
    """
    df = tidy(df, [text_col], ["ids", "decoded"])
    rest = [c for c in df.columns if c != text_col]
    out = with_fields(df.select(*[f"`{c}`" for c in rest]), "ids array<int>, decoded binary")

    def make():
        own = codec(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [own.encode(t) for t in texts_of(batch.column(text_col))]
            lengths = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
            flat = np.frombuffer(b"".join(coded), "<i4")
            columns = [batch.column(c) for c in rest] + [list_array(pa.array(flat), lengths), own.bpe.decode_all(flat, lengths)]
            return pa.RecordBatch.from_arrays(columns, [*rest, "ids", "decoded"])

        return step

    return map_batches(df.select(*[f"`{c}`" for c in rest], f"`{text_col}`"), make, out)

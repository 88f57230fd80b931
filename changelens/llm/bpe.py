"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes there is exactly one token that its encoding ends in. That token is stored.
A token ending at position ``e`` is the right one if it may follow the stored token of the prefix before it, and
two tokens may follow each other if merging their joined bytes gives these two again. The encoding is read
backwards from the stored tokens; bytes appended later only add entries, and nothing before them changes.

Texts are split by the vocabulary's pattern first. A single blank between two other characters always starts a
new match, so a text is cut there and the encoding of each such chunk is remembered (the memory is bounded).
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Sequence
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces, chunks and pairs of tokens remembered by one Python worker, about 200 bytes each. A piece costs most.
PIECES, CHUNKS, PAIRS = 400_000, 250_000, 200_000
#: Longer chunks are not remembered.
LONG = 64
_CUT = re.compile(r"(?<=\S)(?= \S)")


def make_room(memory: dict, most: int) -> None:
    """Forget the older half of a full memory."""
    if len(memory) >= most:
        for key in list(islice(memory, most // 2 + 1)):
            del memory[key]


class PrefixEncoder:
    """Encodes bytes and texts by a table of token ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pattern = regex.compile(pattern)
        self._find = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._find.add_word(token.decode("latin-1"), (len(token), rank))
        self._find.make_automaton()
        self._follows: dict[int, bool] = {}
        self._size, self._place = np.zeros(max(self.token) + 1, np.int64), np.zeros(max(self.token) + 1, np.int64)
        self._size[list(self.token)] = list(map(len, self.token.values()))
        self._place[list(self.token)] = np.cumsum([0, *map(len, self.token.values())])[:-1]
        self._bytes = np.frombuffer(b"".join(self.token.values()), np.uint8)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._whole: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The encoding by its definition: join the adjacent pair of lowest rank until none (or ``stop``) is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if rank not in self._halves:
            parts = self.merged(self.token[rank], stop=2)
            self._halves[rank] = tuple(parts) if len(parts) == 2 else None
        return self._halves[rank]

    def _stands(self, rank: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if rank not in self._whole:
            self._whole[rank] = self.merged(self.token[rank]) == [rank]
        return self._whole[rank]

    def _border_holds(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before both sides are complete.

        Goes back in time: the side completed last is undone first, and the tokens then beside the border
        must not have a merge that comes before it. Of equal merges the left one comes first.
        """
        token, ranks, before = self.token, self.ranks, 1 << 62
        while True:
            joined = ranks.get(token[left] + token[right])
            if joined is not None and joined < before:
                return False
            on_left, on_right = self.halves(left), self.halves(right)
            if on_left and (not on_right or left > right):
                before, left = left, on_left[1]
            elif on_right:
                before, right = right + 1, on_right[0]
            else:
                return True

    def follows(self, before: int, rank: int) -> bool:
        """Whether the token may come right after ``before``, whose own place is right (-1: may be the first)."""
        make_room(self._follows, PAIRS)
        known = self._stands(rank) and (before < 0 or self._border_holds(before, rank))
        self._follows[before << 32 | rank] = known
        return known

    def extend(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """``data + more`` and its last tokens, from ``data`` and its own; earlier entries stay as they are."""
        old, known, follows = len(data), self._follows.get, self.follows
        back = max(0, old - self.longest + 1)
        data, last = data + more, last + [-1] * len(more)
        after = back + 1
        for end, (length, rank) in self._find.iter(data[back:].decode("latin-1")):
            end += after
            if last[end] < 0 and end > old:
                before = last[end - length]
                if before >= 0 or end == length:
                    right = known(before << 32 | rank)
                    if follows(before, rank) if right is None else right:
                        last[end] = rank
        return data, last

    def read_back(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        ids = []
        while end > 0:
            if last[end] < 0:
                raise ValueError("a byte has no token")
            ids.append(last[end])
            end -= len(self.token[last[end]])
        return ids[::-1]

    def encode_bytes(self, data: bytes) -> list[int]:
        """One piece; a piece that is itself a token stays whole."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.read_back(self.extend(b"", [-1], data)[1], len(data))

    def packed_chunk(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit numbers."""
        split, pieces = self._pattern.findall(chunk), self._pieces
        found = list(map(pieces.get, split))
        for i, piece in enumerate(split):
            if found[i] is None:
                found[i] = array("i", self.encode_bytes(piece.encode())).tobytes()
                if len(piece) <= LONG:
                    make_room(pieces, PIECES)
                    pieces[piece] = found[i]
        return b"".join(found)

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, without special tokens, as 32-bit numbers."""
        if not text:
            return b""
        parts = text.split(" ")
        # The first part stands for itself, every other one for a blank and itself.
        found = list(map(self._spaced.get, parts))
        found[0] = None
        for i in [i for i, ids in enumerate(found) if ids is None]:
            part = parts[i]
            if not part or part[0].isspace() or part[-1].isspace():
                # A blank beside other white space: cut only where both neighbours are none.
                found = map(self.packed_chunk, _CUT.split(text))
                break
            found[i] = self.packed_chunk(" " + part if i else part)
            if i and len(part) <= LONG:
                make_room(self._spaced, CHUNKS)
                self._spaced[part] = found[i]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without special tokens."""
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        # Each token's bytes are looked up in one table of all tokens, put one after another.
        lengths = self._size[ids]
        if ids.min() < 0 or lengths.min() == 0:
            raise ValueError("an id is no token")
        ends = np.cumsum(lengths)
        places = np.repeat(self._place[ids] - ends + lengths, lengths) + np.arange(ends[-1])
        return self._bytes[places].tobytes()


class EditableText:
    """An encoded text that can be appended to and edited; only chunks near a change are encoded again."""

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder, self.chunks = encoder, []
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(chunk for chunk, _ in self.chunks)

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(ids for _, ids in self.chunks), np.int32).tolist()

    def append(self, more: str) -> None:
        size = sum(len(chunk) for chunk, _ in self.chunks)
        self.replace(size, size, more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in the place of the characters from ``start`` to ``end``; how many chunks were encoded.

        A chunk's border depends on the two characters beside it, so the chunks that touch the edit and one on
        either side are cut and encoded anew; all others keep their ids.
        """
        at, first, stop, before = 0, None, len(self.chunks), 0
        for i, (chunk, _) in enumerate(self.chunks):
            if first is None and at + len(chunk) >= start:
                first, before = max(0, i - 1), at - (len(self.chunks[i - 1][0]) if i else 0)
            if at > end:
                stop = min(len(self.chunks), i + 1)
                break
            at += len(chunk)
        first = len(self.chunks) if first is None else first
        middle = "".join(chunk for chunk, _ in self.chunks[first:stop])
        middle = middle[: start - before] + new + middle[end - before :]
        cut = [chunk for chunk in _CUT.split(middle) if chunk]
        self.chunks[first:stop] = [(chunk, self.encoder.packed_chunk(chunk)) for chunk in cut]
        return len(cut)


@functools.lru_cache(maxsize=4)
def encoder(path: str = RANKS) -> PrefixEncoder:
    """The encoder of a rank file, made once per Python worker. The file must be at this path on each machine."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return PrefixEncoder(ranks)


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(text: Column, path: str = RANKS) -> Column:
    """array<int> of token ids; NULL and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode_text = encoder(path).packed
        return _lists([encode_text(value.as_py() or "") for value in texts])

    return ids(text)


def decode(ids: Column, path: str = RANKS) -> Column:
    """binary: the bytes of the ids; NULL gives NULL."""

    @F.arrow_udf("binary")
    def decoded(arrays: pa.Array) -> pa.Array:
        decode_ids = encoder(path).decode
        return pa.array([None if not row.is_valid else decode_ids(row.values.to_numpy()) for row in arrays], pa.binary())

    return decoded(ids)


def round_trip(text: Column, path: str = RANKS) -> Column:
    """struct(ids, decoded) in one go: each text is encoded once, and its ids are decoded where they are."""

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        known = encoder(path)
        ids = [known.packed(value.as_py() or "") for value in texts]
        decoded = pa.array([known.decode(np.frombuffer(x, np.int32)) for x in ids], pa.binary())
        return pa.StructArray.from_arrays([_lists(ids), decoded], ["ids", "decoded"])

    return both(text)


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: the id, ``ids`` (array<int>) and ``decoded`` (binary).

    Only the id and the text are read, so other columns may have any name. NULL and empty texts have no ids and
    decode to no bytes; a repeated row appears as often as it is given; an empty table gives no rows. Texts of any
    length are encoded whole: time grows with the length, memory holds one entry per byte of the longest piece.
    """
    return docs.select(id_column, round_trip(F.col(text_column), path).alias("both")).select(id_column, "both.*")

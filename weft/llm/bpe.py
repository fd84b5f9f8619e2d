"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can stand last in a valid encoding. That token is
kept per prefix: the encoding is read off backwards, an append only fills new prefixes, and an
edit refills from its place until the old and new tables agree again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, slices, small_batches

#: Pieces kept encoded in a worker; the memory this takes is fixed.
CACHE_PIECES = 200_000
CACHE_PAIRS = 300_000
#: Longer pieces are encoded but not kept.
CACHE_PIECE_CHARS = 64


class Vocabulary:
    """Ranks of byte strings, with the merge that forms each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.sizes = {rank: len(word) for word, rank in ranks.items()}
        #: States of an automaton over the tokens: what is read last and begins a token, numbered
        #: when it is first met. State 0 has read nothing that counts.
        self.begins = {word[:i] for word in ranks for i in range(len(word) + 1)} | {b""}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.names = [b""]
        self.steps: dict[int, int] = {}
        #: The tokens that merging reaches and that end in each state, longest first, with their lengths.
        self.tails: list[tuple[tuple[int, int], ...]] = [()]

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None for a byte or a token no merge reaches."""
        if token not in self._halves:
            word = self.tokens[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                made = [(self.ranks.get(x + y, token), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(made)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            reached = len(parts) == 2
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if reached else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def step(self, key: int) -> int:
        """The state after ``key``, which is a state and a byte; kept in ``steps``, of a fixed size at most."""
        name = self.names[key >> 8] + bytes((key & 255,))
        while name not in self.begins:
            name = name[1:]
        if name not in self.numbers:
            self.numbers[name] = len(self.names)
            self.names.append(name)
            found = ((len(name) - i, self.ranks.get(name[i:])) for i in range(len(name)))
            self.tails.append(tuple((n, t) for n, t in found if t is not None and self.reachable(t)))
        self.steps[key] = self.numbers[name]
        return self.numbers[name]

    def state(self, data: bytes) -> int:
        """The state after ``data``; no more than its last ``longest`` bytes matter."""
        state = 0
        for byte in data[-self.longest :]:
            key = state << 8 | byte
            state = self.steps[key] if key in self.steps else self.step(key)
        return state

    def joins(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` apart where they meet.

        The later-formed of the two tokens is undone step by step. If at any moment the two
        that touch form a token of a lower rank than what was undone, merging would have
        crossed the border first.
        """
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        limit = float("inf")  # a merge across the border wins if its rank is under this
        tokens, ranks = self.tokens, self.ranks
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            undo_left, undo_right = self.halves(left), self.halves(right)
            if undo_left and (not undo_right or left > right):
                # of equal ranks the leftmost merge comes first, so the left token's own merge
                # wins a tie against the border
                limit, left = left, undo_left[1]
            elif undo_right:
                limit, right = right + 1, undo_right[0]
            else:
                return True


class Prefixes:
    """The last token of each prefix of a byte string, kept open for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.state = vocabulary, b"", [-1], 0
        self.append(data)

    def _fill(self, begin: int, stop: int) -> None:
        """Find the last token of the prefixes from ``begin`` to ``stop`` bytes."""
        data, last, v, state = self.data, self.last, self.vocabulary, self.state
        steps, tails, pairs = v.steps, v.tails, v.pairs
        for end in range(begin, stop + 1):
            key = state << 8 | data[end - 1]
            state = steps.get(key)
            if state is None:
                state = v.step(key)
            for size, token in tails[state]:
                if size == end:
                    break
                fit = pairs.get(last[end - size] << 32 | token)
                if fit or fit is None and v.joins(last[end - size], token):
                    break
            else:
                raise ValueError(f"no token for the byte {data[end - 1 : end]!r}")
            last.append(token)
        self.state = state

    def append(self, more: bytes) -> None:
        """Extend the string; nothing that is stored changes."""
        begin = len(self.data)
        self.data += more
        self._fill(begin + 1, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were computed anew.

        A prefix's token depends on the ``longest`` positions before it only, so once that many
        in a row equal the old ones, the rest of the old table is taken over.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        self.state = self.vocabulary.state(self.data[max(0, start - self.vocabulary.longest) : start])
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self._fill(end, end)
            past = end - len(new) > start
            same = same + 1 if past and old[end - shift] == self.last[end] else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                self.state = self.vocabulary.state(self.data[-self.vocabulary.longest :])
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end, sizes = [], len(self.data), self.vocabulary.sizes
        while end:
            token = self.last[end]
            out.append(token)
            end -= sizes[token]
        return out[::-1]


class Encoder:
    """Encodes and decodes texts: each match of ``pattern`` on its own, without special tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        #: Encoded pieces: those used of late, and those used before them.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.vocabulary.ranks.get(data)
            ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).ids()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self.kept) >= CACHE_PIECES // 2:
                self.older = self.kept.copy()
                self.kept.clear()
            self.kept[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        kept, piece = self.kept.get, self.piece
        return b"".join([kept(p) or piece(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.from_file(path), pattern)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text and decode it again.

    One row per input row: id, ids (binary, little-endian unsigned 32-bit), n_tokens, ids_sha256,
    decoded_sha256. ``path`` is a rank file that every executor has, ``pattern`` the split.

    Defined cases: null and empty texts give no tokens and the hash of nothing; texts of any
    length are encoded in time linear in their length; repeated rows and ties are encoded alike;
    an empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for part in slices(batches, 1):
            packed = [own.encode(t) if t else b"" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(packed, pa.binary()),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in packed]),
                ],
                names=["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = source.mapInArrow(lean(run), f"id {id_type}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

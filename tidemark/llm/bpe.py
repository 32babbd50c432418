"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over characters
finds, in one pass, the longest vocabulary entry that starts at each byte of a
piece. Encoding then walks from longest match to longest match and backtracks
where two neighbours cannot stand side by side: two tokens are compatible when
merging their joined bytes by rank gives the same two tokens again. Such a
sequence is unique, so the result equals the merges by rank, while the walk is
linear in the piece. Compatibilities are memoised by token pair.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_arrow, per_task

#: Pieces and token pairs held in a task's memos before they are emptied, and the longest piece held.
MEMO_PIECES, MEMO_PAIRS, MEMO_CHARS = 400_000, 1_000_000, 48


def load_ranks(path: str) -> bytes:
    """The rank file's bytes; the driver reads it and the tasks parse it."""
    with open(path, "rb") as f:
        return f.read()


def merge_by_rank(data: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """Plain merging: join the neighbours of lowest rank, leftmost first.

    With ``whole=False`` the merge that would leave one token is not done.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1 + (not whole):
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Memo(dict):
    """A dict that makes missing values and is emptied at a size."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Codec:
    """Encodes and decodes with one rank file and one split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        rows = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.len_of = {rank: len(token) for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter, len(self.ranks))
        self.halves = Memo(self._halves, len(self.ranks))
        self.pairs = Memo(self._stand, MEMO_PAIRS)
        self.memo = Memo(self._encode, MEMO_PIECES)

    def _shorter(self, token: int) -> int | None:
        """The longest other token that is a prefix of ``token``."""
        data = self.bytes_of[token]
        ends = (self.ranks.get(data[:n]) for n in range(len(data) - 1, 0, -1))
        return next((x for x in ends if x is not None), None)

    def _halves(self, token: int) -> list[int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        data = self.bytes_of[token]
        return merge_by_rank(data, self.ranks, whole=False) if len(data) > 1 else None

    def _stand(self, pair: tuple[int, int]) -> bool:
        """Whether merging by rank leaves the border between two tokens alone.

        Undo the merges that made the two, the latest first. Should the tokens
        that then touch the border merge earlier than the merge undone last,
        the border would have gone.
        """
        left, right = pair
        bytes_of, ranks, halves = self.bytes_of, self.ranks, self.halves
        limit = len(ranks) + 1
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[-1]
            else:  # of equal ranks the left one was merged first
                limit, right = right + 1, b[0]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, pairs = data.decode("latin-1"), self.pairs
        out = [rank for _, rank in self.automaton.iter_long(text)]
        for n, pair in enumerate(zip(out, out[1:]), 1):
            if not pairs[pair]:
                break
        else:
            return out  # longest matches all the way
        len_of, shorter, size = self.len_of, self.shorter, len(data)
        longest = [0] * size
        for end, rank in self.automaton.iter(text):
            longest[end - len_of[rank] + 1] = rank  # later ends are longer
        open_ = bytearray(b"\x01") * (size + 1)
        token = out[n]
        del out[n:]
        at = sum([len_of[x] for x in out])
        while True:
            end = at + len_of[token]
            if open_[end] and (not out or pairs[out[-1], token]):
                out.append(token)
                if end == size:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token is None:  # no way on from here: never come back to it
                open_[at] = 0
                token = out.pop()
                at -= len_of[token]
                token = shorter[token]

    def _encode(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, in the same form; only short pieces are memoised."""
        memo = self.memo
        return b"".join([memo[x] if len(x) <= MEMO_CHARS else self._encode(x) for x in self.split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id_col, n_tokens, ids_sha256 and decoded_sha256, and with
    ``ids=True`` also token_ids, an array. Null texts count as empty: no
    tokens and the digests of no bytes. Special tokens' strings are ordinary
    text. Repeated rows are encoded each; other columns of ``docs`` are left
    out, so none can clash. An empty table gives an empty result. Nothing is
    shuffled; a task holds one batch, and memos of bounded size.
    """
    rank_file = load_ranks(rank_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        codec = Codec(rank_file, pattern)

        def step(t: pa.Table) -> pa.Table:
            rows = [codec.encode_bytes(x or "") for x in t.column(1).to_pylist()]
            columns = {
                id_col: t.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in rows], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in rows],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in rows],
            }
            if ids:
                columns["token_ids"] = pa.array([np.frombuffer(x, "<u4").astype("i4") for x in rows], pa.list_(pa.int32()))
            return pa.table(columns)

        return step

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return map_arrow(docs.select(id_col, text_col), per_task(make), schema)

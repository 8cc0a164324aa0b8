"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Merging bytes pair by pair is quadratic in the length of a piece. Here an Aho-Corasick
automaton over the vocabulary (bytes mapped to Latin-1 characters) gives the longest token
that starts at every byte in one pass. The encoder takes the longest token, checks that it
can stand behind the previous one, and goes to the next shorter token, or one token back,
if it can not. Two adjacent tokens are compatible when no merge of lower rank would have
crossed the border between them; that test is memoised. A position that was left once is
marked and never tried again, so the work is linear in the length of the piece.

Cases: null and empty texts have no tokens. Texts of any length are encoded whole; a piece
that fits the pattern is never cut. Repeated rows give repeated results, an empty table an
empty one. Only the id and the text column are read, so other columns can not clash.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, text_of

#: Entries of a worker's memos; a full one is emptied. It bounds memory, not results.
MEMO = 200_000


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Vocabulary:
    """Tokens, the halves each was merged from, and the compatibility of neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for rank, token in self.tokens.items()}
        self.shorter = {rank: self._prefix_of(token) for rank, token in self.tokens.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.tokens):
            if self.size[rank] > 1:
                self._set_halves(rank)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def _prefix_of(self, token: bytes) -> int | None:
        for n in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:n])) is not None:
                return rank
        return None

    def _set_halves(self, rank: int) -> None:
        token, left = self.tokens[rank], self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[self.size[left] :])
            if right is not None and left < rank and right < rank and self.stands(left, right, rank):
                self.halves[rank] = left, right
                return
            left = self.shorter[left]

    def stands(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Would no merge of a rank below `limit` cross the border of the two tokens?

        The merges inside both are undone from the last to the first; before each of them
        the two parts that touch the border must not have had an earlier merge of their own.
        """
        tokens, halves = self.tokens, self.halves
        while True:
            across = self.ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            if left in halves and (left > right or right not in halves):
                limit, left = left, halves[left][1]
            elif right in halves:
                limit, right = right + 1, halves[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        pair = left, right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            known = self._pairs[pair] = self.stands(left, right)
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest = [0] * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the last one written is the longest
        size, shorter, compatible = self.size, self.shorter, self.compatible
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            before = out[-1] if out else None
            while True:
                end = at + size[token]
                if open_[end] and (before is None or compatible(before, token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return tuple(out)
                    token = longest[at]
                    break
                less = shorter[token]
                if less is None:
                    open_[at] = 0
                    out.pop()
                    at -= size[before]
                    token = before
                    break
                token = less


class Codec:
    """Text to ids and back; made once in each Python worker."""

    def __init__(self, raw: bytes, pattern: str):
        vocabulary = Vocabulary(parse_ranks(raw))
        self._split = regex.compile(pattern).findall
        self._bytes = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens, default=-1) + 1)]
        self._words = [str(i) for i in range(len(self._bytes))]

        once: set[str] = set()

        class Memo(dict):
            def __missing__(memo, piece: str) -> tuple[int, ...]:
                ids = vocabulary.encode_piece(piece.encode("utf-8"))
                if piece in once:  # most pieces of a corpus occur once, only the others are worth a place
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
                elif len(piece) <= 64:
                    if len(once) >= MEMO:
                        once.clear()
                    once.add(piece)
                return ids

        self._memo = Memo()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._memo.__getitem__, self._split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def spelled(self, ids) -> str:
        return " ".join(map(self._words.__getitem__, ids))


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    key = hash(raw), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        own = codec(raw.value, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, offsets = [], [0]
            for text in batch.column("text").to_pylist():
                found = np.array(own.encode(text), np.int32)
                ids.append(found)
                offsets.append(offsets[-1] + len(found))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

        return each

    return arrow_rows(_source(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of every list of ids; a null list gives no bytes."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        own = codec(raw.value, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            decoded = [own.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

        return each

    return arrow_rows(encoded.select("doc_id", "ids"), make, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, decodes its ids again, and returns the digests of both in one
    pass; on demand the ids as well."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def make():
        own = codec(raw.value, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, decoded_sha, flat = [], [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py())
                counts.append(len(ids))
                if with_ids:
                    flat.append(np.array(ids, np.int32))
                ids_sha.append(sha(own.spelled(ids).encode()))
                decoded_sha.append(sha(own.decode(ids)))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat), pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return arrow_rows(_source(docs, id_col, text_col), make, schema)

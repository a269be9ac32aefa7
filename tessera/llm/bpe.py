"""Byte-level BPE as a tree reduction.

A text is halved until its parts are short, the parts are encoded by the library, and neighbours
are joined: only a window around the seam is encoded again, and it grows until the tokens outside
it are proven to be those of the joined text.

Two proofs are used.  Between texts: at some character pairs (a visible character before white
space, a letter before a digit, ...) every match of the splitting pattern ends whatever surrounds
them, so text on either side is encoded independently.  Inside one long match without such a pair:
a token sequence is the encoding of its bytes exactly when every two neighbouring tokens are the
encoding of theirs, for the first merge that could cross a boundary sees only these two.  So the
tokens outside the window stand once the two pairs at its edges do.  Decoding concatenates halves
up the same tree.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import slices
from tessera.llm.tokens import ranks, vocabulary_file

#: Characters of a leaf: nearly every document is a tree.
LEAF = 512
WINDOW = 64
#: A seam without a proven cut this near goes to the tree over one match's bytes.
FAR = 4_096
PIECE = 1_024


def _kind(c: str) -> int:
    return 1 if c.isalpha() else 2 if c.isdigit() else 3


def certain(text: str, p: int) -> bool:
    """Whether every split of every text with these two characters has a boundary at ``p``."""
    x, y = text[p - 1], text[p]
    if y in " \t\n\r":
        return x > " " and not x.isspace()
    if not (x.isascii() and y.isascii()) or x <= " " or y <= " " or "\x7f" in (x, y):
        return False
    return _kind(x) != _kind(y) and x != "'"


class TreeCodec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW, piece: int = PIECE) -> None:
        table = ranks(path)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {i: b for b, i in table.items()}
        self.pattern = regex.compile(pattern)
        self.leaf, self.window, self.piece = leaf, window, piece

    # -- encoding -------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``: those of ``encode_ordinary`` of the library."""
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self._leaf(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._tree(text, a, mid), self._tree(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        if certain(text, mid):
            return left + right
        lo, hi, reach = mid, mid, self.window
        while lo > a and not certain(text, lo) or hi < b and not certain(text, hi) or lo == hi:
            lo = next((p for p in range(mid - 1, max(a, mid - reach), -1) if certain(text, p)), max(a, mid - reach))
            hi = next((p for p in range(mid + 1, min(b, mid + reach)) if certain(text, p)), min(b, mid + reach))
            reach *= 2
        drop_l, drop_r = len(self._leaf(text[lo:mid])), len(self._leaf(text[mid:hi]))
        return left[: len(left) - drop_l] + self._leaf(text[lo:hi]) + right[drop_r:]

    def _leaf(self, text: str) -> list[int]:
        if len(text) <= FAR or regex.search(r"[^\s\p{L}\p{N}]{%d}|\p{L}{%d}|\p{N}{%d}|\s{%d}" % ((self.piece,) * 4), text) is None:
            return self.library.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.encode_piece(m[0].encode())
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern, by halves of its bytes."""
        if len(piece) <= self.piece:
            return self.library._encode_single_piece(piece) if len(piece) > 1 else [self.library.encode_single_token(piece)]
        half = len(piece) // 2
        return self._join_piece(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def _stands(self, x: int, y: int) -> bool:
        return self.library._encode_single_piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            mid = self.library._encode_single_piece(self.decode(left[i:] + right[:j]))
            if (i == 0 or self._stands(left[i - 1], mid[0])) and (j == len(right) or self._stands(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            k *= 2

    # -- decoding -------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``, concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TreeCodec:
    """One codec for each worker process."""
    return TreeCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row; a null text is empty and has no ids."""

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches):
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    chosen = docs.select(F.col(id_col), F.col(text))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(id, text binary)`` of the bytes that the ids stand for; a null list gives null."""

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches):
            out = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "text"])

    chosen = coded.select(F.col(id_col), F.col(ids))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, text binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Each row is a document of its own, repeated ids and rows included; a null text counts as empty
    and has no ids.  Texts of any length are encoded whole, in memory in proportion to one text.
    Extra columns are ignored, whatever their names; no rows give no rows.
    """
    import public_tokenizers

    path, pattern = path or vocabulary_file("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches):
            n, coded, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col), F.col(text))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

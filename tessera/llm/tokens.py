"""Tokenizer files, and fast exact encoding of whole texts.

``Encoder`` gives the ids of the tokenizers library.  For texts of common characters it applies the
file's own merges with the merge engine of tiktoken, several times faster; every other text, and
each that holds a string of an added token (``<|endoftext|>``), goes to the library itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

#: Distinct chunks kept in a worker's memo.
MEMO = 400_000
#: Characters on which the library's normaliser and both regex engines plainly agree: printable ASCII, tab and line
#: ends, and Latin letters to U+017F but for the capital dotted I, ordinal marks, superscripts and fractions.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-įı-ž]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Stands for the end of a word; no byte of UTF-8.
_END = b"\xff"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """chunk -> bytes of its ids, computed on first sight."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = self.make(chunk)
        return found


class Encoder:
    """Whole texts to the ids of a ``tokenizers`` file of byte-level BPE, with or without word ends.

    Strings of special tokens get the ids that the library gives them.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.folded = [t.content.lower() for t in added if t.normalized]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, chars = model["end_of_word_suffix"] or "", _byte_of_char()

        def raw(token: str) -> bytes:
            ends = bool(suffix) and token.endswith(suffix)
            body = bytes(chars[c] for c in (token[: -len(suffix)] if ends else token))
            return body + _END if ends else body

        # single bytes first, then those that end a word, then the merges in their order
        order = [bytes([b]) for b in range(256)] + ([bytes([b]) + _END for b in range(256)] if suffix else [])
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in chars for c in t.removesuffix(suffix))}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            order.append(raw(a) + raw(b))
        table = {t: r for r, t in enumerate(dict.fromkeys(order))}
        self.engine = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.id_of = np.array([ids.get(t, 0) for t in table], self.kind)
        self.chunks = _Chunks(self._chunk) if suffix else None

    def _chunk(self, chunk: str) -> bytes:
        ranks_: list[int] = []
        for word in _WORDS.findall(chunk.lower()):
            ranks_ += self.engine._encode_single_piece(word.encode() + _END)
        return self.id_of[ranks_].tobytes() if ranks_ else b""

    def one(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) is None or any(t in text for t in self.added) or self.folded and any(t in text.lower() for t in self.folded):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        if self.chunks is None:
            return self.id_of[self.engine.encode_to_numpy(text, disallowed_special=())]
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.split(" "))), self.kind)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (a null is empty) as an array of ``kind``."""
        return [self.one(t or "") for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """A rank file: token bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary_file(name: str) -> str:
    """The installed file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)

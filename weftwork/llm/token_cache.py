"""Whole texts to the ids of a public tokenizer file, by way of a cache of their words.

For a tokenizer that drops white space and splits at it before anything else, the ids
of a text are those of its space-separated pieces, one after the other. The ids of a
piece still come from the tokenizers library; the caches only spare it what it has
encoded already. A new piece of plain Latin text is split into the words that the file's
pattern finds, and new words go straight to the library's BPE model, without its
normalizers; any other piece takes the library's whole path. Texts that may hold the
string of an added token go through the library whole, which gives such a string the
token's id; and so do all texts with tokenizers of any other make.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import regex

ID = np.dtype("<u4")
#: Below it no character composes with another or changes by its neighbours when lowered.
LATIN_END = "\u0180"


def byte_chars() -> dict[int, int]:
    """Byte-level BPE's characters for bytes: printable Latin-1 is itself, the rest follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


class Encoder(dict):
    """encode(text): the little-endian unsigned 32-bit ids as bytes. As a dict: piece to bytes."""

    def __init__(self, path: str, most: int = 900_000) -> None:
        """most: pieces kept; further ones are encoded each time they occur."""
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # the strings of added tokens are found before a text is split, even within its pieces
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = [x] if (x := os.path.commonprefix(added)) and not any(map(str.isalpha, x)) else added
        self.by_piece = splits_at_spaces(path)
        if self.by_piece:
            self.words: dict[str, bytes] = {}
            self.find = regex.compile(pattern_of(path)).findall

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece.isprintable() and (piece.isascii() or max(piece) < LATIN_END):
            found = b"".join(map(self.word, self.find(piece.lower())))
        else:
            found = self.ids(piece)
        if len(self) < self.most and len(piece) < 64:
            self[piece] = found
        return found

    def word(self, word: str) -> bytes:
        """The ids of one lower-case word as the file's splitter finds it."""
        found = self.words.get(word)
        if found is None:
            as_bytes = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
            found = np.asarray([t.id for t in self.tokenizer.model.tokenize(as_bytes)], ID).tobytes()
            if len(self.words) < self.most and len(word) < 64:
                self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(x in text for x in self.marks):
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def first_splitter(made: dict) -> dict:
    steps = made.get("pre_tokenizer") or {}
    return (steps.get("pretokenizers") or [steps])[0]


def pattern_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return first_splitter(json.load(f))["pattern"]["Regex"]


def splits_at_spaces(path: str) -> bool:
    """Whether the file's tokenizer is known to drop white space before it does anything
    that could join pieces: its first splitter keeps only runs without white space."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    first, steps = first_splitter(made), made.get("pre_tokenizer") or {}
    known = {"NFC", "Replace", "Lowercase"}
    normal = made.get("normalizer") or {}
    normal = normal.get("normalizers", [normal] if normal else [])
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and first.get("pattern", {}).get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
        and [x.get("type") for x in steps.get("pretokenizers", [])[1:]] == ["ByteLevel"]
        and all(x.get("type") in known for x in normal)
        and not made.get("post_processor")
        and made["model"].get("type") == "BPE" and not made["model"].get("continuing_subword_prefix")
    )


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process and file; workers keep it from task to task."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

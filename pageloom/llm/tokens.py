"""Whole texts to token ids, remembering the ids of words already seen.

Texts in Latin script are cut into the same pieces as the tokenizer's own rule
makes (see RULES), and a piece that is new to the worker goes through the
tokenizer's model once.  Any other text, and one that spells an added token such as
an end mark, is encoded by the library in one call, so no rule here has to know the
letters of other scripts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

# Letters and numbers below U+0250, and the cut rules over them.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
RULES = {
    "word": re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^ \t-\r{LETTERS}{NUMBERS}]+"),
    "byte": re.compile(f"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^ \t-\r{LETTERS}{NUMBERS}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"),
}
#: White space beyond ASCII, a capital that lower-cases to two characters, and other scripts.
OTHER = re.compile("[^\x00-\x1b -\x84\x86-\x9f¡-įı-ɏ‐-‧€™]")
MOST_PIECES, LONGEST_PIECE = 500_000, 48

_loaded: dict = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level models."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Pieces(dict):
    """The ids of pieces; those of a new one are asked for, and kept unless it is long."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """texts -> ids as little-endian unsigned 32-bit integers.

    rule: "word" for a tokenizer that lower-cases and drops white space, "byte"
    for one that keeps every byte.
    """

    def __init__(self, path: str, rule: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.I).search
        self.model, self.known = self.tokenizer.model, Pieces(self._piece)
        self.cut, self.lower, self.letters = RULES[rule].findall, rule == "word", byte_letters()

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        spelt = piece.encode().decode("latin1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids_of, out, whole = self.known.__getitem__, [], {}
        for i, text in enumerate(texts):
            if OTHER.search(text) or self.added(text):
                whole[i] = text
                out.append(b"")
                continue
            out.append(b"".join(map(ids_of, self.cut(text.lower() if self.lower else text))))
        for i, ids in zip(whole, self._library(list(whole.values())), strict=True):
            out[i] = ids
        return out


def encoder(path: str, rule: str) -> Encoder:
    """One encoder per worker process and file; its memory is bounded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, rule) not in _loaded:
        _loaded[path, rule] = Encoder(path, rule)
    return _loaded[path, rule]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Encoding of whole texts by a vocabulary file of the tokenizers library, with a bounded cache of pieces.

The library splits a text into pieces before it merges; a piece's ids don't depend on the rest of the text. Texts
within Latin-1, where the split's character classes are stated below, are split here by one pattern; unseen pieces go
to the library's model, and their ids are kept as bytes. Every other text goes to the library whole, and so does
any that holds a special token's string, and every text where the file's own splitter isn't the one that the pattern stands for.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

# The classes \\p{L}, \\p{N} and \\s within Latin-1, and the split patterns of the two vocabulary files.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
BYTE_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
WORD_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"

# How a file names the two splitters that these patterns stand for.
BYTE_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ],
    },
}

MOST_BYTES = 240 << 20  # of cached pieces, about
ENTRY = 230  # bytes of an entry besides its text's


def splits_by(tokenizer, rules: dict) -> bool:
    """Whether a file normalizes and splits as `rules` say; how it trims offsets doesn't matter."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k != "trim_offsets"}
        return [plain(v) for v in x] if isinstance(x, list) else x

    spec = json.loads(tokenizer.to_str())
    return all(plain(spec[k]) == v for k, v in rules.items()) and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process, so that its cache serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Pieces(dict):
    """Ids of pieces as bytes; an unseen piece is merged by the library's model, spelled in the stand-ins of bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.size = 0
        self.tokenize = tokenizer.model.tokenize
        self.stand_ins = {b: c for c, b in byte_alphabet().items()}
        self.space = self.stand_ins[32]

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.stand_ins)
        self[piece] = ids = packed([x.id for x in self.tokenize(spelled)])
        self.size += ENTRY + len(piece) + len(ids)
        return ids


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known = splits_by(self.tokenizer, BYTE_RULES)
        self.split = re.compile(BYTE_SPLIT).findall
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)).search if special else lambda text: None
        self.pieces = Pieces(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.pieces.size > MOST_BYTES:
            self.pieces.clear()
            self.pieces.size = 0
        out: list[bytes | None] = [None] * len(texts)
        whole, ids = [], self.pieces.__getitem__
        for i, text in enumerate(texts):
            try:
                text.encode("latin-1")
                plain = self.known and not self.special(text)
            except UnicodeEncodeError:
                plain = False
            if plain:
                out[i] = b"".join(map(ids, self.split(text)))
            else:
                whole.append(i)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = packed(e.ids)
        return out

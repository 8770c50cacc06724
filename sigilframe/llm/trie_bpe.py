"""BPE encoding by a trie of distinct words, and decoding.

For a merge list, the encoding of a word is the only sequence of vocabulary items whose neighbours are all compatible: two
items are compatible if merging their joint symbols gives the same two again. Every prefix of that sequence is the
encoding of the prefix it spells. So a trie node needs its last item only: it is the one item that ends there, is compatible with the
last item of the node where it begins, and starts from a node with a state. Distinct words are inserted in sorted order,
which is a depth-first walk of the trie. The trie lives as long as its process, so the state of a prefix is computed once for all words that share it,
until it has MOST_NODES nodes and begins anew. Nodes deeper than DEPTH aren't kept, so a long run of letters without spaces, which is one word, takes time and memory in proportion to its length. A word's last symbol carries the end-of-word mark, so it is a leaf of its own, which isn't kept.

Words are split as the vocabulary file says: within Latin-1 by a stated pattern (where it stands for the file's own), else by the library's own
splitter; the merging is ours. Whole words' ids are kept in a cache of MOST_BYTES for each process. No shuffle: one pass over the documents.

Nulls and odd rows: a null or empty text has no ids, and decodes to the empty text; special tokens' strings become
their ids as in the library; doc_id is carried as it is; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows
from .wordbpe import ENTRY, WORD_RULES, WORD_SPLIT, byte_alphabet, load, packed, splits_by

MOST_NODES = 500_000
DEPTH = 64  # symbols of the deepest node that is kept
OFF = -1  # in place of a node that isn't
MOST_PAIRS = 1_000_000
MOST_BYTES = 260 << 20


class TrieBpe:
    """Merges of a vocabulary file with an end-of-word mark. A symbol is a code point: the byte, plus 256 at the word's end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], mark: str):
        self.alphabet = byte_alphabet()
        self.mark = mark
        spelled = {w: self.spell(w) for w in vocab if self.spellable(w)}
        self.ids = {s: vocab[w] for w, s in spelled.items()}
        self.shown = {s: w for w, s in spelled.items()}
        self.ranks = {(spelled[a], spelled[b]): i for i, (a, b) in enumerate(merges)}
        self.sound: dict[str, bool] = {}
        sizes: dict[str, set[int]] = {}
        for s in self.ids:
            sizes.setdefault(s[-1], set()).add(len(s))
        self.sizes = {c: sorted(n, reverse=True) for c, n in sizes.items()}  # lengths of the items that end in a symbol
        self.fit: dict[tuple[str, str], bool] = {}
        self.below: dict[int, int] = {}  # (node, symbol) to node; symbols take 9 bits
        self.state = [""]  # each node's last item

    def spellable(self, token: str) -> bool:
        return all(c in self.alphabet for c in token.removesuffix(self.mark)) and token.removesuffix(self.mark) != ""

    def spell(self, token: str) -> str:
        s = [self.alphabet[c] for c in token.removesuffix(self.mark)]
        if token.endswith(self.mark) and token != self.mark:
            s[-1] += 256
        return "".join(map(chr, s))

    def merged(self, symbols: str) -> list[str]:
        """Plain merging, lowest rank first, leftmost first; only for pairs of items."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if (a, b) not in self.fit:
            if len(self.fit) > MOST_PAIRS:
                self.fit.clear()
            self.fit[a, b] = self.merged(a + b) == [a, b]
        return self.fit[a, b]

    def reachable(self, item: str) -> bool:
        if item not in self.sound:
            self.sound[item] = item in self.ids and self.merged(item) == [item]
        return self.sound[item]

    def last_item(self, text: str, n: int, last: list[str]) -> str:
        """The last item of the encoding of a text's first n symbols; last[i] is that of its first i symbols. Looks back as far as the longest item."""
        for size in self.sizes.get(text[n - 1], ()):
            if size <= n and (item := text[n - size : n]) in self.ids and self.reachable(item) and (size == n or self.compatible(last[n - size], item)):
                return item
        raise ValueError("the vocabulary lacks a symbol")

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[str]]:
        """Items of each distinct word; sorted order walks the trie depth first. Prefixes deeper than DEPTH are worked out on the way and not kept, nor are any
        while the trie is full."""
        if len(self.state) > MOST_NODES:
            self.below.clear()
            self.state = [""]
        out, path, way, last = {}, "", [0], [""]
        for w in sorted(set(words)):
            inner = w[:-1].decode("latin-1")
            shared = _shared(path, inner)
            del way[shared + 1 :], last[shared + 1 :]
            for n in range(shared + 1, len(inner) + 1):
                at = way[-1] if len(way) == n else OFF
                node = self.below.get(at << 9 | ord(inner[n - 1])) if at != OFF else None
                if node is None:
                    last.append(self.last_item(inner, n, last))
                    if at == OFF or n > DEPTH or len(self.state) > MOST_NODES:
                        continue
                    self.state.append(last[-1])
                    node = self.below[at << 9 | ord(inner[n - 1])] = len(self.state) - 1
                else:
                    last.append(self.state[node])
                way.append(node)
            path = inner
            leaf, n = inner + chr(w[-1] + 256), len(inner) + 1
            items = [self.last_item(leaf, n, last)]
            n -= len(items[0])
            while n:
                items.append(last[n])
                n -= len(items[-1])
            out[w] = items[::-1]
        return out


def _shared(a: str, b: str) -> int:
    """The length of the prefix that two strings share."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class WordCodec:
    """Encoding and decoding of whole texts with a vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        self.trie = TrieBpe(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = splits_by(self.tokenizer, WORD_RULES)
        self.split = re.compile(WORD_SPLIT).findall
        self.size = 0
        self.cache: dict[str, tuple[bytes, str]] = {s: (packed([i]), s) for s, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        """Lower-cased words (bytes that the library has split are given in Latin-1 behind U+FFFF, which no Latin-1 text holds)."""
        if self.at_special and (parts := self.at_special.split(text))[1:]:
            return [w for p in parts for w in ([p] if p in self.special else self.words(p))]
        try:
            plain = self.known and text.encode("latin-1") is not None
        except UnicodeEncodeError:
            plain = False
        if not plain:
            norm = self.tokenizer.normalizer
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(norm.normalize_str(text) if norm else text)
            return ["\uffff" + bytes(self.trie.alphabet[c] for c in p).decode("latin-1") for p, _ in parts]
        return self.split(text.lower())

    def run(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """Number of ids, the ids as bytes, and the decoded text, of each text."""
        split = [self.words(t) for t in texts]
        seen = set().union(*split)
        new = seen.difference(self.cache)
        if self.size > MOST_BYTES:
            self.cache, self.size = {s: self.cache[s] for s in self.special}, 0
            new = seen.difference(self.cache)
        raw = {w: w[1:].encode("latin-1") if w[0] == "\uffff" else w.encode() for w in new}
        items = self.trie.encode_words(list(raw.values()))
        for w, b in raw.items():
            self.cache[w] = made = packed([self.trie.ids[x] for x in items[b]]), " ".join(self.trie.shown[x] for x in items[b])
            self.size += ENTRY + len(w) + len(made[0]) + len(made[1])
        out = []
        for ws in split:
            got = [self.cache[w] for w in ws]
            ids = b"".join([g[0] for g in got])
            out.append((len(ids) // 4, ids, " ".join([g[1] for g in got])))
        return out


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text."""

    def make():
        c = codec(tokenizer)

        def batch(cols: dict) -> dict:
            got = c.run(cols["text"])
            return {"doc_id": cols["doc_id"], "n_tokens": [g[0] for g in got], "ids": [g[1] for g in got], "decoded": [g[2] for g in got]}

        return batch

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id long, n_tokens long, ids binary, decoded string", make)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return encode(docs, tokenizer).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sha(data: bytes) -> str:
    """For tests."""
    return hashlib.sha256(data).hexdigest()

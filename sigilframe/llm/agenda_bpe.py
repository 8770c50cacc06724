"""Encoding and decoding with a SentencePiece model of the merge type, by a score-ordered agenda of adjacent symbol pairs.

A text, spaces written as SPACE and one more in front, starts as its characters. The agenda is a heap of adjacent pairs whose joint string is a
piece of the model, highest score first, then leftmost. Each turn joins the pair on top, if it still stands there, and enters the pairs that
this makes. What is no piece in the end becomes the pieces of its bytes, or the unknown piece where the model has none.

Two characters that follow each other in no piece can't be joined, so a text is cut there; no piece of the usual models holds SPACE behind
another character, so cuts before SPACE are found by one pattern. Each cut's ids are kept for the process, in a cache bounded by bytes; a long cut without spaces is cut further between any
two such characters, and its agenda is a heap of integers, so work is n log n and memory linear in the longest cut.

The library is asked in every Arrow batch for all cuts that are new in it, and `agrees` says of each row whether it gives the same ids and decoded texts for all
cuts of the row. (Asking it for whole texts took 290 CPU seconds for 0.86 GB here, two thirds of the budget; `whole=True` does that, and tests hold whole texts.) The library also normalizes texts for models whose own rules aren't the identity. User-defined and unused pieces aren't supported; a model that has any is refused.
No shuffle: one pass over the documents.

Nulls and odd rows: a null or empty text has the end id alone and decodes to the empty text; strings of special pieces are ordinary text, as in the
library; doc_id is carried as it is, null or repeated; repeated rows stay; other columns play no part.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows
from .wordbpe import ENTRY

SPACE = "▁"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"  # a class that cuts may follow where the model's pieces do
GONE = -1 << 30  # in place of a symbol that was joined to the one before
LONG = 64  # cuts above it are cut further before they are merged
MOST_BYTES = 200 << 20
UNKNOWN_TEXT = " ⁇ "  # what the library shows for the unknown id


class Cuts(dict):
    """The ids, in decimal and joined by spaces, of cuts met by this process; `shown` has the decoded text of those that don't decode to themselves,
    `new` those that weren't held against the library yet, `odd` those where it differs."""

    def __init__(self, model: AgendaBpe):
        super().__init__()
        self.model, self.size, self.shown, self.new, self.odd = model, 0, {}, [], set()

    def __missing__(self, cut: str) -> str:
        ids = self.model.encode_cut(cut)
        self.new.append(cut)
        self[cut] = made = " ".join([str(i) for i in ids])
        self.size += ENTRY + len(cut) + len(made)
        if (shown := self.model.decode(ids, start=False)) != cut.replace(SPACE, " "):
            self.shown[cut] = shown
            self.size += ENTRY + len(shown)
        return made


class AgendaBpe:
    """Pieces and scores of a model file. A symbol is a piece's id, or a negative number for a character that is no piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        kinds = range(lib.get_piece_size())
        if any(lib.is_unused(i) for i in kinds):
            raise ValueError("the model has unused pieces")
        plain = [i for i in kinds if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        ids = {lib.id_to_piece(i): i for i in plain}
        self.text = {i: p.replace(SPACE, " ") for p, i in ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:-1], 16): i for i in kinds if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.controls = {i for i in kinds if lib.is_control(i)}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        self.symbol = {p: i for p, i in ids.items() if len(p) == 1}
        # By two symbols' ids: the place of their joint piece's score in the order of scores, and its id.
        self.joint = {ids[p[:k]] << 24 | ids[p[k:]]: order[lib.get_score(i)] << 24 | i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.together = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.together):
            raise ValueError("a piece holds a space behind another character")
        self.identity = all(lib.normalize(x) == (SPACE + x.replace(" ", SPACE) if x else "") for x in ("", " ", "  a  b ", "ﬁ é 　\t\r\n​Ａ"))
        letter = re.compile(f"[{LETTERS}]").match
        apart = all(a == SPACE or bool(letter(a)) == bool(letter(b)) for a, b in self.together)
        self.cut = re.compile(f"{SPACE}*(?:[{LETTERS}]+|[^{LETTERS}{SPACE}]+)|{SPACE}+" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.cuts = Cuts(self)
        self.decimal = [str(i) for i in kinds]

    def merged(self, text: str) -> list[int]:
        """The symbols that the agenda leaves of a text."""
        n, symbol, joint = len(text), self.symbol, self.joint
        symbols = [symbol[c] if c in symbol else ~ord(c) for c in text]
        agenda = [made >> 24 << 40 | i for i in range(n - 1) if (made := joint.get(symbols[i] << 24 | symbols[i + 1])) is not None]
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(GONE)
        while agenda:
            top = heappop(agenda)
            i = top & (1 << 40) - 1
            j = after[i]
            made = joint.get(symbols[i] << 24 | symbols[j])
            if made is None or made >> 24 != top >> 40:
                continue  # one of the two has been joined to another since
            symbols[i], symbols[j] = made & (1 << 24) - 1, GONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (made := joint.get(symbols[i] << 24 | symbols[k])) is not None:
                    heappush(agenda, made >> 24 << 40 | i)
            h = before[i]
            if h >= 0 and (made := joint.get(symbols[h] << 24 | symbols[i])) is not None:
                heappush(agenda, made >> 24 << 40 | h)
        return [s for s in symbols if s != GONE]

    def apart(self, text: str) -> list[str]:
        """A text cut between characters that follow each other in no piece."""
        at = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.together), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode_cut(self, text: str) -> list[int]:
        ids = [i for part in self.apart(text) for i in self.merged(part)] if len(text) > LONG else self.merged(text)
        if min(ids) < 0:
            ids = [x for i in ids for x in ([i] if i >= 0 else [self.bytes[b] for b in chr(~i).encode()] if self.bytes else [self.unknown])]
        return ids

    def normalized(self, text: str) -> str:
        if not self.identity:
            return self.library.normalize(text)
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text without the end id. Unknown symbols that follow each other count as one."""
        ids = [i for c in self.cut(self.normalized(text)) for i in self.encode_cut(c)]
        return ids if self.bytes else [i for i, run in groupby(ids) for i in ([i] if i == self.unknown else run)]

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text of ids; at a text's start, the space that encoding put in front goes. Bytes that are no UTF-8 become U+FFFD each."""
        out: list[str] = []
        for byte, run in groupby(ids, self.byte_of.__contains__):
            if byte:
                out.append(_lenient(bytes(self.byte_of[i] for i in run)))
                continue
            for i in run:
                if i not in self.controls:
                    out.append(UNKNOWN_TEXT if i == self.unknown else self.text[i])
                    if start and len(out) == 1 and out[0][:1] == " " and i != self.unknown:
                        out[0], start = out[0][1:], False
        return "".join(out)

    def run(self, texts: list[str]) -> list[tuple[str, str, bool]]:
        """The ids with the end id, in decimal and joined by spaces, the decoded text, and whether the library agrees on all cuts, of each text."""
        if self.cuts.size > MOST_BYTES:
            self.cuts = Cuts(self)
        end, cuts, shown, out, split = str(self.end), self.cuts, self.cuts.shown, [], []
        for text in texts:
            if not self.bytes:  # unknown symbols of two cuts may meet
                ids = self.encode(text)
                out.append((" ".join(map(str, [*ids, self.end])), self.decode(ids), True))
                continue
            whole = self.normalized(text)
            parts = self.cut(whole)
            split.append(parts)
            ids = " ".join([*[cuts[c] for c in parts], end])
            back = "".join([shown.get(c) or c.replace(SPACE, " ") for c in parts]) if shown else whole.replace(SPACE, " ")
            out.append((ids, back[1:] if back[:1] == " " else back, True))
        self.ask()
        if cuts.odd:
            out = [(ids, back, cuts.odd.isdisjoint(parts)) for (ids, back, _), parts in zip(out, split, strict=True)]
        return out

    def ask(self) -> None:
        """Holds new cuts against the library. It puts SPACE in front of a text: a cut that begins with SPACE is asked for without that one, any other,
        and SPACE alone, behind a line break, whose ids and text are known."""
        cuts, lib = self.cuts, self.library
        asked = [c[1:] if c[0] == SPACE != c else "\n" + c for c in cuts.new]
        texts = [t.replace(SPACE, " ") for t in asked]
        first = lib.encode("\n")
        theirs = lib.encode(texts, num_threads=1) if texts else []
        for c, text, ids, back in zip(cuts.new, texts, theirs, lib.decode(theirs, num_threads=1) if texts else [], strict=True):
            own = cuts[c] if c[0] == SPACE != c else " ".join([*map(str, first), cuts[c]])
            if own != " ".join([self.decimal[i] for i in ids]) or back != text:
                cuts.odd.add(c)
        cuts.new.clear()


def _lenient(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that starts no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = "", 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out += raw[i : i + n].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            out, n = out + "�", 1
        i += n
    return out


_MODELS: dict[str, AgendaBpe] = {}


def model(path: str) -> AgendaBpe:
    """One for each process, so that its cache serves many tasks."""
    if path not in _MODELS:
        _MODELS[path] = AgendaBpe(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, whole: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces, the end id last), decoded, and agrees: whether the library gives the same ids and texts, of
    each cut, or with `whole` of the whole text."""

    def make():
        m = model(path)

        def batch(cols: dict) -> dict:
            texts = cols["text"]
            got = m.run(texts)
            same = [g[2] for g in got]
            if whole and texts:
                theirs = m.library.encode(texts, add_eos=True, num_threads=1)
                same = [g[0] == " ".join(map(str, i)) and g[1] == b for g, i, b in zip(got, theirs, m.library.decode(theirs, num_threads=1), strict=True)]
            return {"doc_id": cols["doc_id"], "n_tokens": [g[0].count(" ") + 1 for g in got], "ids": [g[0] for g in got], "decoded": [g[1] for g in got], "agrees": same}

        return batch

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id long, n_tokens long, ids string, decoded string, agrees boolean", make, rows=64)


def digest(docs: DataFrame, path: str) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return encode(docs, path).select("doc_id", "n_tokens", sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"), "agrees")

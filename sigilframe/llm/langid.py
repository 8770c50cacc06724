"""Language identification by a byte convolutional network.

A window of WINDOW bytes runs through filters of several widths over byte embeddings, a rectifier, max pooling over
the window and a softmax. The network is trained in numpy on a bounded sample of labelled documents; a document is
cut into consecutive windows that cover its whole text, and its prediction is the mean of theirs, by bytes.

At prediction an embedding followed by a filter is one table look-up: filters of even width read tables over byte
pairs, so a width of four costs two gathers. All work is one pass over the documents, without a shuffle; only the
sample (at most PER_LANG rows of each of MOST_LANGS languages, a few windows each) reaches the driver, and only the weights go back.
The sample is drawn by a hash of id and text: twice as many rows as wanted have a hash below a bound that follows from the language's number of
rows, and the lowest of these are taken, so no task meets all rows of a language.

Nulls, ties, odd rows: a null text or one without any letter is UNKNOWN with score 0; a null doc_id counts as not
held out and isn't learned from; a tie of scores goes to the language first in order; without labelled rows every
prediction is UNKNOWN. Rows are never merged, so repeated rows stay.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc, fields, fresh, map_rows

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 6
PER_LANG = 400
MOST_LANGS = 1000  # the most frequent ones are learned
PER_DOC = 4
FILL = 0.9  # the least score of a prediction that stands in for a null lang
CANDIDATE = re.compile(r"[^\W\d_]")  # letters, and numerals that are no digits


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in CANDIDATE.finditer(text))


def cut(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's UTF-8 bytes as rows of WINDOW, the last filled up with zeros, and the bytes that each row holds."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(raw)] = raw
    fill = np.full(n, WINDOW, np.float32)
    fill[-1] = max(1, len(raw) - (n - 1) * WINDOW)
    return x.reshape(n, WINDOW), fill


class ByteConvNet:
    """Multi-width byte convolution, max pooling and softmax, with plain numpy training (Adam)."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.emb = r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.conv = [r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, *self.bias, self.out, self.out_bias]

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses before pooling, by width: (windows, positions, filters)."""
        found = []
        for k, w in zip(self.conv, WIDTHS, strict=True):
            n = x.shape[1] - w + 1
            found.append(sum((self.emb @ k[j])[x[:, j : j + n]] for j in range(w)))
        return found

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        r, step = np.random.default_rng(seed), 0
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for p, g, (m, v) in zip(self.params(), self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]), moment, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, rows = len(x), np.arange(len(x))
        at, pooled = [], []
        for z, b in zip(self.responses(x), self.bias, strict=True):
            t = z.argmax(axis=1)
            at.append(t)
            pooled.append(np.maximum(np.take_along_axis(z, t[:, None, :], 1)[:, 0] + b, 0))
        h = np.concatenate(pooled, 1)
        d = _softmax(h @ self.out + self.out_bias)
        d[rows, y] -= 1
        d /= n
        back = (d @ self.out.T) * (h > 0)
        g_emb, g_conv, g_bias = np.zeros_like(self.emb), [], []
        for i, (w, k, t) in enumerate(zip(WIDTHS, self.conv, at, strict=True)):
            e = back[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(k)
            for j in range(w):
                byte = x[rows[:, None], t + j]  # the byte under tap j at each filter's best position
                g[j] = np.einsum("nf,nfe->ef", e, self.emb[byte])
                np.add.at(g_emb, byte, e[:, :, None] * k[j].T[None])
            g_conv.append(g)
            g_bias.append(e.sum(0))
        return [g_emb, *g_conv, *g_bias, h.T @ d, d.sum(0)]

    def compiled(self):
        """A function from windows to probabilities that reads pair tables."""
        single = [[self.emb @ k[j] for j in range(w)] for k, w in zip(self.conv, WIDTHS, strict=True)]
        plans = []
        for taps in single:
            j, steps = 0, []
            while j < len(taps):
                if j + 1 < len(taps):
                    steps.append((j, True, (taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(65536, FILTERS)))
                    j += 2
                else:
                    steps.append((j, False, taps[j]))
                    j += 1
            plans.append(steps)

        def run(x: np.ndarray) -> np.ndarray:
            out = np.empty((len(x), len(self.langs)), np.float32)
            for i in range(0, len(x), 128):
                y = x[i : i + 128]
                pair = (y[:, :-1].astype(np.int32) << 8) | y[:, 1:]
                pooled = []
                for w, steps, b in zip(WIDTHS, plans, self.bias, strict=True):
                    n, z = y.shape[1] - w + 1, None
                    for j, two, table in steps:
                        got = table.take((pair if two else y)[:, j : j + n], axis=0)
                        z = got if z is None else np.add(z, got, out=z)
                    pooled.append(np.maximum(z.max(axis=1) + b, 0))
                out[i : i + 128] = _softmax(np.concatenate(pooled, 1) @ self.out + self.out_bias)
            return out

        return run


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(crc(doc_id) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, per_doc: int = PER_DOC, most_langs: int = MOST_LANGS) -> ByteConvNet | None:
    """Fits the network to at most per_lang documents of each of the most_langs most frequent languages, with at most per_doc windows of each, spread
    evenly over the text. None without labelled rows."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(most_langs)
    mark = F.xxhash64("doc_id", "text")
    few = usable.join(F.broadcast(sizes), "lang").where(F.pmod(mark, F.lit(1 << 40)) / float(1 << 40) * F.col("_n") < 2 * per_lang)  # most_langs rows
    order = Window.partitionBy("lang").orderBy(F.pmod(mark, F.lit(1 << 40)), "doc_id", "text")
    sample = few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_lang)

    def make():
        def windows(cols: dict) -> dict:
            out = []
            for text in cols["text"]:
                x, _ = cut(text)
                out.append(x[np.unique(np.linspace(0, len(x) - 1, min(per_doc, len(x))).astype(int))].tobytes() if has_letter(text) else b"")
            return {"lang": cols["lang"], "doc_id": cols["doc_id"], "w": out}

        return windows

    rows = sorted((r.lang, r.doc_id, bytes(r.w)) for r in map_rows(sample.select("doc_id", "lang", "text"), "lang string, doc_id long, w binary", make).collect() if r.w)  # per_lang rows a language
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    x = np.concatenate([np.frombuffer(r[2], np.uint8).reshape(-1, WINDOW) for r in rows])
    y = np.concatenate([np.full(len(r[2]) // WINDOW, langs.index(r[0])) for r in rows])
    return ByteConvNet(langs).fit(x, y)


def predict(docs: DataFrame, net: ByteConvNet | None, keep: list[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the prediction and its score to the columns in `keep` (default: doc_id); predictions read the text alone."""
    keep = keep or ["doc_id"]
    src = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if "text" in keep else ["text"]))

    def make():
        run = net.compiled() if net else None

        def batch(cols: dict) -> dict:
            texts = cols["text"]
            best = [(UNKNOWN, 0.0)] * len(texts)
            live = [i for i, t in enumerate(texts) if run and t and has_letter(t)]
            for group in _groups(live, texts):
                cuts = [cut(texts[i]) for i in group]
                p = run(np.concatenate([c[0] for c in cuts]))
                weight = np.concatenate([c[1] for c in cuts])
                starts = np.cumsum([0, *(len(c[0]) for c in cuts[:-1])])
                mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                for i, m in zip(group, mean, strict=True):
                    best[i] = (net.langs[int(m.argmax())], float(min(1.0, m.max())))
            return {lang: [b[0] for b in best], score: [b[1] for b in best]}

        return batch

    return map_rows(src, fields(docs, keep, f"`{lang}` string, `{score}` double"), make, carry=keep, read=("text",))


def _groups(live: list[int], texts: list[str], most: int = 1 << 20):
    """Runs of documents of about `most` characters, so that many short ones share a pass."""
    group, size = [], 0
    for i in live:
        group.append(i)
        size += len(texts[i])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, fill: float = FILL) -> DataFrame:
    """A filtering stage: the rows and columns of docs whose language could be told; rejects null texts and texts without a letter. A null lang becomes
    the language predicted, where its score is `fill` or more; a lang that is given stays. Without labelled rows there is no model, and every text with a letter stays as it is."""
    net = train(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "_lang", "_score")
    told = predict(docs, net, docs.columns, lang, score).where(F.col(lang) != UNKNOWN)
    known = F.coalesce("lang", F.when(F.col(score) >= fill, F.col(lang))).alias("lang")
    return told.select(*(known if c == "lang" else c for c in docs.columns))

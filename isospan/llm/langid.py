"""Language identification by a byte convolutional network in numpy.

A window of WINDOW bytes is embedded, passed through filters of several widths
over an embedding of byte values, max-pooled by filter and classified by
softmax. A text is all of its windows, whatever its length; their
log-probabilities, weighted by the share of a window that they fill, give its
language. A text shorter than a window counts as a whole one.

The first filter layer over one-hot bytes is a table look-up: filter responses
are sums of one table row per byte in the filter, so each width costs a few
gathers and adds over the batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 12
PER_LANGUAGE = 1500
EPOCHS = 6
LEAST_STEPS = 500
SAMPLE_WINDOWS = 100_000
FEWEST = 20
PLACES = 4
SPARE = 2
UNKNOWN = "und"
NOISE_SHARE = 0.5
CLEAN_LOST = 0.001
NOISE_ODDS = 1.2  # log odds a window for noise, at least, to reject a text
WHOLE_EVIDENCE = 64  # bytes from which a text's odds count in full
LEAST_PIECE = 4
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteConvNet:
    languages: list[str]
    embed: np.ndarray = None
    kernels: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    dense: np.ndarray = None
    dense_bias: np.ndarray = None
    reject: float | None = None  # least evidence for a language against noise

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 1) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        net = cls(languages)
        net.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        for w in WIDTHS:
            net.kernels[w] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            net.bias[w] = np.zeros(FILTERS, np.float32)
        net.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        net.dense_bias = np.zeros(len(languages), np.float32)
        return net

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels.values(), *self.bias.values(), self.dense, self.dense_bias]

    def _patches(self, x: np.ndarray, w: int) -> np.ndarray:
        """(n, positions, w * EMBED) embedded byte runs of a batch of windows."""
        e = self.embed[x]
        n = x.shape[1] - w + 1
        return np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)

    def step(self, x: np.ndarray, y: np.ndarray, state: list, rate: float, count: int) -> float:
        """One Adam step on a batch of windows; returns its mean loss."""
        pooled, kept = [], []
        for w in WIDTHS:
            p = self._patches(x, w)
            z = p @ self.kernels[w] + self.bias[w]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0, :]
            pooled.append(np.maximum(top, 0))
            kept.append((p, at, top > 0))
        h = np.concatenate(pooled, axis=1)
        logits = h @ self.dense + self.dense_bias
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        n = len(x)
        loss = -np.log(prob[np.arange(n), y] + 1e-9).mean()
        d = prob.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g_embed, g_kernel, g_bias = np.zeros_like(self.embed), {}, {}
        back = d @ self.dense.T
        for i, w in enumerate(WIDTHS):
            p, at, live = kept[i]
            dz = back[:, i * FILTERS : (i + 1) * FILTERS] * live
            chosen = p[np.arange(n)[:, None], at]  # (n, FILTERS, w * EMBED)
            g_kernel[w] = np.einsum("nfk,nf->kf", chosen, dz)
            g_bias[w] = dz.sum(axis=0)
            into = dz[:, :, None] * self.kernels[w].T[None]
            for j in range(w):
                np.add.at(g_embed, np.take_along_axis(x, at + j, 1), into[:, :, j * EMBED : (j + 1) * EMBED])
        grads = [g_embed, *g_kernel.values(), *g_bias.values(), h.T @ d, d.sum(axis=0)]
        for p, g, (m, v) in zip(self._parameters(), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-8)
        return float(loss)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, seed: int = 2) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self._parameters()]
        count, epochs = 0, max(epochs, -(-LEAST_STEPS * batch // len(x)))
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                count += 1
                part = order[at : at + batch]
                self.step(x[part], y[part], state, 0.006 * (1 - epoch / epochs), count)
        return self

    def tables(self) -> dict[int, np.ndarray]:
        """Per width and place in the filter: each byte value's share of the responses."""
        return {w: np.stack([self.embed @ self.kernels[w][j * EMBED : (j + 1) * EMBED] for j in range(w)]) for w in WIDTHS}

    def predict(self, windows: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        """Log-probabilities of a batch of windows."""
        pooled = []
        for w in WIDTHS:
            n = windows.shape[1] - w + 1
            z = tables[w][0][windows[:, :n]]
            for j in range(1, w):
                z += tables[w][j][windows[:, j : j + n]]
            pooled.append(np.maximum(z.max(axis=1) + self.bias[w], 0))
        logits = np.concatenate(pooled, axis=1) @ self.dense + self.dense_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def windows_of(raws: list[bytes], size: int = WINDOW):
    """Zero-padded windows over all bytes of all texts, their owners and fill."""
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    counts = -(-lengths // size)
    flat = np.zeros(int(counts.sum()) * size, np.uint8)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) * size
    for raw, at in zip(raws, starts.tolist()):
        flat[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
    owner = np.repeat(np.arange(len(raws)), counts)
    index = np.arange(len(owner)) - np.repeat(starts // size, counts)
    return flat.reshape(-1, size), owner, np.minimum(lengths[owner] - index * size, size)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = WINDOW) -> list:
    """At most per_language labelled windows of each language, by hash order.

    A row gives PLACES windows, at hash-chosen places of its text. A hash
    threshold by each language's row count leaves some SPARE times the limit
    before anything is shuffled, so a language with most of the rows is no load.
    Where there are more than SAMPLE_WINDOWS / per_language languages, each
    gives fewer, FEWEST at least; all are learned.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.trim(text_col) != "") & ~held_out(F.col(id_col)))
    place = F.pmod(F.xxhash64(F.col("i"), F.col("h")), F.greatest(F.char_length("t") - size, F.lit(1))).cast("int")
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    per_language = min(per_language, max(FEWEST, SAMPLE_WINDOWS // max(1, counts.count())))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(SPARE * per_language)) / F.col("n")).alias("share"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.xxhash64(F.lit(5), F.col(text_col)).alias("h"))
    rows = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(1 << 24)) < F.col("share") * (1 << 24))
    rows = rows.select("lang", "t", "h", F.explode(F.sequence(F.lit(1), F.lit(PLACES))).alias("i"))
    rows = rows.select("lang", F.substring(F.col("t"), place + 1, F.lit(size)).alias("text"), F.xxhash64("h", "i").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "text").collect()


def noise_texts(texts: list[str], n: int, rng) -> list[str]:
    """n texts of no language: shuffled letters, random characters, codes, repeats."""
    low, printable, coded = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(33, 127)], "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/="

    def spaced(chars, longest):
        out, at = [], 0
        while at < len(chars):
            step = int(rng.integers(1, longest))
            out.append("".join(chars[at : at + step]))
            at += step
        return " ".join(out)

    def one(kind):
        if kind == 0:
            return spaced(rng.permutation(list("".join(texts[int(rng.integers(len(texts)))].split()))).tolist(), 12)
        if kind == 1:
            return spaced(rng.choice(list(low), WINDOW).tolist(), 14)
        if kind == 2:
            return spaced(rng.choice(printable, WINDOW).tolist(), int(rng.integers(3, 40)))
        if kind == 3:
            return spaced(rng.choice(list(coded[: int(rng.choice([16, 64]))]), WINDOW).tolist(), 120)
        if kind == 4:
            first = int(rng.integers(0xA0, 0xD000))
            return spaced([chr(c) for c in rng.integers(first, first + int(rng.integers(40, 2000)), WINDOW)], 14)
        return "".join(rng.choice(printable, int(rng.integers(1, 4))).tolist()) * WINDOW

    return [one(i % 6) for i in range(n)]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, noise: bool = False, **columns) -> ByteConvNet | None:
    """A network fitted to the bounded sample; None where nothing is labelled.

    With noise it also learns UNKNOWN from made-up noise, and the evidence that
    all but CLEAN_LOST of the labelled windows have for a language (see margin).
    """
    rows = sorted((r["lang"], r["text"]) for r in training_sample(docs, per_language, **columns) if _LETTER.search(r["text"]))
    if not rows:
        return None
    rng = np.random.default_rng(4)
    if noise:
        clean = [text for lang, text in rows if lang != UNKNOWN]
        if not clean:
            return None
        rows += [(UNKNOWN, text) for text in noise_texts(clean, max(60, int(NOISE_SHARE * len(clean))), rng)]
    languages = sorted({lang for lang, _ in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, text) in enumerate(rows):  # shorter ones too, as texts end in them
        raw = text.encode()[: WINDOW if i % 3 else int(rng.integers(LEAST_PIECE if noise else 24, WINDOW))]
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    y = np.array([place[lang] for lang, _ in rows])
    net = ByteConvNet.fresh(languages).fit(x, y)
    if noise:
        clean = x[y != place[UNKNOWN]]
        logp = np.concatenate([net.predict(clean[at : at + 128], net.tables()) for at in range(0, len(clean), 128)])
        net.reject = min(-NOISE_ODDS, float(np.quantile(margin(logp, place[UNKNOWN]), CLEAN_LOST)))
    return net


def margin(logp: np.ndarray, unknown: int) -> np.ndarray:
    """Log-probability of the best language less that of noise."""
    return np.delete(logp, unknown, axis=1).max(axis=1) - logp[:, unknown]


def predict_texts(net: ByteConvNet | None, texts: list, tables=None, batch: int = 128) -> list[tuple[str, float]]:
    """(language, score) of each text: `und`, 0 without a letter or a network.

    A network that has learned noise also gives `und`, 0 to a text whose evidence
    for a language, per window, is less than net.reject.
    """
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    seen = [i for i, t in enumerate(texts) if net and t and _LETTER.search(t)]
    tables = tables or (net.tables() if net else None)
    group: list[int] = []
    held = 0
    for k, i in enumerate(seen):
        group.append(i)
        held += len(texts[i])
        if held < 1 << 20 and k + 1 < len(seen):
            continue
        windows, owner, fill = windows_of([texts[j].encode() for j in group])
        sums = np.zeros((len(group), len(net.languages)))
        share = fill / np.minimum(WINDOW, np.bincount(owner, fill, len(group)))[owner]  # a short text is a whole window
        for at in range(0, len(windows), batch):
            logp = net.predict(windows[at : at + batch], tables)
            np.add.at(sums, owner[at : at + batch], logp * share[at : at + batch, None])
        known = np.ones(len(group), bool)
        if net.reject is not None:  # evidence a window, so that long texts are judged like short ones
            unknown = net.languages.index(UNKNOWN)
            some = np.minimum(1, np.bincount(owner, fill, len(group)) / WHOLE_EVIDENCE)  # a few letters say little
            known = some * margin(sums, unknown) / np.bincount(owner, share, len(group)) >= net.reject
            sums[:, unknown] = -np.inf
        sums -= sums.max(axis=1, keepdims=True)
        prob = np.exp(sums)
        prob /= prob.sum(axis=1, keepdims=True)
        for j, best, p, good in zip(group, prob.argmax(axis=1), prob, known):
            if good:
                out[j] = (net.languages[best], float(p[best]))
        group, held = [], 0
    return out


def _labelled_batches(net):
    def labelled(batches):
        import pyarrow as pa

        tables = net.tables() if net else None
        for batch in batches:
            got = predict_texts(net, batch.column("_text").to_pylist(), tables)
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name != "_text"]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return labelled


def identify(docs: DataFrame, net: ByteConvNet | None = None, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, the columns in keep, lang_pred and score of each whole text.

    Without a network one is trained on the table's own labels. lang_pred is a
    learned language, `und` with score 0 where the text is null or has no
    letter, or where no row is labelled. Only the text is an input of a
    prediction. Null ids are never held out; repeated rows are rows like
    others; an empty table gives no rows. No shuffle.
    """
    net = net or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), *keep, F.col(text_col).alias("_text"))
    schema = T.StructType([f for f in rows.schema if f.name != "_text"]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_labelled_batches(net), schema)


def recognised(docs: DataFrame) -> DataFrame:
    """docs whose language is recognised; the others are `und`.

    The network learns noise beside the table's own languages: `und` are texts
    without a letter and those that it finds more like noise than all but
    CLEAN_LOST of the labelled sample, and by NOISE_ODDS a window at least. Where no row is labelled nothing is
    learned, and only texts without a letter go. Null texts go. Columns are
    docs' own; repeated rows and null ids stay; an empty table gives no rows.
    """
    names = docs.columns
    net = train(docs, noise=True)
    if net is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return identify(whole, net, keep=("_row",)).where(F.col("lang_pred") != UNKNOWN).select("_row.*")

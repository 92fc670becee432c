"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import free

#: Label of what is not identified, and languages whose shares of the sample are broadcast.
UNKNOWN, BROADCAST = "und", 50_000
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))


@dataclass(frozen=True)
class Params:
    """buckets: size of the hash table. dim: embedding size. sizes: characters of a subword.

    per_language, total: documented bounds on the training sample, in documents (expected; of each
    language one at least). segment: code points of a training segment; per_document: most segments of a
    sampled document (longer ones give as many, evenly spaced), so that the sample holds total * per_document *
    segment code points at most, 96 million. steps: training segments an epoch. aside:
    most segments kept aside to calibrate the scores. known: bits of the table of three-letter subwords seen
    in training. prior: subwords by which a text's share of known ones is drawn to that of clean texts. loss:
    share of clean texts that the highest rejection limit costs; spared: share of the negatives that may pass
    beyond those that pass there, so that the limit lies as low as it can.
    """

    buckets: int = 1 << 15
    dim: int = 16
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    per_language: int = 400
    total: int = 4000
    epochs: int = 4
    rate: float = 0.5
    segment: int = 240
    per_document: int = 100
    steps: int = 6000
    aside: int = 2000
    known: int = 21
    prior: float = 12.0
    loss: float = 0.002
    spared: float = 0.25
    seed: int = 7


@dataclass
class Model:
    """table: each subword's logits (its embedding times the softmax weights); bias and temperature.

    With more languages than an embedding has numbers, table holds the embeddings and weights the softmax's.
    seen: which three-letter subwords training had; usual: their share in clean texts; least: the share
    below which a text is in none of the languages.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    params: Params = field(default_factory=Params)
    seen: np.ndarray | None = None
    usual: float = 1.0
    least: float = 0.0
    weights: np.ndarray | None = None

    def logits(self, mean: np.ndarray) -> np.ndarray:
        """Logits of the mean of a text's rows of the table."""
        return (mean if self.weights is None else mean @ self.weights) + self.bias

    def measure(self, text: str) -> tuple[np.ndarray, float]:
        """Probability of each language, and the share of known subwords, drawn to the usual one for short texts."""
        total, n = np.zeros(self.table.shape[1]), 0
        hits = triples = 0
        step = 1 << 17
        for at in range(0, max(1, len(text)), step):  # bounded memory for very long texts
            ids, three = subwords(text[max(0, at - 3) : at + step], self.params)
            total += np.bincount(ids, minlength=self.params.buckets) @ self.table if len(ids) > 4 * self.params.buckets else self.table[ids].sum(0)
            n += len(ids)
            if self.seen is not None:
                hits, triples = hits + int(self.seen[three].sum()), triples + len(three)
        z = self.logits(total / max(n, 1)) / self.temperature
        e = np.exp(z - z.max())
        prior = self.params.prior
        return e / e.sum(), (hits + prior * self.usual) / (triples + prior)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether the text is accepted as one of the languages."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        p, share = self.measure(text)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), share >= self.least


def subwords(text: str, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the lower-cased text, and the number of each three-letter one.

    Whatever is no letter counts as one kind of gap.
    """
    low = text.lower()
    codes = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = (codes < 97) | ((codes > 122) & (codes < 170)) | ((codes >= 0x2000) & (codes < 0x2070))
    codes = np.where(gap, np.uint32(32), codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    codes = codes[keep]
    out, h, three = [], None, np.zeros(0, np.uint32)
    for n in range(1, max(3, *params.sizes) + 1):
        if len(codes) < n:
            break
        h = codes * _MULTIPLIERS[0] if h is None else (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULTIPLIERS[n % 4] + codes[n - 1 :] * _MULTIPLIERS[(n + 1) % 4]
        if n in params.sizes:
            out.append((h ^ (h >> np.uint32(16))) & np.uint32(params.buckets - 1))
        if n == 3:
            three = (h ^ (h >> np.uint32(17))) & np.uint32((1 << params.known) - 1)
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), three


def segments(params: Params) -> F.Column:
    """The text cut whole into segments; a text of over ``per_document`` segments gives as many, evenly spaced."""
    n = F.ceil(F.length("text") / params.segment)
    most = F.lit(params.per_document)
    step = F.when(n > most, F.length("text") / most).otherwise(F.lit(float(params.segment)))
    cut = F.transform(F.sequence(F.lit(1), F.least(n, most)), lambda k: F.substring("text", F.floor((k - 1) * step).cast("int") + 1, F.lit(params.segment)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def fit(rows: list[tuple[str, list[str]]], params: Params = Params()) -> Model:
    """Train on (language, segments of a text) rows; a tenth of the rows is kept aside to calibrate scores and rejection."""
    languages = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(params.seed)
    index = {lang: k for k, lang in enumerate(languages)}
    train, aside, clean = [], [], []
    for i in rng.permutation(len(rows)):
        lang, parts = rows[i]
        parts = [s for s in parts if _LETTER.search(s)]
        if len(train) and i % 10 == 0:
            aside.extend((index[lang], s) for s in parts)
            clean.append((index[lang], "".join(parts)))
        else:
            train.extend((index[lang], s) for s in parts)
    n = len(languages)
    if not train:
        return Model(languages if n == 1 else [], np.zeros((params.buckets, max(n, 1))), np.zeros(n), 1.0, params)
    e = rng.normal(0, 0.1, (params.buckets, params.dim))
    w, b = np.zeros((params.dim, n)), np.zeros(n)
    prior = np.bincount([k for k, _ in train], minlength=n)
    share = prior.sum() / (n * np.maximum(prior, 1))  # languages weigh the same
    for epoch in range(params.epochs):
        for i in rng.permutation(len(train))[: params.steps]:
            k, text = train[i]
            ids, counts = np.unique(subwords(text, params)[0], return_counts=True)
            f = counts / counts.sum()
            hidden = f @ e[ids]
            z = hidden @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            g = p * min(share[k], 5.0) * params.rate / (1 + epoch)
            e[ids] -= np.outer(f, w @ g) * 4
            w -= np.outer(hidden, g)
            b -= 0.1 * g
    many = n > params.dim
    model = Model(languages, (e if many else e @ w).astype(np.float32), b, 1.0, params, weights=w.astype(np.float32) if many else None)
    held = aside[: params.aside] or train[: params.aside]
    logits = np.array([model.logits(model.table[subwords(s, params)[0]].mean(0)) for _, s in held])
    truth = np.array([k for k, _ in held])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]))

    model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    calibrate(model, train, clean or train[: params.aside])
    return model


def calibrate(model: Model, train: list[tuple[int, str]], clean: list[tuple[int, str]]) -> None:
    """Set the limit of rejection on (language, text) rows: between clean texts and negatives made from them.

    Clean texts are whole ones and their first words. Negatives are texts with their letters shuffled, in
    letters moved to another script, and in a language left out of training (judged by the subwords that the
    other languages have). No more than ``loss`` of the clean texts may fall below the limit, and it is set
    lower, as far as few more negatives pass.
    """
    params, rng = model.params, np.random.default_rng(model.params.seed)
    by_language: list[list[np.ndarray]] = [[] for _ in model.languages]
    for k, text in train:
        by_language[k].append(np.unique(subwords(text, params)[1]))
    own = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint32) for x in by_language]
    having = np.zeros(1 << params.known, np.uint16)
    for x in own:
        having[x] += 1
    model.seen = having > 0

    def share(text: str, seen: np.ndarray) -> float:
        three = subwords(text, params)[1]
        return (seen[three].sum() + params.prior * model.usual) / (len(three) + params.prior)

    clean = [(k, t) for k, t in clean if t]
    if not clean:
        return
    model.usual = float(np.mean([share(t, model.seen) for _, t in clean]))
    good = [share(x, model.seen) for _, t in clean for x in (t, t[: params.segment // 8])]
    bad = []
    for k, x in enumerate(own):
        others = model.seen.copy()
        others[x] = having[x] > 1
        mine = [t for j, t in clean if j == k and len(t) >= params.segment]
        bad += [share(t, others) for t in mine] if len(own) > 1 else []
        bad += [share("".join(rng.permutation(list(t))), model.seen) for t in mine]
        bad += [share("".join(chr(ord(c) + 0x0A00) if c.isalpha() else c for c in t if ord(c) < 0xA000), model.seen) for t in mine]
    high = float(np.quantile(good, params.loss))
    passing = np.mean(np.array(bad) >= high) if bad else 0.0
    model.least = min(high, float(np.quantile(bad, max(0.0, 1 - passing - params.spared))) if bad else 0.0)


def held_out() -> F.Column:
    """Whether a document is kept from training: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, params: Params = Params()) -> Model:
    """Fit on a bounded sample, even over the languages, of labelled documents that aren't held out.

    Documents are drawn by a hash of doc_id and text, repeated rows once; the sample is the same however the
    table is laid out. Without any labelled document the model knows no language.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((params.buckets, 1)), np.zeros(0), 1.0, params)
    each = max(1, min(params.per_language, params.total // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(lang, each / n) for lang, n in sizes.items()], "lang string, share double")
    key = F.xxhash64("doc_id", "text", F.lit(params.seed))
    keyed = usable.select("lang", "text", key.alias("key"))
    cut = lambda df: df.select("lang", "key", segments(params).alias("parts"))
    met = keyed.join(F.broadcast(shares) if len(sizes) <= BROADCAST else shares, "lang")
    drawn = cut(met.where(F.pmod("key", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))).groupBy("lang", "key").agg(F.first("parts").alias("parts"))
    rows = sorted((r["lang"], r["key"], r["parts"]) for r in drawn.collect())
    if not rows:  # a table so small that the draw is empty
        rows = [(r["lang"], r["key"], r["parts"]) for r in cut(keyed.orderBy("key", "lang").limit(params.total)).collect()]
    return fit([(lang, parts) for lang, _, parts in rows], params)


def predict(docs: DataFrame, model: Model, out: str, column: str = "text") -> DataFrame:
    """``docs`` with a struct ``out`` of lang, score and accepted.

    Null texts and texts without letters are ``und`` with score 0. ``out`` must be a free name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang", "score", "accepted"])

    return docs.withColumn(out, label(column))


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of ``docs`` (doc_id, text, lang).

    A prediction is made of the whole text alone. ``accepted`` is false for ``und`` and for texts with fewer
    known subwords than the calibrated limit. Repeated rows are predicted each by itself; without any training
    row all are ``und``. A very long text is read in chunks. A table without rows gives none, other columns are
    ignored.
    """
    out = predict(docs.select("doc_id", "text"), train(docs, params), "p")
    return out.select("doc_id", held_out().alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


def keep_identified(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` without the rows that language identification rejects (null texts too); all columns stay, whatever their names.

    Ids play no part but for the training sample; repeated rows stay or go each by itself, an empty table
    stays empty, and texts of any length are read whole.
    """
    (name,) = free(docs, "_predicted")
    return predict(docs, train(docs, params), name).where(F.col(f"{name}.accepted")).select(*docs.columns)

"""Order MinHash fingerprints: signatures that follow edit distance, not only the set of k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import partitions, text_or_empty

#: Code points of a k-mer, k-mers of a tuple, tuples of a signature (a power of two).
K, TUPLE, SIZE = 6, 2, 128
#: Bytes of text of a bucket of neighbours, and most tasks that the buckets are dealt to.
BUCKET, TASKS = 64 << 20, 20_000
_MUL, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading bits of ``x`` in ascending order, and the places they come from, equal ones in text order."""
    bits = np.uint64(max(24, len(x).bit_length()))
    both = np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64))
    return both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def signature(points: np.ndarray) -> np.ndarray:
    """Order MinHash of a text given as code points: SIZE unsigned 16-bit values.

    Each k-mer is hashed with the number of its occurrence. SIZE marks divide the hashes' range; at each
    the TUPLE smallest hashes from the mark on are selected (past the greatest, the smallest of all follow),
    put back in text order and hashed together. So the marks of a short text share k-mers, and all keep
    their order. A text shorter than a k-mer is one k-mer; an empty text has only zeros.
    """
    n = len(points)
    if not n:
        return np.zeros(SIZE, np.uint16)
    k = min(K, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * _MUL + points[j : n - k + 1 + j]
    h = _mix(h + np.uint64(k))
    key, place = _ordered(h)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.arange(len(h))
    number = np.empty(len(h), np.uint64)
    number[place] = at - np.maximum.accumulate(np.where(first, at, 0))
    g = _mix(h + number * _STEP)
    key, place = _ordered(g)
    bits = np.uint64(max(24, len(g).bit_length()))
    marks = np.searchsorted(key, np.arange(SIZE, dtype=np.uint64) << (np.uint64(64) - np.uint64(SIZE.bit_length() - 1) - bits))
    places = place[(marks[:, None] + np.arange(min(TUPLE, len(key)))) % len(key)]
    places.sort(axis=1)
    out = np.zeros(SIZE, np.uint64)
    for j in range(places.shape[1]):
        out = _mix(out * _MUL + g[places[:, j]])
    return (out >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples among those that either text has; two empty texts are alike."""
    used = (a != 0) | (b != 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; a null text counts as empty."""

    @F.pandas_udf("string")
    def hexes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([signature(codes(t)).tobytes().hex() for t in batch], dtype="object")

    text = text_or_empty()
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), hexes(text).alias("fingerprint"))


class Edges:
    """First rows (doc_id, hash of the text) of buckets, ascending; null doc_ids come first."""

    def __init__(self, firsts: list[tuple[int | None, int]]) -> None:
        firsts = sorted(firsts, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        self.firsts = firsts
        self.nulls = np.array([h for d, h in firsts if d is None], np.int64)
        self.ids = np.array([d for d, _ in firsts if d is not None], np.int64)
        self.hashes = np.array([h for d, h in firsts if d is not None], np.int64)

    def buckets(self, ids: pd.Series, hashes: np.ndarray) -> np.ndarray:
        """Number of each row's bucket: how many first rows lie at it or before it, less one."""
        known = ids.notna().to_numpy()
        out = np.searchsorted(self.nulls, hashes, side="right")
        own, h = ids[known].to_numpy(np.int64), hashes[known]
        low, high = np.searchsorted(self.ids, own, side="left"), np.searchsorted(self.ids, own, side="right")
        for k in np.unique(low[high > low]):  # ids that several buckets share, or that begin one
            rows = (low == k) & (high > low)
            high[rows] = k + np.searchsorted(self.hashes[k : high[rows][0]], h[rows], side="right")
        out[known] = len(self.nulls) + high
        return np.maximum(out - 1, 0).astype(np.int32)


def edges(docs: DataFrame, size: int | None = None) -> Edges:
    """First rows of buckets of about ``size`` bytes of text each, or of one longer text.

    Ids and sizes are dealt by ranges of (doc_id, hash) and sorted; along each range a bucket begins wherever
    the bytes so far reach the next multiple of ``size``. So buckets grow in number with the data and not in
    size; one pair of numbers a bucket comes to the driver.
    """
    size, order = size or BUCKET, [F.col("doc_id").asc_nulls_first(), F.col("h")]
    narrow = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("h"), (F.octet_length(text_or_empty()) + 1).cast("long").alias("n"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, number = 0, -1
        for batch in batches:
            before = total + np.cumsum(batch["n"].to_numpy()) - batch["n"].to_numpy()
            total += int(batch["n"].sum())
            own = before // size
            begins = np.flatnonzero(own > np.concatenate(([number], own[:-1])))
            number = int(own[-1]) if len(own) else number
            yield batch.iloc[begins][["doc_id", "h"]].astype({"doc_id": "Int64"})

    firsts = narrow.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).mapInPandas(cut, "doc_id long, h long")
    return Edges([(r["doc_id"], r["h"]) for r in firsts.distinct().collect()])


def with_next(docs: DataFrame, found: Edges) -> DataFrame:
    """(bucket, doc_id, ahead, text): documents in buckets of ascending doc_id, each with its first follower.

    The first row of a bucket also goes, marked ahead, to the end of the bucket before it (of the first bucket
    to the last), which is one more text a bucket. Null doc_ids come first; rows with one doc_id follow by
    text hash, and spread over buckets like others.
    """
    spark = docs.sparkSession

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(found.buckets(ids, hashes.to_numpy(np.int64)))

    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    own = rows.select(bucket("doc_id", "h").alias("bucket"), "doc_id", F.lit(0).alias("ahead"), "text")
    n = len(found.firsts)
    sent = spark.createDataFrame([(d, h, (k - 1) % n) for k, (d, h) in enumerate(found.firsts)], "_first long, _h long, bucket int")
    ahead = rows.join(F.broadcast(sent), F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("h") == F.col("_h")))  # one row a bucket
    return own.union(ahead.select("bucket", "doc_id", F.lit(1), "text").dropDuplicates(["bucket", "doc_id", "text"]))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of
    the next document, by ascending doc_id, the last being followed by the first. A lone document follows
    itself. Buckets are streamed in order, two texts in memory at a time. Null texts count as empty, rows
    that share a doc_id follow each other by text, other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in batches:
            out = []
            for bucket, doc, ahead, text in zip(*(batch[c].tolist() for c in ("bucket", "doc_id", "ahead", "text"))):
                if held and held[0] == bucket and not held[2]:
                    points = codes(text)
                    own = signature(points)
                    _, own_doc, _, own_text, own_points, own_sign = held
                    n = len(own_text)
                    half = n // 2
                    edited = own_text[: n - half] + text[:half]
                    sign = signature(np.concatenate((own_points[: n - half], points[:half])))
                    out.append((own_doc if own_doc == own_doc else None, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_sign.tobytes().hex(), sign.tobytes().hex(), likeness(own_sign, sign), likeness(own_sign, own)))
                    held = bucket, doc, ahead, text, points, own
                elif not (ahead and held and held[0] == bucket):  # a bucket begins
                    points = codes(text)
                    held = bucket, doc, ahead, text, points, signature(points)
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    found = edges(docs)
    tasks = max(3 * partitions(docs.sparkSession), min(len(found.firsts), TASKS))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, found).repartition(tasks, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", F.xxhash64("text"), "text").mapInPandas(run, schema)

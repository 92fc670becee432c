"""Periodic runs of words: stretches that repeat with some period at least four times.

Every word of such a run comes back in it at least four times. So words that are too rare in the segment they are
in split it, and the parts, in which other words may be too rare now, are split again until nothing changes. What
is left is scanned by lags: for lags from Q to 2Q - 1 a run holds whole aligned blocks of Q words twice, a lag
apart, so hashes of blocks name the few places where words are then compared one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty

#: Least periods in a run, and least words.
PERIODS, LEAST = 4, 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: An odd factor of the blocks' rolling hash, and the seed of the words' random numbers.
FACTOR, SEED = 0x9E3779B97F4A7C15, 13


def split(words: np.ndarray) -> list[tuple[int, int]]:
    """Segments (start, end) of word numbers that can hold runs: in each, every word comes four times at least.

    A round counts each word within its segment; those that are too rare split it, and parts under the least
    length go. Segments in which nothing was too rare are done, the others are counted again.
    """
    done: list[tuple[int, int]] = []
    at = np.arange(len(words))
    segment = np.zeros(len(words), np.int64)
    while len(at):
        order = np.lexsort((words[at], segment))
        same = (np.diff(segment[order]) == 0) & (np.diff(words[at][order]) == 0)
        group = np.concatenate([[0], np.cumsum(~same)])
        rare = np.empty(len(at), bool)
        rare[order] = np.bincount(group)[group] < PERIODS
        first = np.concatenate([[True], np.diff(segment) != 0])
        number = np.cumsum(first) - 1
        touched = np.bincount(number, rare) > 0
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(at))
        done += [(int(at[s]), int(at[e - 1]) + 1) for s, e in zip(starts[~touched], ends[~touched])]
        keep = touched[number] & ~rare
        at, number = at[keep], number[keep]
        if len(at):
            part = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(number) != 0)])
            segment = np.cumsum(part)
            size = np.bincount(segment)
            keep = size[segment] >= LEAST
            at, segment = at[keep], segment[keep]
    return sorted(s for s in done if s[1] - s[0] >= LEAST)


def _stretches(match: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of true places, at least ``least`` long."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], match.view(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]


def scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``words``, by start and period.

    A run of period q has at least 3q places whose word comes again q later, so for Q <= q < 2Q it holds two
    aligned blocks of Q such places in a row. Blocks are compared with what lies q later by a rolling hash, all
    lags of a class at once; where two blocks in a row agree, the words themselves decide. A lag whose agreeing
    places lie within a run of a period that divides it is not looked at again: a stretch that shares q places
    with that run has its period too.
    """
    n = len(words)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    names = np.random.default_rng(SEED).integers(1, 1 << 63, int(words.max()) + 1, np.uint64) if n else words
    power = np.cumprod(np.full(n + 1, FACTOR, np.uint64)) if n else words
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names[words] * power[:n])]) if n else words

    def compare(lag: int, low: int, high: int) -> None:
        """Note the runs of period ``lag`` whose agreeing places touch low to high, which they leave by less than a block."""
        low, high = max(0, low), min(n - lag, high)
        if high > low:
            for s, e in _stretches(words[low:high] == words[low + lag : high + lag], max(LEAST, PERIODS * lag) - lag):
                found.setdefault((low + s, low + e + lag), lag)

    def outside(lag: int, low: int, high: int) -> list[tuple[int, int]]:
        """What of low to high isn't explained by a known run whose period divides the lag."""
        own = (lag % period == 0) & (start < high) & (end - lag > low) & (np.minimum(end, high + lag) - np.maximum(start, low) >= lag)
        left = [(low, high)]
        for s, e in zip(start[own].tolist(), end[own].tolist()):
            left = [x for a, b in left for x in ((a, min(b, s)), (max(a, e - lag), b)) if x[1] > x[0]]
        return left

    for lag in range(1, min(4, n // PERIODS + 1)):
        compare(lag, 0, n)
    block = 4
    while block <= n // PERIODS:
        rows = n // block - 1  # aligned blocks with a whole block of lags after them
        window = sums[block:] - sums[:-block]
        ahead = window[block : block + rows * block]
        ahead = np.concatenate([ahead, np.zeros(rows * block - len(ahead), np.uint64)]).reshape(rows, block)
        shift = power[block - 1 : 2 * block - 1]  # FACTOR to each lag of the class
        same = window[: rows * block : block, None] * shift[None, :] == ahead
        row, k = np.nonzero(same[:-1] & same[1:])
        if len(row):
            order = np.lexsort((row, k))
            row, k = row[order], k[order]
            start, end, period = np.array([(*x, p) for x, p in found.items()], np.int64).reshape(-1, 3).T  # of smaller lags than the class's
            cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(row) != 1)) + 1
            for i, j in zip([0, *cut.tolist()], [*(cut - 1).tolist(), len(row) - 1]):
                lag, low, high = block + int(k[i]), int(row[i]) * block, (int(row[j]) + 2) * block
                for a, b in outside(lag, low, high):
                    compare(lag, a - block, b + block)
        block *= 2
    return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's word numbers, by start and period."""
    return [(low + s, n, q) for low, high in split(words) for s, n, q in scan(words[low:high])]


def find_runs(docs: DataFrame) -> DataFrame:
    """Every document's periodic runs of words: doc_id, n_words, runs (start, length, period), collapsed.

    Words are what lies between ASCII white space, numbered from 0. A run is a stretch with smallest period q that
    no neighbouring word continues, of at least 4q and 6 words; runs come by start, then period. ``collapsed``
    holds the words that no run has after its first q, joined by a space. Null and empty texts have no words and
    no runs. Repeated rows and null ids are searched each; an empty table gives none; other columns, of any name,
    are ignored. Rows stay in the task that reads them; a very long text is searched whole in one task, in time
    near its length (by sorting, and by its length times the logarithm of it for the lags).
    """

    def one(text: str):
        numbers: dict[str, int] = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for w in WORD.findall(text)], np.int64)
        runs = runs_of(words)
        if not runs:
            return len(words), runs, " ".join(map(list(numbers).__getitem__, words.tolist()))
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edge[s + q] += 1
            edge[s + n] -= 1
        return len(words), runs, " ".join(map(list(numbers).__getitem__, words[np.cumsum(edge[:-1]) == 0].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(t) for t in batch.column("text").to_pylist()]
            flat = np.array([r for d in done for r in d[1]], np.int64).reshape(-1, 3)
            runs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], ["start", "length", "period"])
            ends = np.cumsum([0, *(len(d[1]) for d in done)]).astype(np.int32)
            columns = [batch.column("doc_id"), pa.array([d[0] for d in done], pa.int64()), pa.ListArray.from_arrays(ends, runs), pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tenth of the texts made periodic: of n words those from a on repeat the p words at a.

    With h = crc32 of the decimal doc_id and g = floor(h / 10), texts with h % 10 = 0 and words change; a = g % n
    and p = 1 + floor((n - a) / (3 + g % 8)). Null ids leave their text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_words")
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    cut = docs.select("doc_id", "text", words.alias("_words"))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cut = cut.select("doc_id", "text", "_words", F.when(n > 0, a).alias("_a"), F.when(n > 0, p).alias("_p"))
    made = F.array_join(F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p")))), " ")
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row a document of ``find_runs``: its number of runs, the run of the greatest exponent, and digests.

    The exponent is length by period, compared exactly; of equals the run with the smallest start, then period.
    Returns doc_id, n_runs, start, length, period, exponent_milli (null without runs), runs_sha256, collapsed_sha256.
    """
    better = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), better.alias("_best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    top = [F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")]
    return rows.select("doc_id", "n_runs", *top, F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Near copies by exact Jaccard similarity of word shingles, found by SimHash and completed by MinHash bands.

Links are found in two steps. Every class (a shingle set) is first compared with what the trie self-join of
SimHash fingerprints links it to, and with one member of each band value that it shares; that joins most of a
group by about as many comparisons as it has members. A pair at 0.8 differs in some ten bits of a fingerprint
and not in three, so the bands are what makes the search whole. Where members of a
band value are in different groups then, their pairs across groups are compared too: all of them where few
classes have the value, else those that share a shingle rare enough that a similarity of 0.8 needs it, so that
many texts with one passage in common aren't paired all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_key, components, free, materialise, text_or_empty
from .simhash import hamming_links

#: Words of a shingle. Two texts are near copies from a Jaccard similarity of 0.8 (4/5) on.
WORDS = 5
#: Bands of so many minima each: a pair at 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Bits of a set's parities, in powers of two: each shingle turns over one bit.
PARITY = 11
#: Classes of a band value whose pairs across groups are all compared.
BUCKET = 32
#: Bits of the numbers by whose frequency the shingles of large band values are ordered.
ORDER = 18
#: Classes whose keys are sent to every task, so that no text is moved to be found; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Shingle sets that a Python worker holds at once.
SETS = 200

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of ``text``.

    Only A-Z are lower-cased, words are runs without ASCII white space; a text of fewer words is one
    shingle, a text without words has none.
    """
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= WORDS:
        return np.array([digest(line)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist())], dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least hash under each of the multipliers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[k : k + 2048, None] * _FACTORS).min(axis=0))
    return least


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value a band from its minima; none for an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    return (minima(hashes).reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """The set's parities as whole numbers of 64 bits: two sets differ in at least as many shingles as bits."""
    places = ((hashes * _MIX[0, 0]) >> np.uint64(64 - PARITY)).astype(np.int64)
    odd = (np.bincount(places, minlength=1 << PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set as a signed integer: a bit is set if it is in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _named(hashes: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, s1, s2, n, fp, bands, bits) of every row: hash of the text, 128-bit hash, size and fingerprint of its shingle set."""

    def sketched(text: str) -> tuple:
        found = shingles(text)
        return *_named(found), len(found), fingerprint(found), bands(found), parities(found)

    @F.pandas_udf("s1 long, s2 long, n int, fp long, bands array<long>, bits array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([sketched(t) for t in batch], columns=["s1", "s2", "n", "fp", "bands", "bits"])

    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), sketch(text_or_empty()).alias("s")).select("doc_id", "th", "s.*")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, set): the shingle sets of the classes in ``wanted`` (c, s1, s2, doc_id, th), from one text each."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), SETS):  # sets are larger than texts
                sets = [shingles(t) for t in batch["text"].iloc[k : k + SETS]]
                yield pd.DataFrame([(*_named(s), s.view(np.int64)) for s in sets], columns=["s1", "s2", "set"])

    hint = F.broadcast if wanted.count() <= BROADCAST else (lambda df: df)
    texts = docs.select(F.col("doc_id").alias("d"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    w = hint(wanted.select(F.col("doc_id").alias("w"), F.col("th").alias("wt")))
    texts = texts.join(w, F.col("d").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wt")), "left_semi")
    found = texts.select("text").mapInPandas(made, "s1 long, s2 long, set array<long>").join(hint(wanted.select("c", "s1", "s2")), ["s1", "s2"])
    return found.groupBy("c").agg(F.first("set").alias("set"))  # repeated rows give one set again and again


def _sized(a: str, b: str) -> Column:
    """Whether two sizes allow a similarity of 0.8."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _few_differ(x: str, y: str, nx: str, ny: str) -> Column:
    """Whether the parities allow a similarity of 0.8: sets of sizes nx and ny then differ in (nx + ny) / 9 shingles at most."""
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, k: s + k)
    return 9 * differ <= F.col(nx) + F.col(ny)


def _hopeful(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities allow a similarity of 0.8."""
    x = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bits").alias("u"))
    y = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("v"))
    return pairs.join(x, "a").join(y, "b").where(_few_differ("u", "v", "na", "nb")).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    x = sets.select(F.col("c").alias("a"), F.col("set").alias("sa"))
    y = sets.select(F.col("c").alias("b"), F.col("set").alias("sb"))
    met = pairs.join(x, "a").join(y, "b")
    return met.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _places(hashes: np.ndarray) -> np.ndarray:
    return ((hashes.view(np.uint64) * _MIX[0, 1]) >> np.uint64(64 - ORDER)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of all ``sets`` fall to each of the 2^``ORDER`` numbers that their hashes have."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << ORDER, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_places(np.concatenate(batch["set"].to_list())), minlength=1 << ORDER)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"b": some, "f": total[some]})

    found = sets.select("set").mapInPandas(counted, "b long, f long").groupBy("b").agg(F.sum("f").alias("f")).toPandas()  # one row a number
    out = np.zeros(1 << ORDER, np.int64)
    out[found["b"].to_numpy(np.int64)] = found["f"].to_numpy(np.int64)
    return out


def _by_rare_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups among ``members`` (c, n, group, bits) that may have a similarity of 0.8.

    A set's shingles are ordered by how often their number occurs, the rarest first; any order common to all
    sets is right, a rare beginning makes few pairs. Two sets at 0.8 share a shingle among the first
    n - ceil(8n/9) + 1 of the smaller and the first n - ceil(4n/5) + 1 of the larger; at the first that they
    share, what follows it in both must still hold the overlap that 0.8 asks for. The join itself compares
    parities, so that texts just below the limit make no rows.
    """
    shared = members.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), SETS):
                own = batch.iloc[k : k + SETS]
                first = [s[np.lexsort((s, shared.value[_places(s)]))][: len(s) - -(-4 * len(s) // 5) + 1] for s in own.pop("set")]
                rows = own.loc[own.index.repeat([len(t) for t in first])]
                yield rows.assign(own=rows["n"] - -(-8 * rows["n"] // 9) + 1, at=np.concatenate([np.arange(len(t)) for t in first]), t=np.concatenate(first))

    held = members.join(sets, "c").select("c", "n", "group", "bits", "set")
    ranked = materialise(held.mapInPandas(beginnings, "c long, n int, group long, bits array<long>, own int, at int, t long"))
    x, y = ranked.alias("x"), ranked.where("at < own").alias("y")
    needed = F.ceil(4 * (F.col("x.n").cast("long") + F.col("y.n")) / 9)
    met = x.join(y, F.col("x.t") == F.col("y.t")).where(
        (F.col("x.group") != F.col("y.group")) & (F.struct("y.n", "y.c") < F.struct("x.n", "x.c")) & _sized("x.n", "y.n")
        & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= needed) & _few_differ("x.bits", "y.bits", "x.n", "y.n")
    )
    return met.select(*_ordered("x.c", "y.c")).distinct()


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that SimHash links: classes with one fingerprint, and the trie self-join's links at three bits."""
    prints = materialise(classes.groupBy("fp").agg(F.min("c").alias("rep")))
    same = classes.join(by_key(prints), "fp").where("c <> rep").select(*_ordered("c", "rep"))
    return same.union(hamming_links(prints).select(*_ordered("a", "b")))


def _merged(named: DataFrame, rest: DataFrame) -> DataFrame:
    """Groups (node, component) after the links ``rest`` (a, b) are added: only the groups that they join are walked."""
    if rest.isEmpty():
        return named
    x, y = (named.select(F.col("node").alias(k), F.col("component").alias(f"g{k}")) for k in "ab")
    joined = rest.join(by_key(x), "a", "left").join(by_key(y), "b", "left")
    over = components(joined.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))
    alone = over.join(by_key(named), "node", "left_anti")
    over = over.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return named.join(by_key(over), "component", "left").select("node", F.coalesce("to", "component").alias("component")).union(alone)


def groups(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of all classes that a chain of near copies joins to others, named by the smallest.

    ``classes`` has (c, s1, s2, doc_id, th, n, fp, bands, bits), one row a shingle set. The member that a band
    value's classes are compared with first is that of the smallest hash, so that the bands of a group mostly
    agree on it.
    """
    keyed = classes.select("c", "n", F.posexplode("bands").alias("band", "value")).select("c", "n", F.xxhash64("band", "value").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("c").alias("h"), "c", "n")).alias("pivot")).where("m > 1")
    keyed = materialise(keyed.join(by_key(sizes), "key").select("key", "c", "n", "m", F.col("pivot.c").alias("p"), F.col("pivot.n").alias("pn")))
    bits = classes.select("c", "n", "bits")

    def verified(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        hopeful = materialise(_hopeful(pairs, bits))
        if hopeful.isEmpty():
            return hopeful
        if sets is None:
            ends = hopeful.select(F.col("a").alias("c")).union(hopeful.select(F.col("b").alias("c"))).distinct()
            sets = materialise(_sets(docs, materialise(classes.join(ends, "c", "left_semi").select("c", "s1", "s2", "doc_id", "th"))))
        return materialise(_similar(hopeful, sets))

    star = keyed.where((F.col("c") != F.col("p")) & _sized("n", "pn")).select(*_ordered("c", "p")).distinct()
    found = verified(materialise(star.union(_by_fingerprint(classes)).distinct()))
    named = components(found)
    held = materialise(keyed.join(by_key(named), keyed["c"] == named["node"], "left").select("key", "c", "n", "m", F.coalesce("component", "c").alias("group")))
    split = held.groupBy("key").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 <> g1").select("key")
    held = materialise(held.join(by_key(split), "key", "left_semi"))
    few, many = held.where(F.col("m") <= BUCKET), held.where(F.col("m") > BUCKET).select("c", "n", "group").distinct()
    x, y = few.alias("x"), few.alias("y")
    met = x.join(by_key(y), F.col("x.key") == F.col("y.key")).where((F.col("x.group") < F.col("y.group")) & _sized("x.n", "y.n"))
    rest = verified(met.select(*_ordered("x.c", "y.c")).distinct())
    if not many.isEmpty():
        many = materialise(many.join(bits.select("c", "bits"), "c"))
        sets = materialise(_sets(docs, materialise(classes.join(many, "c", "left_semi").select("c", "s1", "s2", "doc_id", "th"))))
        rest = rest.union(verified(_by_rare_shingles(many, sets), sets))
    return _merged(named, rest)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, group) of every row: its text's hash and its group of near copies (a chain of pairs at 0.8 or more).

    Texts with equal shingle sets are one class before any pair is formed; null texts count as empty, and
    texts without words are one group. Ids, null and repeated ones too, play no part in the grouping.
    """
    base = materialise(_sketches(docs))
    classes = base.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th", "n", "fp", "bands", "bits")).alias("r")).select("s1", "s2", "r.*")
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()))
    named = groups(docs, classes)
    of_set = classes.join(by_key(named), classes["c"] == named["node"], "left").select("s1", "s2", F.coalesce("component", "c").alias("group"))
    return base.select("doc_id", "th", "s1", "s2").join(by_key(of_set), ["s1", "s2"]).select("doc_id", "th", "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, the first by doc_id (null last) and hash of the text.

    All columns stay, whatever their names; rows equal in doc_id and text are one. Null and empty texts are
    one group, and an empty table stays empty. Very long texts are cut into shingles whole, in a task's memory.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    groups = near_copies(docs.select("doc_id", "text")).groupBy("group").agg(F.min(order).alias("k"))
    own, d, t = free(docs, "_th", "_d", "_t")
    kept = materialise(groups.select(F.col("k.doc_id").alias(d), F.col("k.th").alias(t)))
    rows = docs.withColumn(own, F.xxhash64(text_or_empty()))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(t)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).select(*docs.columns)

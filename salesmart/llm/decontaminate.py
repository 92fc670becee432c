"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

DataFrame functions only. The test items are partitioned by their number of distinct shingles, in powers of
two. An item's sketch is its smallest shingle hashes; how many depends on its partition: as many as the
partition's largest item may lack at the threshold, and one. A document at the threshold lacks fewer than
the sketch has, so it holds a sketched hash, and the search loses nothing. Documents are probed with the
hashes of their shingles up to the greatest one sketched; only candidate documents are cut into shingles
again, as texts, and counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import free, materialise

#: Words of a shingle and the share of an item's shingles that a document must hold.
WORDS, THRESHOLD = 5, 0.8
#: Items whose shingles are at most so many in all are sent to every task; more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000


def words() -> F.Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(width: int, of=lambda s: s, empty: str = "string") -> F.Column:
    """``of`` the shingles of ``width`` words of the column ``w``; none where it has fewer."""
    return F.when(
        F.size("w") >= width,
        F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: of(F.array_join(F.slice("w", i, width), " "))),
    ).otherwise(F.array().cast(f"array<{empty}>"))


def item_shingles(benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, width, n, size_class, s, h, sketched): the distinct shingles of each item.

    An item of fewer than five words is one shingle of all its words; null and wordless items have none.
    Rows with the same item_id are one item, with the shingles of all of them.
    """
    items = benchmark.select("item_id", words().alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.size("w"), F.lit(WORDS)))
    parts = items.select("item_id", "width", F.explode(F.when(F.size("w") < WORDS, F.array(F.array_join("w", " "))).otherwise(_shingles(WORDS))).alias("s"))
    parts = parts.distinct().withColumn("h", F.xxhash64("s"))
    sized = parts.groupBy(F.col("item_id").alias("_item")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.join(sized, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    parts = parts.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    top = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    length = F.greatest(*(n - F.ceil(n * F.lit(threshold)) + 1 for n in (top, F.col("n"))))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "s"))
    return parts.withColumn("sketched", rank <= length)


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) pairs in which the document holds a hash of the item's sketch."""

    def upto(hashes: F.Column, cut: int) -> F.Column:
        return F.filter(hashes, lambda h: h <= cut)

    sketches = items.where("sketched")
    bounds = sketches.groupBy("width").agg(F.max("h").alias("cut"), F.count(F.lit(1)).alias("n")).orderBy("width").collect()  # at most five widths
    base = docs.select("doc_id", words().alias("w"))
    found = None
    for width, cut, _ in bounds:
        at = base.select("doc_id", F.explode(upto(_shingles(width, F.xxhash64, "bigint"), cut)).alias("h"))
        found = at if found is None else found.union(at)
    if found is None:
        return docs.select("doc_id").join(items.select("item_id"), F.lit(False))
    keys = sketches.select("h", "item_id")
    if sum(n for _, _, n in bounds) <= BROADCAST_SHINGLES:
        return found.join(F.broadcast(keys), "h").select("doc_id", "item_id").distinct()
    return found.join(keys, "h").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair that reaches ``threshold``.

    Null and empty texts hold nothing; rows with one doc_id count as one document with all their
    shingles; rows with a null doc_id are one document. Extra columns are ignored; without documents or
    items there is no pair. Very long texts are cut into shingles whole, in a task's memory.
    """
    items = materialise(item_shingles(benchmark, threshold))
    return verify(docs, materialise(candidates(docs, items)), items, threshold)


def verify(docs: DataFrame, found: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Count the item's shingles in each candidate document, exactly."""
    wanted = items.join(found.select(F.col("item_id").alias("_i")).distinct(), F.col("item_id").eqNullSafe(F.col("_i")), "left_semi")
    total, widths = wanted.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("width"))).first()  # at most five widths
    hint = F.broadcast if total <= BROADCAST_SHINGLES else (lambda df: df)
    hit = found.select(F.col("doc_id").alias("_d")).distinct()
    base = docs.select("doc_id", "text").join(hit, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").select("doc_id", words().alias("w"))
    parts = F.array_distinct(F.flatten(F.array(*map(_shingles, widths or [WORDS]))))
    held = base.select("doc_id", F.explode(parts).alias("s")).withColumn("h", F.xxhash64("s"))
    # a document's rows may repeat a shingle, which counts once
    held = held.join(hint(wanted.select("h", "s").distinct()), ["h", "s"], "left_semi").distinct()
    held = held.join(hint(wanted.select("h", "s", "item_id", "n")), ["h", "s"]).groupBy("doc_id", "item_id").agg(F.first("n").alias("n_shingles"), F.count(F.lit(1)).alias("n_shared"))
    p = found.select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i"))
    held = held.join(p, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("item_id").eqNullSafe(F.col("_i")), "left_semi")
    return held.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold))).select(
        "doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose document holds a benchmark item; all columns stay, whatever their names.

    Documents are told apart by doc_id: repeated rows go or stay together, null ids are one document. Null
    and empty texts stay; an empty table stays empty.
    """
    (name,) = free(docs, "_hit")
    hit = contained(docs.select("doc_id", "text"), benchmark, threshold).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")

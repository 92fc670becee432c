"""Helpers shared by the corpus operators: written tables, salted ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


#: Bytes of an Arrow batch of texts, in place of Spark's default, which a few Python workers of an executor don't hold.
BATCH, _BATCH_KEY, _BATCH_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for a Spark context, as --py-files would.

    Also bounds the session's Arrow batches by ``BATCH`` bytes, where the session has no bound of its own.
    """
    if spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH)
    context = spark.sparkContext
    if getattr(context, "_corpus_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="salesmart-")) / "salesmart_llm.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((top / "salesmart").rglob("*.py")):
            z.write(f, f.relative_to(top))
    context.addPyFile(str(out))
    context._corpus_shipped = True


def work_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The setting is read from the session. Only on one machine (a local master, as in tests) a temporary
    folder takes its place where it is unset; a cluster without it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='salesmart-')}"
    return f"{base.rstrip('/')}/salesmart-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt out by key, however small it is.

    Spark sends a small side to every task, and builds it as a table of megabytes in the driver first. In the many
    short joins of a search these tables would be most of what the driver's memory holds.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def dense_rank_salted(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without bringing a hot key into one task.

    Rows are numbered inside (key, salt), the salt being a hash of the ordering columns, and each salt
    starts where the one before it ends. The order is fixed by salt, then by ``order``. There are 256
    salts, or as many as shuffle partitions if that is more. ``out`` must be a free name.
    """
    salts = salts or max(256, partitions(df.sparkSession))
    salt, size, start, mine = free(df, "_salt", "_n", "_start", "_own")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, salt, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    own = Window.partitionBy(*keys, salt).orderBy(*order)
    numbered = salted.withColumn(mine, F.row_number().over(own) - 1)
    on = [numbered[k].eqNullSafe(starts[k]) for k in [*keys, salt]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return numbered.join(starts, cond, "inner").select(
        *[numbered[c] for c in df.columns], (numbered[mine] + starts[start]).cast("long").alias(out)
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) by alternating large-star and small-star rounds.

    Returns (node, component) for every node of an edge, the component being its smallest node. Each
    round is written to the shared folder. Hub nodes are aggregated by map-side minima, and the joins
    back are ordinary shuffle joins that adaptive execution can split.
    """
    def directed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialise(directed(edges))
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = now.select(F.inline(ways))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = directed(both.join(by_key(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(by_key(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(directed(small.union(least.select("a", F.col("m").alias("b")))))
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

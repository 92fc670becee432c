"""Token shards in training order: a keyed Feistel permutation gives each sequence its place, range partitions write them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialise, partitions, work_dir
from .tokens import END, pieces

#: Tokens of a sequence (the stride of a shard's records), sequences of a shard, shards of a file.
STRIDE, SHARD, WIDTH = 2048, 512, 16
#: Rounds of the Feistel network.
ROUNDS = 6
SCHEMA = "slot long, shard long, doc_id long, piece int, length long, ids binary"


def _round(half: np.ndarray, key: int, r: int) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1: a balanced Feistel network, walked along its cycle until below n."""
    bits = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> bits, x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, r) & low)
        out[todo] = (left << bits) | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def _stored(rows: DataFrame, path: str) -> str:
    """Write ``rows`` at ``path`` as a table bucketed by ``part``, the partition that made them; returns its name.

    A partition is one file of one bucket, so that a join by part needn't move the rows.
    """
    name = f"pieces_{path.rsplit('-', 1)[-1]}"
    rows.write.format("parquet").bucketBy(partitions(rows.sparkSession), "part").option("path", path).saveAsTable(name)
    return name


def numbered(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(part, at, m) of every row, m >> 33 being a range of the order and m's low bits the place in it; and the ranges' starts.

    The order is by doc_id (null first), piece and the ids' hash. Rows that agree in all of them are alike,
    so that another layout of the input gives the same order. One count a range reaches the driver.
    """
    keys = ["doc_id", "piece", "h", "part", "at"]
    narrow = rows.select("doc_id", "piece", F.xxhash64("ids").alias("h"), "part", "at")
    ranged = narrow.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    ranged = materialise(ranged.select("part", "at", F.monotonically_increasing_id().alias("m")))
    sizes = ranged.groupBy(F.shiftright("m", 33).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(max([r["r"] for r in sizes], default=0) + 1, np.int64)
    for r in sizes:
        counts[r["r"]] = r["n"]
    return ranged, np.concatenate(([0], np.cumsum(counts)))


def write_shards(docs: DataFrame, path: str, key: int = 20240229, stride: int = STRIDE, shard: int = SHARD, width: int = WIDTH, vocabulary: str = "byte_bpe_50k") -> int:
    """Write all sequences of ``docs`` to ``path`` in training order; returns their number.

    A record is one sequence: slot, shard, doc_id, piece, length and its token ids, little-endian
    unsigned 16-bit, padded with the end id to ``stride``. Sequences are numbered densely in order of
    doc_id, piece and content, whatever the input's layout, and the permutation turns the number into the
    slot. Shard k holds the slots from k*shard on; ``width`` shards make a range, which is a folder of one
    file (first=<its first slot>), sorted by slot, with a row group for about a shard. Range partitions
    write the ranges. Null texts are one sequence of the end id; repeated rows and null ids are written
    each; very long texts are tokenized whole in a task's memory; other columns are ignored. An empty
    table writes no record.
    """
    spark = docs.sparkSession
    rows = pieces(docs, stride, vocabulary, payload=True).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "piece", "length", "ids", F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    table = _stored(rows, work_dir(spark))
    rows = spark.table(table)
    ranged, starts = numbered(rows)
    n = int(starts[-1])

    @F.pandas_udf("long")
    def slot(m: pd.Series) -> pd.Series:
        x = m.to_numpy(np.int64)
        return pd.Series(permute(starts[x >> 33] + (x & ((1 << 33) - 1)), n, key))

    def pad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        end = np.array([END], "<u2").tobytes()
        for batch in batches:
            yield batch.assign(ids=[(ids := unpack(x)) + end * (stride - len(ids) // 2) for x in batch["ids"]]).astype({"doc_id": "Int64"})

    # one row a partition of the input, its slots in order of place
    slots = ranged.select("part", F.struct("at", slot("m").alias("slot")).alias("x")).groupBy("part").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["slot"]).alias("slots"))
    placed = rows.join(slots, "part").withColumn("slot", F.element_at("slots", (F.col("at") + 1).cast("int")))
    own = shard * width
    placed = placed.select("slot", F.floor(F.col("slot") / shard).cast("long").alias("shard"), "doc_id", "piece", "length", "ids", (F.floor(F.col("slot") / own) * own).cast("long").alias("first"))
    tasks = min(-(-n // own), max(4 * partitions(spark), n * stride * 2 >> 27)) or 1
    ordered = placed.repartitionByRange(tasks, "first").mapInPandas(pad, f"{SCHEMA}, first long").sortWithinPartitions("first", "slot")
    ordered.write.option("compression", "zstd").option("parquet.block.size", max(1 << 16, shard * stride * 2)).partitionBy("first").parquet(path)
    spark.sql(f"DROP TABLE {table}")
    return n


def read_shards(spark, path: str, first: int = 0, last: int | None = None, shard: int = SHARD, width: int = WIDTH) -> DataFrame:
    """The records at ``path`` from slot ``first`` on (to ``last``, not included): a reader that stopped resumes at its slot.

    Ranges that lie outside are folders that aren't opened. Within a file records are in order of slot.
    """
    out = spark.read.schema(f"{SCHEMA}, first long").parquet(path)
    if first:
        out = out.where((F.col("first") > first - shard * width) & (F.col("slot") >= first))
    if last is not None:
        out = out.where((F.col("first") < last) & (F.col("slot") < last))
    return out.drop("first")


def sequences(spark, path: str, first: int = 0, shard: int = SHARD, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) of the records at ``path`` in training order from slot ``first`` on, a range in memory at a time."""
    own = shard * width
    at = first
    while True:
        rows = read_shards(spark, path, at, at // own * own + own, shard, width).select("slot", "ids").collect()
        if not rows:
            return
        yield from sorted(((r["slot"], np.frombuffer(r["ids"], "<u2")) for r in rows), key=lambda r: r[0])
        at = at // own * own + own

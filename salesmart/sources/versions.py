"""Verified publishing: a table's versions lie side by side, and one small file says which of them is current.

A new version is written beside the old one, read back and compared, by count and in every column; only then the
file is replaced, in one rename. A reader sees the old version or the new one, never a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import reconcile_tables
from ..operators.serving import serving_upsert
from .sinks import filesystem, stored

POINTER = "_CURRENT"


class Mismatch(RuntimeError):
    """What was read back isn't what was to be written; ``differences`` has a row each."""

    def __init__(self, root: str, differences: DataFrame) -> None:
        super().__init__(f"{root}: the staged version differs from its source, the current version stays")
        self.differences = differences


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = filesystem(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[8:]) for n in names if n.startswith("version="))


def current_version(spark: SparkSession, root: str) -> int | None:
    """Number of the current version; None before the first."""
    fs, p = filesystem(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return int(stream.readLine())
    finally:
        stream.close()


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise ValueError(f"{root} has no current version")
    return spark.read.parquet(f"{root}/version={version}")


def _switch(spark: SparkSession, root: str, version: int) -> None:
    """Make ``version`` current: the pointer is written aside and renamed over the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, aside = filesystem(spark, f"{root}/{POINTER}.{version}")
    out = fs.create(aside, True)
    out.writeBytes(f"{version}\n")
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, target, options)


def publish(df: DataFrame, root: str, key: str, keep: int = 2, write: Callable[[DataFrame, str], None] | None = None) -> int:
    """Publish ``df`` as the new current version and return its number.

    Rows have single keys. The staged version must have the same keys, each once, and equal values in every
    column; otherwise Mismatch is raised, the staged version goes, and the current one and its files stay. Of
    older versions ``keep`` - 1 remain, for readers that have one open. ``write`` writes the staged version
    (Parquet unless given). ``df`` may read the current version.
    """
    spark = df.sparkSession
    rows = stored(df)  # computed once, so that what is compared is what was meant
    old = _versions(spark, root)
    version = max([*old, 0]) + 1
    path = f"{root}/version={version}"
    (write or (lambda x, to: x.write.parquet(to)))(rows, path)
    back = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != key]
    fs, staged = filesystem(spark, path)
    if set(back.columns) != set(rows.columns):
        fs.delete(staged, True)
        raise ValueError(f"{root}: the staged version has columns {back.columns}")
    differences = stored(reconcile_tables(rows, back, key, columns))
    if not differences.isEmpty():
        fs.delete(staged, True)
        raise Mismatch(root, differences)
    _switch(spark, root, version)
    for v in old[: max(0, len(old) - keep + 1)]:
        fs.delete(filesystem(spark, f"{root}/version={v}")[1], True)
    return version


def publish_upsert(incoming: DataFrame, root: str, source_system: str, write: Callable[[DataFrame, str], None] | None = None) -> int:
    """The current serving table with ``incoming`` in it, guarded by source, as the new verified version."""
    spark = incoming.sparkSession
    return publish(serving_upsert(read_current(spark, root), incoming, source_system), root, "dt", write=write)

"""What the operators share: table access, shared scratch space, cut lineage, scrambling of hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []
_own: str | None = None
_TABLES: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, a temporary one, if there is one machine only."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own = _own or "file://" + tempfile.mkdtemp(prefix="lakequill-")
    return found if "://" in found else f"file://{found}"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lakequill-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = path or f"{scratch(spark)}/t"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = path
    weakref.finalize(out, _TABLES.pop, id(out), None)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote and that nothing reads any more."""
    for t in tables:
        if (path := _TABLES.pop(id(t), None)) is not None:
            remove(t.sparkSession, path)


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names made from these that no column of df has, whatever the case."""
    taken, end = {c.lower() for c in df.columns}, "_"
    while any(f"{n}{end}".lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def named(column: str) -> Column:
    """The column of exactly this name, with dots or other signs in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few of their values are Python objects at a time."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_utf8(df: DataFrame, column: str = "text") -> DataFrame:
    """The text as UTF-8 bytes; null counts as empty."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")).cast("binary"))

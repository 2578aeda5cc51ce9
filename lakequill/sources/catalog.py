"""A catalog of Parquet tables: every ``<dir>/<table>.parquet`` (a file or a folder) and every ``<dir>/<table>/*.parquet``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IoError, PlanError, UnsupportedError, from_spark

#: Footers of up to so many local files are read here, of more (or of files elsewhere) in tasks. All are compared in any case.
MOST_FOOTERS = 200
#: Schemes of Hadoop that Arrow's file systems know by another name, and those that they know as they are.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "file": "file"}


@dataclass
class Table:
    name: str
    files: list[str]
    frame: DataFrame = field(repr=False)
    sizes: list[int] = field(default_factory=list, repr=False)

    @cached_property
    def statistics(self) -> tuple[float, dict[str, float]]:
        """About how many rows there are, and how many different values at most in columns of whole numbers.

        From the first file's footer, if it is here; otherwise from the sizes of the files, or what Spark knows of the frame.
        """
        path = local_path(self.files[0]) if self.files else None
        if path is None or os.path.isdir(path):
            held = sum(self.sizes) or int(str(self.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            return max(1.0, held / (8.0 * max(1, len(self.columns)))), {}
        import pyarrow.parquet as pq

        meta = pq.read_metadata(path)
        scale = sum(self.sizes) / max(1, self.sizes[0]) if self.sizes else len(self.files)
        bounds: dict[str, tuple[int, int]] = {}
        for g in range(meta.num_row_groups):
            for i in range(meta.num_columns):
                column = meta.row_group(g).column(i)
                s = column.statistics
                if s is not None and s.has_min_max and isinstance(s.min, int) and not isinstance(s.min, bool):
                    low, high = bounds.get(column.path_in_schema.lower(), (s.min, s.max))
                    bounds[column.path_in_schema.lower()] = min(low, s.min), max(high, s.max)
        rows = max(1.0, meta.num_rows * scale)
        return rows, {c: min(rows, high - low + 1.0) for c, (low, high) in bounds.items()}

    @cached_property
    def columns(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.frame.schema}


def _listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int]] | None:
    """(path, is a folder, bytes) of what lies in a folder of any file system that Spark reads; None if it is no folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return None
    return sorted((s.getPath().toString(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p))


def local_path(path: str) -> str | None:
    """The path without its scheme if it is on this machine."""
    bare = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return bare if "://" not in bare and os.path.exists(bare) else None


def footer_schema(path: str | None) -> T.StructType | None:
    """The schema in a local file's footer, which spares Spark a job; None where Spark should read it by itself."""
    if path is None or os.path.isdir(path):
        return None
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = pq.read_schema(path)
    if b"org.apache.spark.sql.parquet.row.metadata" in (schema.metadata or {}):
        return None
    try:
        return from_arrow_schema(schema.remove_metadata(), prefer_timestamp_ntz=True)
    except PySparkException:
        return None


def _footer(path: str) -> str:
    """The columns and types of a file, as text."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    here = local_path(path)
    if here is not None:
        schema = pq.read_schema(here)
    else:
        scheme, mark, rest = path.partition("://")
        system, inner = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")
        with system.open_input_file(inner) as f:
            schema = pq.read_schema(f)
    return repr([(c.name, str(c.type)) for c in schema])


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files = b.column("file").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array([_footer(f) for f in files], pa.string())], names=["file", "footer"])


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None, decimals_as_double: bool = True):
        self.spark, self.root, self.decimals_as_double = spark, root, decimals_as_double
        self.tables: dict[str, Table] = {}
        self._waiting: dict[str, tuple] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str, decimals_as_double: bool = True, names: list[str] | None = None) -> Catalog:
        """Finds the tables of a folder and opens them; with ``names`` only these, the others when they are asked for."""
        self = cls(spark, root, decimals_as_double)
        found = _listing(spark, root)
        if found is None:
            raise IoError(f"no folder {root}")
        for path, folder, size in found:
            base = os.path.basename(path)
            name = base.removesuffix(".parquet").lower()
            if base.endswith(".parquet") and not folder:
                self._waiting[name] = ([path], [size], None, None)
            elif folder and not base.startswith((".", "_")):
                files = [(p, n) for p, inner, n in _listing(spark, path) or [] if p.endswith(".parquet") and not inner]
                if files:
                    paths, sizes = [p for p, _ in files], [n for _, n in files]
                    self._waiting[name] = (paths, sizes, None if base.endswith(".parquet") else paths, path)
        for name in list(self._waiting):
            if names is None or name in names:
                self._add(name)
        return self

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Catalog:
        self = cls(spark)
        for name, frame in tables.items():
            self.replace(name, frame)
        return self

    def _add(self, name: str) -> None:
        files, sizes, read, folder = self._waiting.pop(name)
        try:
            self._same_schema(name, files)
            schema = footer_schema(local_path(files[0]))
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            frame = reader.parquet(*(read or [folder or files[0]]))
        except Exception as e:  # noqa: BLE001
            raise from_spark(e) from e
        self.tables[name] = Table(name, files, self._doubles(frame), sizes)

    def _same_schema(self, name: str, files: list[str]) -> None:
        """Compares the footers of all files: here if they are few and local, else in tasks, or by Hadoop's readers where Arrow knows no file system."""
        if len(files) < 2:
            return
        schemes = {f.partition(":")[0] if ":" in f else "file" for f in files}
        if all(map(local_path, files)) and len(files) <= MOST_FOOTERS:
            found = {}
            for f in files:
                found.setdefault(_footer(f), f)
        elif schemes <= SCHEMES.keys():
            n = min(len(files), max(1, self.spark.sparkContext.defaultParallelism) * 4)
            paths = self.spark.createDataFrame([(f,) for f in files], "file string").repartition(n)
            footers = paths.mapInArrow(_footers, "file string, footer string").groupBy("footer").agg(F.min("file").alias("file"))
            found = {r["footer"]: r["file"] for r in footers.limit(2).collect()}
        else:
            found = self._footers_by_hadoop(files)
        if len(found) > 1:
            a, b = sorted(found.values())[:2]
            raise PlanError(f"files of table '{name}' differ in their schemas: {a} and {b}")

    def _footers_by_hadoop(self, files: list[str]) -> dict[str, str]:
        jvm, conf, found = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), {}
        for f in files:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
            try:
                found.setdefault(reader.getFileMetaData().getSchema().getFields().toString(), f)
            finally:
                reader.close()
        return found

    def _doubles(self, frame: DataFrame) -> DataFrame:
        """Stored decimals and floats are read as doubles."""
        wide = [f.name for f in frame.schema if isinstance(f.dataType, T.FloatType) or self.decimals_as_double and isinstance(f.dataType, T.DecimalType)]
        small = [f.name for f in frame.schema if isinstance(f.dataType, (T.ByteType, T.ShortType))]
        casts = {c: F.col(f"`{c}`").cast("double") for c in wide} | {c: F.col(f"`{c}`").cast("int") for c in small}
        return frame.withColumns(casts) if casts else frame

    def adopted(self, spark: SparkSession) -> Catalog:
        """The same tables in another Spark session, whose settings then hold for what is built on them."""
        out = Catalog(spark, self.root, self.decimals_as_double)
        out._waiting = dict(self._waiting)
        for t in self.tables.values():
            if t.frame.sparkSession is spark:
                out.tables[t.name] = t
                continue
            view = f"lakequill_{uuid.uuid4().hex}"
            t.frame.createGlobalTempView(view)
            out.tables[t.name] = Table(t.name, t.files, spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}"), t.sizes)
            spark.catalog.dropGlobalTempView(view)
        return out

    def replace(self, name: str, frame: DataFrame, files: list[str] | None = None) -> None:
        self.tables[name.lower()] = Table(name.lower(), files or [], self._doubles(frame))

    def table_names(self) -> list[str]:
        return sorted({*self.tables, *self._waiting})

    def table(self, name: str) -> Table:
        if name.lower() in self._waiting:
            self._add(name.lower())
        if name.lower() not in self.tables:
            raise PlanError(f"table '{name}' not found; known tables: {', '.join(self.table_names())}")
        return self.tables[name.lower()]

    def restrict_to_files(self, name: str, kept: list[int]) -> Catalog:
        """A catalog in which a table holds only the files of these numbers."""
        table = self.table(name)
        if not table.files:
            raise UnsupportedError(f"table '{name}' does not come from files")
        out = Catalog(self.spark, self.root, self.decimals_as_double)
        out.tables, out._waiting = dict(self.tables), dict(self._waiting)
        files = [table.files[i] for i in kept]
        frame = self.spark.read.parquet(*files) if files else table.frame.limit(0)
        out.tables[table.name] = Table(table.name, files, self._doubles(frame), [table.sizes[i] for i in kept] if table.sizes else [])
        return out

    def register(self) -> None:
        """Makes every table a temporary view, for plain Spark SQL beside the dialect."""
        for name in self.table_names():
            self.table(name).frame.createOrReplaceTempView(name)

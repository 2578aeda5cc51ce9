"""Engine settings and their meaning for Spark."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark import SparkConf
from pyspark.sql import SparkSession

from .errors import PlanError

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "KIB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "MIB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "GIB": 1 << 30}


def parse_bytes(size: str) -> int:
    """``512MB``, ``2GB``, ``100KB``, ``1.5g`` or plain bytes; all units are powers of 1024."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*([A-Za-z]*)\s*", size)
    if m is None or m[2].upper() not in _UNITS:
        raise PlanError(f"invalid size '{size}'")
    return int(float(m[1]) * _UNITS[m[2].upper()])


def _submitted() -> dict[str, str]:
    """The settings that spark-submit gave, if it started this program."""
    return dict(SparkConf().getAll()) if "PYSPARK_GATEWAY_PORT" in os.environ else {}


@dataclass
class ExecConfig:
    """``threads``, ``memory_limit`` and ``spill_dir`` take effect when the Spark context starts; ``batch_size`` is that of the Parquet reader."""

    batch_size: int = 2048
    threads: int = 1
    memory_limit: int | None = None
    spill_dir: str | None = None
    master: str | None = None

    def session_confs(self) -> dict[str, str]:
        """What holds within a session: no ANSI errors, so that integers wrap and a division by zero gives NULL."""
        return {
            "spark.sql.ansi.enabled": "false",
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.caseSensitive": "false",
            "spark.sql.parquet.columnarReaderBatchSize": str(max(1, self.batch_size)),
            "spark.sql.adaptive.enabled": "true",
        }

    def start(self) -> SparkSession:
        """A Spark session for stand-alone use; where one runs already (on a cluster), that one."""
        builder = SparkSession.builder.appName("lakequill").config("spark.ui.enabled", "false")
        master = self.master or os.environ.get("SPARK_MASTER")
        if master:
            builder = builder.master(master)
        elif SparkSession.getActiveSession() is None and "spark.master" not in _submitted():
            builder = builder.master(f"local[{max(1, self.threads)}]").config("spark.sql.shuffle.partitions", str(max(1, self.threads)))
        if self.memory_limit:
            builder = builder.config("spark.driver.memory", f"{max(512, self.memory_limit >> 20)}m")
        if self.spill_dir:
            builder = builder.config("spark.local.dir", self.spill_dir)
        return builder.getOrCreate()

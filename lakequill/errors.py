"""Errors by the layer that fails, with fixed message prefixes, and the mapping of Spark's exceptions to them."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException, PySparkException


class EngineError(Exception):
    kind, prefix = "Internal", "internal error: "

    def __init__(self, message: str):
        super().__init__(f"{self.prefix}{message}")
        self.message = message


class ParseError(EngineError):
    kind, prefix = "Parse", "SQL parse error: "


class PlanError(EngineError):
    kind, prefix = "Plan", "planning error: "


class ExecutionError(EngineError):
    kind, prefix = "Execution", "execution error: "


class UnsupportedError(EngineError):
    kind, prefix = "Unsupported", "not supported: "


class IoError(EngineError):
    kind, prefix = "Io", "I/O error: "


class ParquetError(EngineError):
    kind, prefix = "Parquet", "parquet error: "


class Cancelled(EngineError):
    kind, prefix = "Cancelled", "query cancelled"


class InternalError(EngineError):
    pass


class ResourcesExhausted(EngineError):
    """A task got less memory than it cannot do without; Spark spills before it comes to that."""

    kind, prefix = "ResourcesExhausted", "memory limit exceeded: "

    def __init__(self, operator: str, requested: int, used: int, limit: int):
        super().__init__(f"operator '{operator}' requested {requested} bytes but {used} of {limit} bytes are already reserved")
        self.operator, self.requested, self.used, self.limit = operator, requested, used, limit


def from_spark(error: BaseException) -> EngineError:
    """The engine's error for what Spark raised."""
    if isinstance(error, EngineError):
        return error
    text = str(error).split("\n\nJVM stacktrace")[0].strip()
    if m := re.search(r"Unable to acquire (\d+) bytes of memory, got (\d+)", text):
        return ResourcesExhausted("task", int(m[1]), int(m[1]) - int(m[2]), int(m[2]))
    if "OutOfMemoryError" in text:
        return ResourcesExhausted("heap", 0, 0, 0)
    if isinstance(error, ParseException):
        return ParseError(text)
    if isinstance(error, AnalysisException):
        return IoError(text) if "PATH_NOT_FOUND" in text else PlanError(text)
    if "cancelled" in text and "Job" in text:
        return Cancelled("")
    if "parquet" in text.lower() and ("footer" in text.lower() or "CANNOT_READ_FILE" in text):
        return ParquetError(text)
    return ExecutionError(text) if isinstance(error, PySparkException) or "SparkException" in text else InternalError(text)

"""Command line: ``python -m lakequill query|bench|repl``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from .config import ExecConfig, parse_bytes
from .display import format_csv, format_table
from .errors import EngineError, UnsupportedError
from .session import Rows, Session, split_explain


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakequill")
    sub = p.add_subparsers(dest="command", required=True)

    def engine(c: argparse.ArgumentParser) -> None:
        c.add_argument("--data", default="data/sf1", help="folder with <table>.parquet or <table>/*.parquet")
        c.add_argument("--threads", type=int, default=os.cpu_count() or 1)
        c.add_argument("--memory-limit", help="e.g. 512MB, 2GB; the heap of a local engine")
        c.add_argument("--batch-size", type=int, default=2048)
        c.add_argument("--spill-dir")
        c.add_argument("--master", help="a Spark cluster's master, e.g. spark://host:7077 or yarn; default: this machine with --threads")

    def statement(c: argparse.ArgumentParser) -> None:
        c.add_argument("sql", nargs="?")
        c.add_argument("--file")

    query = sub.add_parser("query", help="run one statement, also EXPLAIN and EXPLAIN ANALYZE")
    statement(query)
    query.add_argument("--format", choices=("table", "csv"), default="table")
    engine(query)
    bench = sub.add_parser("bench", help="time a query: one warm-up and N runs")
    statement(bench)
    bench.add_argument("--runs", type=int, default=5)
    bench.add_argument("--json", action="store_true")
    engine(bench)
    engine(sub.add_parser("repl", help="statements that end with ;"))
    for name in ("worker", "coordinator"):
        sub.add_parser(name, help="replaced by running on a Spark cluster")
    return p


def _sql(args: argparse.Namespace) -> str:
    if (args.sql is None) == (args.file is None):
        raise SystemExit("pass either SQL text or --file")
    text = args.sql if args.file is None else Path(args.file).read_text()
    return text.strip().rstrip(";")


def session(args: argparse.Namespace) -> Session:
    config = ExecConfig(max(1, args.batch_size), max(1, args.threads), parse_bytes(args.memory_limit) if args.memory_limit else None, args.spill_dir, args.master)
    spark = config.start()
    spark.sparkContext.setLogLevel("ERROR")
    return Session(spark, args.data, config)


def _show(out, form: str) -> None:
    if not isinstance(out, Rows):
        print(out.text)
    elif form == "csv":
        print(format_csv(out.rows), end="")
    else:
        print(format_table(out.columns, out.rows), end="")
        print(f"({out.elapsed * 1e3:.2f} ms)", file=sys.stderr)


def bench(s: Session, sql: str, runs: int, as_json: bool) -> None:
    """Each run builds the DataFrame anew, so planning is included."""
    s.run(sql)
    times, rows = [], 0
    for _ in range(max(1, runs)):
        began = time.perf_counter()
        rows = s.run(sql).num_rows
        times.append((time.perf_counter() - began) * 1e3)
    least, median, most = min(times), sorted(times)[len(times) // 2], max(times)
    if as_json:
        print(json.dumps({"engine": "lakequill", "threads": s.config.threads, "batch_size": s.config.batch_size, "min_ms": round(least, 3), "median_ms": round(median, 3), "max_ms": round(most, 3), "rows": rows, "runs": [round(t, 3) for t in times]}))
    else:
        print(f"threads={s.config.threads} runs={len(times)} min={least:.1f}ms median={median:.1f}ms max={most:.1f}ms rows={rows}")


def repl(s: Session, lines=sys.stdin) -> None:
    print(f"lakequill. Tables: {', '.join(s.catalog.table_names())}. End statements with ';'. Ctrl-D to exit.")
    held = ""
    print("> ", end="", flush=True)
    for line in lines:
        held += line
        while ";" in held:
            sql, held = held.split(";", 1)
            if sql.strip():
                try:
                    _show(s.run(sql), "table")
                except EngineError as e:
                    print(f"error: {e}")
        held = held if held.strip() else ""
        print("... " if held else "> ", end="", flush=True)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command in ("worker", "coordinator"):
            raise UnsupportedError(f"{args.command}: run the query on a Spark cluster instead, with --master or spark-submit")
        if args.command == "repl":
            repl(session(args))
        elif args.command == "bench":
            bench(session(args), _sql(args), args.runs, args.json)
        else:
            sql = _sql(args)
            if args.format == "csv" and split_explain(sql)[0] == "query":
                for row in session(args).stream(sql):
                    print(format_csv([row]), end="")
            else:
                _show(session(args).run(sql), args.format)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""EXPLAIN and EXPLAIN ANALYZE: Spark's plans, with the scans' row groups and, after a run, the metrics of each node."""

from __future__ import annotations

import time

from ..sources.stats import row_groups
from .binder import Query


def format_bytes(n: float) -> str:
    """Whole bytes, or one decimal of the largest binary unit up to TiB that is at least one."""
    n = int(n)
    ten_bits = min(4, max(0, n.bit_length() - 1) // 10)
    return f"{n / (1 << 10 * ten_bits):.1f}{'KMGT'[ten_bits - 1]}iB" if ten_bits else f"{n}B"


def scan_lines(query: Query) -> list[str]:
    """A line per scan: columns, row groups that its comparisons leave of all, the comparisons."""
    out = []
    for s in query.scans:
        groups = row_groups(s.table.files, s.comparisons) if s.table.files else None
        counted = "unknown" if groups is None else f"{groups[0]}/{groups[1]}"
        prune = ", ".join(f"{c} {op} {v}" for c, op, v in s.comparisons)
        out.append(f"Scan {s.table.name}: columns=[{', '.join(sorted(s.columns))}] row_groups={counted}" + (f" prune=[{prune}]" if prune else ""))
    return out


def explained(query: Query) -> str:
    run = query.frame._jdf.queryExecution()
    lines = "\n".join(scan_lines(query))
    return f"== Logical plan ==\n{run.analyzed().toString()}\n== Optimized logical plan ==\n{run.optimizedPlan().toString()}\n== Physical plan ==\n{run.executedPlan().toString()}\n{lines}"


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _values(node) -> dict[str, tuple[str, int]]:
    """name: (kind, value) of a node's metrics."""
    out, it = {}, node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        out[pair._1()] = (pair._2().metricType(), pair._2().value())
    return out


def _shown(name: str, kind: str, value: int) -> str:
    if kind == "size":
        return f"{name}={format_bytes(value)}"
    if kind in ("timing", "nsTiming"):
        return f"{name}={value / (1e6 if kind == 'nsTiming' else 1):.2f}ms"
    return f"{name}={value}"


class _Report:
    """The nodes of an executed plan with their metrics, the pipelines (code generated as one) with their time."""

    def __init__(self, plan):
        self.lines: list[str] = []
        self.pipelines: list[tuple[str, float]] = []
        self.peak = 0
        self._add(plan, 0)

    def _add(self, node, depth: int) -> int | None:
        """Adds the node and those below; the rows that come out of it, as far as known."""
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return self._add(node.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return self._add(node.plan(), depth)
        if kind == "InputAdapter":
            return self._add(node.child(), depth)
        if kind == "WholeStageCodegenExec":
            names, at = [], node.child()
            while at.getClass().getSimpleName() != "InputAdapter":
                names.append(at.nodeName())
                below = _list(at.children())
                if len(below) != 1:
                    break
                at = below[0]
            time_ = _values(node).get("pipelineTime", ("timing", 0))[1]
            self.pipelines.append((" <- ".join(names), float(time_)))
            return self._add(node.child(), depth)
        place = len(self.lines)
        self.lines.append("")
        rows = [self._add(c, depth + 1) for c in _list(node.children())]
        values = _values(node)
        self.peak = max(self.peak, values.get("peakMemory", ("size", 0))[1])
        came = None if not rows or None in rows else sum(rows)
        out = values["numOutputRows"][1] if "numOutputRows" in values else values["shuffleRecordsWritten"][1] if "shuffleRecordsWritten" in values else came if kind in KEEPING else None
        told = [f"rows_in={came}"] * (came is not None) + [f"rows_out={out}"] * (out is not None)
        told += sorted(_shown(n, *v) for n, v in values.items() if v[1] > 0 and n != "numOutputRows")
        self.lines[place] = "  " * depth + node.simpleString(120) + (f"  [{' '.join(told)}]" if told else "")
        return out


#: Nodes that let every row through, and do not count them.
KEEPING = frozenset(("ProjectExec", "SortExec", "AQEShuffleReadExec", "ColumnarToRowExec"))


def analyzed(query: Query) -> str:
    """Runs the query where its data is, without taking the result to the driver, and shows what each node did."""
    run = query.frame._jdf.queryExecution()
    began = time.perf_counter()
    rows = run.toRdd().count()
    took = (time.perf_counter() - began) * 1e3
    report = _Report(run.executedPlan())
    pipelines = [f"#{i} {t:>10.2f} ms  {names}" for i, (names, t) in enumerate(reversed(report.pipelines))]
    return "\n".join([
        "== Physical plan with metrics ==", *report.lines, *scan_lines(query), "== Pipelines ==", *pipelines, "",
        f"Total: {took:.2f} ms, {rows} result row(s), peak memory of an operator {format_bytes(report.peak)}",
        "(times are summed over all tasks; rows_in is what the nodes below gave)", "",
    ])

"""Results as text: an ASCII table or CSV without a header. NULL prints as NULL, doubles without exponent or idle zeros."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal


def cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if not math.isfinite(value):
            return "NaN" if math.isnan(value) else "inf" if value > 0 else "-inf"
        shown = format(Decimal(repr(value)), "f")
        return shown.rstrip("0").rstrip(".") if "." in shown else shown
    return str(value)


def format_table(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    cells = [[cell(v) for v in row] for row in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda values: "|" + "|".join(f" {v:<{w}} " for v, w in zip(values, widths, strict=True)) + "|"
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule, f"{len(rows)} row(s)", ""])


def format_csv(rows: Sequence[Sequence]) -> str:
    def quoted(text: str) -> str:
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text

    return "".join(",".join(quoted(cell(v)) for v in row) + "\n" for row in rows)

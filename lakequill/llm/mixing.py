"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to. Capacity flows from each pattern,
once for each copy of its documents, the c-th copy at cost c - 1 (so the total cost is convex in the repetition), through
its sources to their quotas. The flow through a pattern says how many whole copies all of its documents get and how many
words a seeded part of them adds.

That part is chosen by a hash of the document, its id and content first, so that equal rows stand together, then the row:
histograms of the hash, refined until few rows are left, give a threshold below which every document is taken; the rows
just above it fill the rest. While rows beyond these would still fit, the
threshold is chosen again over them, without those larger than what is left. No group is sorted or gathered as a whole, and
only one row for each pattern and source reaches the driver.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named, private, table

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 17
WORD = r"[^\x20\x09-\x0D]+"
#: Patterns, and bytes of their sources' names, that the driver holds; more is an error, not a cut. Executors get a number for each pattern.
MOST_PATTERNS, MOST_BYTES = 1_000_000, 128 << 20
BUCKETS, ZONE_LEAST, ZONE_MOST = 4096, 64, 4096
_RANGE = 1 << 60


def targets(sizes: dict[str, int], weights: dict[str, float], share: float = SHARE, most: float = MOST) -> dict[str, float]:
    """Words asked of each source: a share of all by weight, at most ``most`` times its size, the excess shared again."""
    out, open_, left = {}, dict(weights), share * sum(sizes.values())
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w > most * sizes[s]]
        if not full:
            return out | {s: unit * w for s, w in open_.items()}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def min_cost_flow(patterns: dict[tuple[str, ...], int], quotas: dict[str, float], most: int = MOST) -> dict[tuple[str, ...], float]:
    """Words that flow through each pattern at the least cost of the greatest flow.

    Successive shortest paths from the patterns' copies to the sources with quota left; reverse edges let an earlier choice
    be taken back. Sources from which no path leads on are left out of later searches, as none ever will.
    """
    flow = {p: 0.0 for p in patterns}
    uses: dict[str, list[tuple[str, ...]]] = {}
    for p in patterns:
        for s in p:
            uses.setdefault(s, []).append(p)
    sent: dict[tuple[tuple[str, ...], str], float] = {}
    left = dict(quotas)
    shared = [p for p, size in patterns.items() if p and size]
    dead: set[str] = set()
    tiny = 1e-9 * (1 + sum(quotas.values()))
    for copy in range(most):  # the cost of a path is that of its first edge less what it takes back, so copies go in turn
        cap = {p: float(patterns[p]) for p in shared}
        queue = deque(shared)
        while queue:
            start = queue[0]
            if cap[start] <= tiny:
                queue.popleft()
                continue
            came: dict = {start: None}
            seek, end = deque([start]), None
            while seek and end is None:
                node = seek.popleft()
                if isinstance(node, tuple):
                    for s in node:
                        if s not in came and s not in dead:
                            came[s] = node
                            if left[s] > tiny:
                                end = s
                                break
                            seek.append(s)
                else:
                    for p in uses[node]:
                        if p not in came and sent.get((p, node), 0.0) > tiny:
                            came[p] = node
                            seek.append(p)
            if end is None:
                dead.update(x for x in came if isinstance(x, str))
                queue.popleft()
                continue
            amount, node = min(cap[start], left[end]), end
            while came[node] is not None:
                if not isinstance(node, str):
                    amount = min(amount, sent[node, came[node]])
                node = came[node]
            left[end] -= amount
            cap[start] -= amount
            flow[start] += amount
            node = end
            while came[node] is not None:
                before = came[node]
                if isinstance(node, str):
                    sent[before, node] = sent.get((before, node), 0.0) + amount
                else:
                    sent[node, before] -= amount
                node = before
    return flow


def _threshold(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, lo, hi, rem): below lo all rows get one more copy; and the rows from there to hi that fill what is left, rem."""
    state = plan.filter("rem > 0").select("pattern", F.lit(0).cast("long").alias("lo"), F.lit(_RANGE).cast("long").alias("hi"), "rem")
    while True:
        width = F.ceil((F.col("hi") - F.col("lo")) / F.lit(float(BUCKETS))).cast("long")
        inside = rows.join(F.broadcast(state), "pattern").filter("u >= lo and u < hi")
        hist = inside.withColumn("bucket", F.floor((F.col("u") - F.col("lo")) / width)).groupBy("pattern", "bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("rem").alias("rem"))
        w = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumns({"ends": F.sum("s").over(w), "upto": F.sum("c").over(w)})
        at = hist.filter("ends > rem").groupBy("pattern").agg(F.min(F.struct("bucket", (F.col("ends") - F.col("s")).alias("below"), (F.col("upto") - F.col("c")).alias("before"))).alias("x")).select("pattern", F.col("x.bucket").alias("cut"), "x.below", "x.before")
        last = hist.join(at, "pattern").filter("bucket >= cut").groupBy("pattern", "cut", "below", "lo", "hi", "rem").agg(
            F.coalesce(F.min(F.when(F.col("upto") - F.col("before") >= ZONE_LEAST, F.struct("bucket", (F.col("upto") - F.col("before")).alias("n")))), F.max(F.struct("bucket", (F.col("upto") - F.col("before")).alias("n")))).alias("z")
        )
        new = materialise(last.select("pattern", (F.col("lo") + F.col("cut") * width).alias("lo"), F.least("hi", F.col("lo") + (F.col("z.bucket") + 1) * width).alias("hi"), (F.col("rem") - F.col("below")).alias("rem"), F.col("z.n").alias("n"), width.alias("width")))
        state = new.select("pattern", "lo", "hi", "rem")
        if new.filter(f"n > {ZONE_MOST} and width > 1").isEmpty():
            return state, rows.join(F.broadcast(state), "pattern").filter("u >= lo and u < hi").select("pattern", "row", "u", "size", "rem")


def fill(group: pa.Table) -> pa.Table:
    """Of the rows above the threshold, those that fit what is left, in the order of the hash."""
    group = group.sort_by([("u", "ascending"), ("row", "ascending")])
    left, taken = group["rem"][0].as_py(), []
    for size in group["size"].to_pylist():
        taken.append(0 < size <= left)
        left -= size if taken[-1] else 0
    return group.filter(pa.array(taken, pa.bool_())).select(["pattern", "row", "size"])


def _filled(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, bands): rows whose hash and size lie in one of these get one more copy; and (row): so do these rows.

    Each round takes what lies below a threshold among the rows beyond the last round's that are not larger than what is
    left, and fills up from the rows just above it; it ends when no row beyond fits. At last one larger row is taken if it
    comes nearer.
    """
    state = materialise(plan.filter("rem > 0").select("pattern", "rem", F.lit(0).cast("long").alias("start")))
    bands, fitted, left, first = None, None, None, True
    while True:
        usable = rows.join(F.broadcast(state), "pattern").filter("u >= start" if first else "u >= start and size > 0 and size <= rem").select("pattern", "row", "u", "size")
        cut, zone = _threshold(usable, state)
        new = materialise(zone.groupBy("pattern").applyInArrow(fill, "pattern long, row long, size long"))
        ends = cut.select("pattern", F.col("lo").alias("end"))
        band = state.join(ends, "pattern", "left").select("pattern", F.struct("start", F.coalesce("end", F.lit(_RANGE)).alias("end"), (F.lit(float("inf")) if first else F.col("rem")).alias("most")).alias("band"))
        below = usable.join(F.broadcast(state.join(cut, "pattern", "left_anti")), "pattern").groupBy("pattern").agg(F.sum("size").alias("used"))
        over = state.join(cut.select("pattern"), "pattern", "left_anti").join(below, "pattern", "left").select("pattern", (F.col("rem") - F.coalesce("used", F.lit(0))).alias("rem"), F.lit(_RANGE).alias("start"))
        used = new.groupBy("pattern").agg(F.sum("size").alias("used"))
        after = materialise(cut.join(used, "pattern", "left").select("pattern", (F.col("rem") - F.coalesce("used", F.lit(0))).alias("rem"), F.col("hi").alias("start")).unionByName(over))
        fits = rows.join(F.broadcast(after), "pattern").filter("u >= start and size > 0 and size <= rem").select("pattern").distinct()
        next_ = materialise(after.join(fits, "pattern", "left_semi"))
        ended = after.join(next_, "pattern", "left_anti").select("pattern", "rem")
        bands, fitted, left = (x if y is None else y.unionByName(x) for x, y in ((band, bands), (new.select("row"), fitted), (ended, left)))
        if next_.isEmpty():
            break
        state, first = next_, False
    bands = materialise(bands.groupBy("pattern").agg(F.collect_list("band").alias("bands")))
    near = rows.join(F.broadcast(left.filter("rem > 0")), "pattern").filter("size > rem and size < 2 * rem").join(F.broadcast(bands), "pattern").filter(~_within())
    near = near.join(fitted, "row", "left_anti").groupBy("pattern").agg(F.min(F.struct("size", "u", "row")).alias("x")).select("x.row")
    return bands, fitted.unionByName(near)


def _within() -> Column:
    return F.exists("bands", lambda b: (F.col("u") >= b["start"]) & (F.col("u") < b["end"]) & (F.col("size") <= b["most"]))


def _key(sources: Column) -> Column:
    """The membership pattern: sources by code point, null last, each once; marked, as a pattern holds no null."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("0"), s), F.lit("1")))))


def _decided(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(pattern, source_size, target, whole, rem, bands): what holds for all rows of a pattern; and (row, extra): rows with one copy more.

    ``rows`` have pattern (a number), names (its sources), row, u and size.
    """
    groups = materialise(rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("names").alias("names")))
    n, held = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("names", ""))), F.lit(0))).first()
    if n > MOST_PATTERNS or held > MOST_BYTES:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns, or more than {MOST_BYTES} bytes of names in them")
    found = sorted(groups.collect(), key=lambda r: r["names"])  # in any other order another flow may be as good
    patterns = {tuple(r["names"]): r["size"] for r in found}
    sizes: dict[str, int] = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    asked = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}, share, most) if sizes else {}
    flow = min_cost_flow(patterns, asked, most)
    plan = []
    for r in found:
        p, size = tuple(r["names"]), r["size"]
        whole = min(most, int(flow[p] / size + 1e-12)) if size else 0
        plan.append((r["pattern"], sizes.get(p[0], 0) if p else 0, asked.get(p[0], 0.0) if p else 0.0, whole if p else 0, flow[p] - whole * size if whole < most and p else 0.0))
    plan = materialise(rows.sparkSession.createDataFrame(plan, "pattern long, source_size long, target double, whole int, rem double"))
    bands, more = _filled(rows.select("pattern", "row", "u", "size"), plan)
    # written, the few rows have a known size: they go to the documents, not the documents to them
    return materialise(plan.join(bands, "pattern", "left")), materialise(more.select("row", F.lit(1).alias("extra")))


def _copies(most: int) -> Column:
    reached = F.when(F.col("rem") <= 0, 0).when(_within(), 1).otherwise(F.coalesce("extra", F.lit(0)))
    return F.least(F.col("whole") + reached, F.lit(most)).cast("int")


def mix(docs: DataFrame, sources: str = "sources", size: str = "size", content: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, sources, size, source_size, target, copies, taken for each row of docs (doc_id, an array of sources, a size).

    Sources are taken by code point, null last, and weigh as ``weights`` repeats. A null size counts as 0; a row in no
    source is never taken; rows that repeat an id, or have none, count one by one, told apart by ``content`` (a hash of what
    they hold, if there is a column of it); of equal rows any may be taken. source_size and target are those of the row's
    first source. The result is the same in every run with the same seed. An empty table gives an empty result; extra
    columns are ignored.
    """
    chosen = docs.select("doc_id", F.col(sources).alias("sources"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), (F.col(content) if content else F.lit(0)).alias("content"))
    rows = materialise(_numbered(chosen.withColumn("names", _key(F.col("sources"))), seed))
    plan, more = _decided(rows, weights, share, most)
    out = rows.join(F.broadcast(plan), "pattern").join(more, "row", "left").withColumn("copies", _copies(most))
    return out.select("doc_id", "sources", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _numbered(rows: DataFrame, seed: int) -> DataFrame:
    """Adds pattern, row and u: 40 bits from id and content, and 20 from the row, which part equal rows."""
    row = F.monotonically_increasing_id()
    whole = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "content", "size"), F.lit(1 << 40))
    return rows.withColumn("row", row).withColumns({"pattern": F.xxhash64("names"), "u": F.shiftleft(whole, 20) + F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 20))})


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(docs: DataFrame) -> DataFrame:
    """doc_id, sources (one each), size in words and a hash of the content of documents; null texts have no words."""
    return docs.select("doc_id", F.array("source").alias("sources"), _size(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(words(table(spark, sf_dir, "documents")), content="content").select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, memberships: tuple[str, ...] = ("source", "lang"), share: float = SHARE) -> DataFrame:
    """The rows of docs that the mix takes, with ``copies``, the number of times.

    A document belongs to a source for each column of ``memberships`` (with its value, null being one as well), so sources
    overlap; each of the columns shares ``share`` / their number of all words. Rows without a word are never taken; rows
    that repeat an id or a text are taken one by one; an empty table gives an empty result. The rows are written once with
    their numbers and read again; no text is shuffled. Other columns, of any name, stay as they are; where one is named
    ``copies`` the new one is ``copies_``.
    """
    sources = _key(F.array(*(F.coalesce(F.concat(F.lit(f"{c}="), named(c).cast("string")), F.lit(c)) for c in memberships)))
    added = docs.select(F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("given"), F.col("doc_id").alias("doc_id"), sources.alias("names"), _size(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))
    rows = materialise(_numbered(added, SEED))
    plan, more = _decided(rows.drop("given"), WEIGHTS, share / len(memberships), MOST)
    out = rows.join(F.broadcast(plan), "pattern").join(more, "row", "left").withColumn("copies", F.when(F.col("size") > 0, _copies(MOST)).otherwise(0)).filter("copies > 0")
    name = "copies" if "copies" not in {c.lower() for c in docs.columns} else private(docs, "copies")[0]
    return out.select(*(F.col(f"given.c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("copies").alias(name))

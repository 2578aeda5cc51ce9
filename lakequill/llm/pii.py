"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the base entities (e-mail and IP addresses, card and phone numbers) and strings of a few fixed shapes that only
keys have. A seed induces two lexical patterns: the word before it with what parts them, and the word after it likewise.
Candidates are other strings that look like identifiers; values and the patterns that they occur with form a graph. A
pattern's score is the weight of its values' places over *all* places of that context in all texts, so a common word
scores low however often a seed follows it; it needs SUPPORT different values of weight. A value's score, and its weight in
the next round, is that of its best pattern if that reaches SCORE, else 0. Rounds go on until they find no new value. Every
place of a discovered value is a span of kind ``id``. A string of a key's shape is a span only if its contexts say so too.

Spans come from the pieces around matches: ``split`` gives what lies between, ``regexp_extract_all`` the matches, and
running lengths give code-point offsets. The patterns look back or start at the last match's end, and their loops do not
backtrack, so they take linear time and constant stack on any text; they match what the plain patterns match.

Bounds: a candidate has a digit and LEAST code points or more; a context is a word of at most 32 letters and 1 to 8 other
characters (no letters, no digits) between it and the value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, named, private, release, table

# Fixed patterns: kind, cheap test that a text may hold it, pattern.
BASE = (
    ("email", r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
)
KINDS = tuple(k for k, _, _ in BASE)
OTHER = "id"
# Fixed shapes of keys: hexadecimal strings of 32 digits or more with letters, UUIDs, signed web tokens, access keys.
SHAPES = r"^(?:(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{32,}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]+|AKIA[0-9A-Z]{16})$"
CANDIDATE = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*+[0-9])[A-Za-z0-9@_+]++(?:[.-][A-Za-z0-9@_+]++)*+"
LEAST, SUPPORT, SCORE = 6, 3, 0.7
#: Contexts: the word and the characters between it and a value, at every place of a text, and at the end or beginning of one.
LEFT, RIGHT = r"(?<!\p{L})\p{L}{1,32}[^\p{L}\p{N}]{1,8}", r"[^\p{L}\p{N}]{1,8}\p{L}{1,32}(?!\p{L})"
EVERY = (LEFT + r"(?=[\p{L}\p{N}])", r"(?<=[\p{L}\p{N}])" + RIGHT)
_NEAR = 48
SPAN = "array<struct<start:int,kind:int,end:int>>"
_AT = "array<struct<start:int,kind:int,end:int,value:bigint,seed:int,patterns:array<bigint>>>"


def _found(text: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """Array of (start, end, what, before, after) of all matches that are wanted; offsets in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), F.slice(gaps, F.lit(2), F.size(hits)).alias("next"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,what:string,before:string,after:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        new = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("what"), F.right(x["gap"], F.lit(_NEAR)).alias("before"), F.left(x["next"], F.lit(_NEAR)).alias("after"))
        return F.struct(end.alias("at"), F.when(wanted(x["hit"]), F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, what: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(what, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = _digits(what)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(what)).between(10, 15)
    return F.lit(True)


def _of_kind(text: Column, i: int) -> Column:
    kind, test, pattern = BASE[i]
    made = F.transform(_found(text, pattern, lambda what: _valid(kind, what)), lambda x: _place(x, F.lit(i), F.lit(1)))
    return F.when(text.rlike(test), made).otherwise(F.expr(f"cast(array() as {_AT})"))


def _place(x: Column, kind: Column, seed: Column) -> Column:
    """A match with its value (case folded) and its patterns, both hashed."""
    glue = r"[^\p{L}\p{N}]*+"
    left = F.regexp_extract(F.lower(F.concat(x["before"], F.regexp_extract(x["what"], "^" + glue, 0))), LEFT + "$", 0)
    right = F.regexp_extract(F.lower(F.concat(F.regexp_extract(x["what"], r"[^\p{L}\p{N}]*$", 0), x["after"])), "^" + RIGHT, 0)
    patterns = F.transform(F.filter(F.array(F.struct(F.lit(0).alias("side"), left.alias("c")), F.struct(F.lit(1).alias("side"), right.alias("c"))), lambda p: p["c"] != ""), lambda p: F.xxhash64(p["side"], p["c"]))
    return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), F.xxhash64(F.lower(x["what"])).alias("value"), seed.alias("seed"), patterns.alias("patterns"))


def _entities(text: Column) -> Column:
    """The base entities of a text as places, by start and then kind."""
    return F.array_sort(F.concat(*(_of_kind(text, i) for i in range(len(BASE)))))


def _plain(places: Column) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """The base entities of a text as (start, kind number, end), by start and then kind. Null texts have none."""
    return _plain(_entities(text))


def counted(spans: Column, i: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    names = F.array(*(F.lit(k) for k in (*KINDS, OTHER)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _occurrences(docs: DataFrame) -> DataFrame:
    """A narrow row per document: base entities and candidates with their places, values and patterns. Texts stay behind."""
    text = F.col("text")
    # a key may happen to hold what passes for a card; but a base entity, or a part of one, is no candidate
    within = lambda b, c: (c["start"] <= b["start"]) & (b["end"] <= c["end"]) & (b["end"] - b["start"] < c["end"] - c["start"])
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", _entities(text))
    strings = F.filter(_found(text, CANDIDATE, lambda what: F.length(what) >= LEAST), lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]) & ~within(b, c)))
    candidates = F.when(text.rlike("[0-9]"), F.transform(strings, lambda c: _place(c, F.lit(len(KINDS)), c["what"].rlike(SHAPES).cast("int")))).otherwise(F.expr(f"cast(array() as {_AT})"))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", candidates.alias("open")).withColumn("row", F.monotonically_increasing_id())


def _places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): at how many places of all texts each of these contexts stands. Only counts are shuffled."""
    texts = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    left, right = (F.regexp_extract_all("text", F.lit(e), F.lit(0)) for e in EVERY)
    sides = (F.transform(left, lambda c: F.xxhash64(F.lit(0), c)), F.transform(right, lambda c: F.xxhash64(F.lit(1), c)))
    return texts.select(F.explode(F.concat(*sides)).alias("pattern")).join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def _values(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """(value, score) of the discovered values; None if no pattern has the support."""
    flat = found.select(F.explode(F.concat("base", "open")).alias("x")).select("x.value", "x.seed", (F.col("x.kind") == len(KINDS)).alias("open"), F.explode("x.patterns").alias("pattern"))
    # occurrences are counted before anything moves; what remains is a row per pattern and value
    graph = materialise(flat.groupBy("pattern", "value", "seed", "open").agg(F.count(F.lit(1)).alias("n")))
    supported = materialise(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).select("pattern"))
    if supported.isEmpty():
        return None
    edges = materialise(graph.join(materialise(_places(docs, supported)), "pattern"))
    values, known = None, 0
    while True:
        weight = F.col("seed").cast("double")
        scored = edges.withColumn("w", weight) if values is None else edges.join(values, "value", "left").withColumn("w", F.greatest(weight, F.coalesce("score", F.lit(0.0)))).drop("score")
        patterns = scored.groupBy("pattern").agg(F.least(F.lit(1.0), F.sum(F.col("n") * F.col("w")) / F.max("total")).alias("score"), F.sum((F.col("w") > 0).cast("int")).alias("support"))
        high = patterns.filter((F.col("support") >= SUPPORT) & (F.col("score") >= SCORE)).select("pattern", "score")
        old, values = values, materialise(edges.filter("open").join(high, "pattern").groupBy("value").agg(F.max("score").alias("score")))
        release(*([old] if old is not None else []))
        # weights only grow, so values are only added: no more of them means that nothing changes
        if (n := values.count()) == known:
            return values
        known = n


def _discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, more): the spans of discovered values, of rows that have any."""
    values = _values(docs, found)
    places = found.select("row", F.explode("open").alias("x")).select("row", "x.start", "x.kind", "x.end", "x.value")
    places = places.limit(0) if values is None else places.join(values, "value", "left_semi")
    return places.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, spans for every row of docs: the base entities, and with the discovered ones, by start and kind.

    Null texts count as empty; rows that repeat an id or a text get their spans one by one, and each counts as a place of its
    contexts; texts of any length are read whole; spans that tie in start stand by kind; an empty table gives an empty
    result; extra columns are ignored.
    """
    found = materialise(_occurrences(docs))
    every = F.array_sort(F.concat(_plain(F.col("base")), F.coalesce("more", F.expr(f"cast(array() as {SPAN})"))))
    return found.join(_discovered(docs, found), "row", "left").select("doc_id", "text_hash", _plain(F.col("base")).alias("base"), every.alias("spans"))


def _merged(spans: Column) -> Column:
    """Spans without those that begin inside an earlier one; that one's end grows instead."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.expr(f"cast(array() as {SPAN})"), step)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; n_chars, if there is one, follows the new text.

    Base entities are found where the text is; only the discovered spans, of few documents, are joined, by id and a hash of
    the text. Null texts stay null, texts without a span stay as they are, rows that repeat an id or a text are masked each,
    of spans that overlap the first one's kind stands for all; an empty table gives an empty result. Other columns, of any
    name, stay as they are.
    """
    id_, hash_, more, spans_, text_ = private(docs, "id", "hash", "more", "spans", "text")
    found = materialise(_occurrences(docs))
    extra = _discovered(docs, found).join(found.select("row", "doc_id", "text_hash"), "row").groupBy("doc_id", "text_hash").agg(F.first("more").alias(more))
    extra = materialise(extra.withColumnsRenamed({"doc_id": id_, "text_hash": hash_}))
    text = F.coalesce("text", F.lit(""))
    out = docs.join(extra, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left")
    out = out.withColumn(spans_, _merged(F.array_sort(F.concat(base_spans(text), F.coalesce(more, F.expr(f"cast(array() as {SPAN})"))))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, OTHER)))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans_, lambda x: x["end"]))
    pieces = F.zip_with(spans_, F.slice(ends, F.lit(1), F.size(spans_)), lambda x, before: F.concat(F.substring(F.col("text"), before + 1, x["start"] - before), F.element_at(names, x["kind"] + 1)))
    rest = F.substring(F.col("text"), F.element_at(ends, -1) + 1, F.length("text"))
    same = F.size(spans_) == 0
    # a column of its own: within one select, names in lambdas would mean the new text
    out = out.withColumn(text_, F.when(same, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    cols = {c: named(c) for c in docs.columns} | {"text": F.col(text_)}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(text_)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(v.alias(k) for k, v in cols.items()))


def query(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    counts = [counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with ``>`` are quoted; the number of these signs is the level. A run of lines of one level is a passage.
Passages, their paragraphs and lines are normalised (lower case, every other run of characters than letters and digits as one
space) and hashed. So are the lines, paragraphs and the whole of what messages say themselves. A unit links to the last
earlier message of its conversation that has the same hash: an as-of join, linear in the rows, where hot hashes are split by
ranges of turns. The message that most of the first-level quotation (by length) links to is the parent; without one, the
parent of what a deeper level links to is not guessed, and the deeper message itself is the parent.

Replies form trees. Depth and root of each message come from doubling its pointers. Messages are ordered by the root's
turn, then depth, then turn, so that each message follows what it replies to; their text is what they say without quotations
and the lines that introduce these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, table, tasks

QUOTE = r"^[ \t]*+>[> \t]*+"
# Fixed patterns of lines that introduce a quotation.
INTRODUCES = r"^(?:(?:on|le|am|el)\b.{1,200}\b(?:wrote|a écrit|schrieb|escribió) ?:|-{2,} ?original message ?-{2,})$"
#: So many turns form a block of the as-of join and of the numbering.
BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " "))


def _key() -> Column:
    """A digest of a message with its place: equal rows share it, and it decides between messages of one turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws(" ", shown("conv_id"), shown("turn"), F.coalesce(F.hex("role"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary")))


def _lines(messages: DataFrame) -> DataFrame:
    """Adds ``levels`` and ``lines``: of each line of the text the number of its quotation signs (0: own words) and what follows them."""
    out = messages.withColumn("raw", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n", -1))
    out = out.withColumn("signs", F.transform("raw", lambda x: F.regexp_extract(x, QUOTE, 0)))
    return out.withColumns({
        "levels": F.transform("signs", lambda x: F.length(F.regexp_replace(x, "[^>]", ""))),
        "lines": F.zip_with("raw", "signs", lambda x, sign: F.substring(x, F.length(sign) + 1, F.length(x))),
    }).drop("raw", "signs")


def _cut(lines: Column, starts: Column) -> Column:
    """The lines from each start to the next, each stretch joined by spaces."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines) + 1))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(lines, a, b - a), " "))


def _paragraphs(lines: Column) -> Column:
    blank = F.transform(lines, lambda x: F.trim(x) == "")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | (F.element_at(blank, i) != F.element_at(blank, F.greatest(i - 1, F.lit(1)))))
    return F.filter(_cut(lines, starts), lambda x: F.trim(x) != "")


def units(messages: DataFrame) -> DataFrame:
    """A row for each unit that can link: conv_id, turn, level, hash; of quoted ones also key, passage and size (letters and digits).

    A run of lines of one level is a passage. Its units are itself, its paragraphs if there are several, and its lines; of
    one's own words the paragraphs, the lines, and all of them together. Made within the row: only hashes move on.
    """
    level = lambda i: F.element_at("levels", i)
    out = _lines(messages.filter("conv_id is not null and turn is not null"))
    out = out.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("levels")), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1))))))
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("levels") + 1))
    out = out.withColumn("runs", F.zip_with("at", ends, lambda a, b: F.struct(level(a).alias("level"), a.alias("passage"), F.slice("lines", a, b - a).alias("lines"))))
    own = F.array_join(F.flatten(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["lines"])), " ")
    whole = F.struct(F.lit(0).alias("level"), F.lit(0).alias("passage"), F.array(own).alias("texts"))

    def texts(r: Column) -> Column:
        parts = _paragraphs(r["lines"])
        return F.concat(F.when(r["level"] == 0, parts).otherwise(F.concat(F.array(F.array_join(r["lines"], " ")), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))), r["lines"])

    every = F.concat(F.transform("runs", lambda r: F.struct(r["level"].alias("level"), r["passage"].alias("passage"), texts(r).alias("texts"))), F.array(whole))
    out = out.select("key", "conv_id", "turn", F.explode(every).alias("r")).select("key", "conv_id", "turn", "r.level", "r.passage", F.explode("r.texts").alias("line"))
    out = out.select("key", "conv_id", "turn", "level", "passage", normalised(F.col("line")).alias("line")).filter("line <> ''")
    # what is said needs neither its message nor its size
    quoted = lambda c: F.when(F.col("level") > 0, F.col(c)).alias(c)
    return out.withColumns({"hash": F.xxhash64("line", F.lit(3)), "size": F.length("line")}).select(quoted("key"), "conv_id", "turn", "level", quoted("passage"), "hash", quoted("size"))


def linked(every: DataFrame) -> DataFrame:
    """Each quoted unit with ``source``, the last earlier turn of its conversation that says it, or null.

    An as-of join, linear in the rows. Conversations that fill several blocks of turns are taken block by block, with the last
    turn of the blocks before, so that a hash that is everywhere in a long conversation is split.
    """
    block, key = F.floor(F.col("turn") / BLOCK).alias("block"), ["conv_id", "hash"]
    both = every.select("key", *key, "turn", block, "level", "passage", "size")
    near = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("near", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(near)).filter("level > 0")
    columns = ["key", "conv_id", "turn", "level", "passage", "size"]
    long = materialise(every.groupBy("conv_id").agg(F.min(block).alias("lo"), F.max(block).alias("hi")).filter("lo < hi").select("conv_id"))
    if long.isEmpty():
        return inside.select(*columns, F.col("near").alias("source"))
    tops = both.join(long, "conv_id", "left_semi").groupBy(*key, "block").agg(F.max(F.when(F.col("level") == 0, F.col("turn"))).alias("top"))
    carry = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.withColumn("carried", F.max("top").over(carry)).filter("carried is not null").select(*key, "block", "carried")
    return inside.join(before, [*key, "block"], "left").select(*columns, F.coalesce("near", "carried").alias("source"))


def _trees(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of every turn with a parent, by doubling: each round follows twice as far."""
    old = at = materialise(parents.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).alias("depth")))
    while True:
        beyond = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = materialise(at.join(beyond, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        release(old)
        old, at = step, step.select("conv_id", "turn", "up", "depth")
        if step.filter("moved").isEmpty():
            return at.select("conv_id", "turn", F.col("up").alias("root"), "depth")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, text (own words), parent_turn, root_turn, depth, n_quoted, n_linked, position.

    n_quoted counts passages, n_linked those that link, themselves or by a paragraph or line. position counts from 1 in reply
    order within the conversation: by the root's turn, depth, turn, then a digest of the message. Null texts count as empty.
    Rows with a null conv_id or turn are returned as roots that link with nothing (null conv_ids are numbered together), rows
    that repeat a turn as messages of one place in the tree; equal rows stand next to each other. Links go to earlier turns
    only, so there are no circles. Texts of any length are read whole. Extra columns are ignored; an empty table gives an
    empty result.

    Texts move once, for the last join; before that, digests and counts move.
    """
    given = messages.select("conv_id", "turn", "role", "text").withColumn("key", _key())
    # only conversations in which someone quotes have links
    talk = materialise(given.filter(F.col("text").rlike(r"(?m)" + QUOTE)).select("conv_id").distinct())
    every = materialise(units(given).join(talk, "conv_id", "left_semi"))
    links = materialise(linked(every))
    votes = links.filter("source is not null").groupBy("key", "conv_id", "turn", "level", "source").agg(F.sum("size").alias("size"))
    best = votes.groupBy("key", "conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "size", "source")).alias("x")).select("key", "conv_id", "turn", F.col("x.source").alias("parent"))
    trees = _trees(best.groupBy("conv_id", "turn").agg(F.max("parent").alias("parent")))
    passages = links.groupBy("key", "passage").agg(F.max(F.col("source").isNotNull().cast("long")).alias("linked")).groupBy("key").agg(F.countDistinct("passage").alias("n_quoted"), F.sum("linked").alias("n_linked"))
    info = passages.join(best.select("key", F.col("parent").alias("parent_turn")), "key", "left")
    narrow = given.select("key", "conv_id", "turn").groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.count(F.lit(1)).alias("copies"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    placed = narrow.join(info, "key", "left").join(trees, ["conv_id", "turn"], "left").select("key", "conv_id", "turn", "copies", "parent_turn", F.coalesce("root", "turn").alias("root_turn"), zero("depth").alias("depth"), zero("n_quoted").alias("n_quoted"), zero("n_linked").alias("n_linked"))
    numbers = _numbered(materialise(placed)).drop("conv_id", "turn", "copies")
    tidy = lambda c: F.btrim(F.regexp_replace(c, "\n{3,}", "\n\n"), F.lit(" \t\n"))
    out = _lines(given.join(numbers, "key"))
    own = F.transform(F.filter(F.arrays_zip("levels", "lines"), lambda x: x["levels"] == 0), lambda x: x["lines"])
    spoken = F.when(F.col("n_quoted") > 0, F.filter(own, lambda s: ~F.lower(F.trim(s)).rlike(INTRODUCES))).otherwise(own)
    among = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # of equal rows, which are where the join put them
    return out.select("conv_id", "turn", "role", tidy(F.array_join(spoken, "\n")).alias("text"), "parent_turn", "root_turn", "depth", "n_quoted", "n_linked", (F.col("before") + among).cast("long").alias("position"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``before``: how many messages of the conversation stand before each.

    Conversations of more than BLOCK messages, be they one tree, are dealt by ranges of their order; what the ranges before
    hold is added to the place within the range.
    """
    order = ["root_turn", "depth", "turn", "key"]
    before = lambda w: F.coalesce(F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # keys without nulls: null conv_ids are one conversation
    rows = rows.withColumns({"c": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    conv = ["c", "none"]
    big = materialise(rows.groupBy(*conv).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(*conv))
    if big.isEmpty():
        return rows.withColumn("before", before(Window.partitionBy(*conv).orderBy(*order))).drop(*conv)
    small = rows.join(big, conv, "left_anti").withColumn("before", before(Window.partitionBy(*conv).orderBy(*order)))
    dealt = materialise(rows.join(big, conv, "left_semi").repartitionByRange(tasks(rows.sparkSession), *conv, *order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy(*conv, "part").agg(F.sum("copies").alias("copies")).withColumn("earlier", before(Window.partitionBy(*conv).orderBy("part"))).drop("copies")
    large = dealt.withColumn("within", before(Window.partitionBy(*conv, "part").orderBy(*order))).join(parts, [*conv, "part"]).withColumn("before", F.col("within") + F.col("earlier"))
    return small.unionByName(large.select(*small.columns)).drop(*conv)


def query(spark, sf_dir: str) -> DataFrame:
    return linked_conversations(table(spark, sf_dir, "conversations"))

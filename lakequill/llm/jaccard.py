"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its five-word shingles (64-bit hashes of them); documents link at a Jaccard similarity of t or
more. Shingles have one global order: rare ones first, frequent ones last, by hash within each class. A set of n may miss
at most m = n - ceil(t n) of its shingles in a partner, so two linked sets share one of their first m + 1.

* Is that one rare, it is found under single rare shingles: a set indexes its rare ones among the first m + 1.
* Otherwise the sets share no rare shingle at all, and everything they share is frequent. Such sets (at most m rare ones)
  index combinations of two frequent shingles that follow each other in the order. Of the union U, t U are shared and at
  most (1 - t) U are not, so at least (2 t - 1) U - 1 such combinations are common, and the extended prefix of
  f - ceil((2 t - 1) n) + 1 combinations of f frequent shingles (by hash of the combination) holds a common one.

Candidates pass a size filter and a bitmap filter (parities of shingle hashes: the Hamming distance of two bitmaps never
exceeds the size of the symmetric difference), both exact, before texts are fetched and compared by all of their shingles.
Shingles are compared by 64-bit hashes of their words, there as well.

Pairs are not expanded within a group. Equal sets form a class, of which one member is indexed. Every entry of a key is
first compared with the key's leader, the entry with the fewest rare shingles; keys of frequent combinations are salted,
and the leaders of the salts compared with each other. Of the keys whose entries then lie in several components, entries of
different components are compared in cells of at most CELL times CELL entries, by their bitmaps alone; only the pairs that
pass become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, named, small, table, tasks, with_utf8
from .components import components
from .words import word_hashes

WORDS, PERCENT = 5, 80
#: Bitmaps have a power of two of bits, at least twice the shingles within these bounds.
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 16
#: Within a cell, bitmaps folded to at most so many bits are compared; pairs that pass meet the whole ones later.
CELL_BITS = 1 << 10
SALTS, CELL = 32, 2048
#: Shingles in this many documents or more are frequent; the bound doubles until at most MOST_FREQUENT are (8 MB broadcast).
FREQUENT, MOST_FREQUENT = 32, 1_000_000
#: Counts start within so many shingles at a time; fewer than LOCAL of one there are not counted.
CHUNK, LOCAL = 4_000_000, 3

_P = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) * (2 * j + 1) % (1 << 64) | 1) for j in range(WORDS + 1)]


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text, A-Z lower-cased; of one with fewer words, the whole sequence as one."""
    w = word_hashes(text.lower())
    n = len(w)
    if n == 0:
        return w
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out += w[j : n - size + 1 + j] * _P[j]
    return np.unique(mix(out))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the shingles' counts by the low bits of their hashes. The two halves, XORed, are the bitmap of half the size."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(tokens)).bit_length()))
    parity = (np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of at most ``size`` bits."""
    while 64 * len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The greatest symmetric difference of two linked sets of these sizes."""
    return a + b - 2 * -(-percent * (a + b) // (100 + percent))


def prefixes(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The keys of single rare shingles and of combinations of frequent ones that a set is indexed under; its number of rare ones."""
    n = len(tokens)
    often = np.zeros(n, bool)
    if len(frequent):
        classes = class_of(tokens)
        at = np.minimum(np.searchsorted(frequent, classes), len(frequent) - 1)
        often = frequent[at] == classes
    miss = n - -(-percent * n // 100)
    rare = tokens[~often]
    if len(rare) > miss:
        return rare[: miss + 1], rare[:0], len(rare)
    f = tokens[often]
    if len(f) < 2:
        return rare, rare[:0], len(rare)
    pairs = np.sort(mix(f[:-1] * _P[0] + f[1:] * _P[WORDS]))
    return rare, pairs[: max(0, len(f) - -(-(2 * percent - 100) * n // 100) + 1)], len(rare)


def _profile(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, n, set hash, bitmap) and, with ``kind`` 1, counts of shingles that are frequent somewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def counted() -> pa.RecordBatch | None:
            t = np.concatenate(held) if held else np.empty(0, np.uint32)
            held.clear()
            t.sort()
            at = np.flatnonzero(t[LOCAL - 1 :] == t[: len(t) - LOCAL + 1]) if len(t) >= LOCAL else np.empty(0, np.int64)
            at = at[np.concatenate([[True], t[at[1:]] != t[at[:-1]]])] if len(at) else at
            t, c = t[at].astype(np.int64), np.searchsorted(t, t[at], "right") - at
            if len(t):
                return pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int32)), pa.array(t), pa.array(c.astype(np.int64)), pa.nulls(len(t), pa.binary()), pa.nulls(len(t), pa.list_(pa.int64())), pa.nulls(len(t), pa.list_(pa.int64()))], names=names)
            return None

        for batch in small(batches):
            ids, n, sets, maps = batch.column("doc_id"), [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                maps.append(bitmap(s))
                if len(s):
                    held.append(class_of(s))
                    total += len(s)
                if total >= CHUNK:
                    if (out := counted()) is not None:
                        yield out
                    total = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), ids, pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(maps, pa.list_(pa.int64())), pa.array([folded(m, CELL_BITS) for m in maps], pa.list_(pa.int64()))], names=names)
        if (out := counted()) is not None:
            yield out

    names = ["kind", "id", "n", "hash", "bits", "small"]
    return docs.mapInArrow(run, "kind int, id long, n long, hash binary, bits array<long>, small array<long>")


def class_of(tokens: np.ndarray) -> np.ndarray:
    """What shingles are counted by: the upper half of the hash. Rare shingles that share it with frequent ones pass for frequent."""
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _frequent(profile: DataFrame) -> np.ndarray:
    """The frequent shingles by class, sorted. Their number is known to be at most MOST_FREQUENT before they reach the driver."""
    counts = profile.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    counts = materialise(counts)
    steps = sorted((r["k"], r["c"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect())
    bound = FREQUENT.bit_length() - 1
    while sum(c for k, c in steps if k >= bound) > MOST_FREQUENT:
        bound += 1
    found = counts.filter(F.col("n") >= 1 << bound).select("id").toPandas()["id"].to_numpy(np.int64)
    return np.sort(found.astype(np.uint32))


def _entries(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(key, id, rare, salt): what each document is indexed under, with its number of rare shingles; salt is -1 under single ones."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in small(batches):
            keys, ids, rares, salts = [], [], [], []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(text)
                one, two, rare = prefixes(s, often, percent)
                keys += [one, two]
                ids.append(np.full(len(one) + len(two), doc_id, np.int64))
                rares.append(np.full(len(one) + len(two), rare, np.int32))
                salts += [np.full(len(one), -1, np.int32), np.full(len(two), xxhash.xxh3_64_intdigest(s.tobytes()) % SALTS, np.int32)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (ids, rares, salts))], names=["key", "id", "rare", "salt"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text").mapInArrow(run, "key long, id long, rare int, salt int")


def _plausible(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that pass the size and the bitmap filter; no pair that could link is lost."""
    sides = profile.select("id", "n", "bits")
    x = pairs.distinct().join(sides.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a").join(sides.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")

    def fold(bits: Column, other: Column) -> Column:
        half = F.floor(F.size(bits) / 2).cast("int")
        return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(bits)

    ba, bb = F.col("ba"), F.col("bb")
    differ = F.aggregate(F.zip_with(fold(ba, bb), fold(bb, ba), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    shared = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100.0 + percent) - 1e-6)
    # the sizes come first, so that of two bitmaps one is at most twice as long
    return x.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).filter(F.when(F.size("ba") <= 2 * F.size("bb"), F.size("bb") <= 2 * F.size("ba")).otherwise(False)).filter(differ <= F.col("na") + F.col("nb") - 2 * shared).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose texts link, by all of their shingles. Only the texts that occur in a pair are moved."""
    wanted = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = wanted.count() <= 500_000  # 8 bytes each
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    texts = materialise(texts)
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "x"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, last, own = [], None, None
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                if last != x:
                    last, own = x, shingles(x)
                other = shingles(y)
                both = np.concatenate([own, other])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common and 100 * common >= percent * (len(both) - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return materialise(both.mapInArrow(run, "a long, b long").distinct())


def _cells(live: DataFrame, comps: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) under one key and of different components that pass the size and the small bitmap filter.

    The entries of a key are dealt to cells: of m entries, each goes to m / CELL cells, and a cell holds 2 CELL at most.
    """
    at = live.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    several = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi and c > 2").select("key", F.ceil(F.col("c") / F.lit(float(CELL))).cast("int").alias("sides"))
    rows = at.join(several, "key").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows = rows.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "comp")
    rows = rows.join(profile.select("id", "n", "small"), "id").select("key", "i", "j", "side", "id", "comp", "n", "small")
    dealt = rows.repartition(tasks(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                this = tuple(keys[:, lo])
                if this != cell and held:
                    yield compared(held)
                    held = []
                cell = this
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield compared(held)

    def compared(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        across = t["i"][0] != t["j"][0]
        side, ids, comp, n = (t[c].to_numpy() for c in ("side", "id", "comp", "n"))
        maps = [np.asarray(x.values).view(np.uint64) for x in t["small"]]
        length = np.array([len(m) for m in maps])
        a, b = [], []
        for size in np.unique(length):
            own, double = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)
            every = np.concatenate([own, double])
            bits = np.stack([maps[k] if length[k] == size else maps[k][:size] ^ maps[k][size:] for k in every])
            for k, row in enumerate(own):
                rest = every[k + 1 :]
                fits = (comp[rest] != comp[row]) & (100 * np.minimum(n[rest], n[row]) >= percent * np.maximum(n[rest], n[row]))
                if across:
                    fits &= side[rest] != side[row]
                if fits.any():
                    fits = np.flatnonzero(fits)
                    near = np.bitwise_count(bits[k + 1 + fits] ^ bits[k]).sum(1) <= most_apart(n[rest[fits]], n[row], percent)
                    found = ids[rest[fits[near]]]
                    a.append(np.minimum(found, ids[row]))
                    b.append(np.maximum(found, ids[row]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def join(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(profile, components): a row per document with n and its class's id, and (id, comp) of the documents in links.

    ``docs`` has doc_id and text. Null texts count as empty; empty texts link with nothing; rows that share a doc_id are
    one document that links when any of their texts does; a null doc_id links with nothing; extra columns are ignored.
    """
    if percent < 80:
        raise ValueError("the combination prefix needs a similarity of 0.8 or more")
    docs = with_utf8(docs.select("doc_id", "text"))
    profile = materialise(_profile(docs))
    frequent = _frequent(profile)
    profile = profile.filter("kind = 0").select("id", "n", "hash", "bits", "small")
    classes = profile.filter("n > 0 and id is not null").groupBy("hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("hash", "rep")
    equal = materialise(profile.filter("n > 0 and id is not null").join(classes, "hash").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())

    # an id that stands for several different texts stays in the index with all of them
    plain = profile.groupBy("id").agg(F.min(F.xxhash64("hash")).alias("lo"), F.max(F.xxhash64("hash")).alias("hi")).filter("lo = hi").select("id")
    dropped = equal.select(F.col("b").alias("id")).distinct().join(plain, "id", "left_semi")

    key = Window.partitionBy("key", "salt")
    entries = _entries(docs, frequent, percent).withColumn("c", F.count(F.lit(1)).over(key)).withColumn("lead", F.min(F.struct("rare", "id")).over(key))
    live = materialise(entries.filter("c > 1 or salt >= 0").select("key", "id", "salt", "lead").join(dropped, "id", "left_anti"))
    leads = live.filter("salt >= 0").select("key", "lead").distinct()
    tops = leads.groupBy("key").agg(F.min("lead").alias("top"))
    stars = live.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).union(leads.join(tops, "key").select("top.id", "lead.id")).filter("a <> b")
    links = _verified(materialise(_plausible(stars, profile, percent)), docs, percent)
    near = _cells(live.select("key", "id").distinct(), components(links), profile, percent)
    links = materialise(links.union(_verified(materialise(_plausible(near, profile, percent)), docs, percent)))

    reps = equal.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("rep"))
    all_comps = components(links.union(equal))
    return profile.join(reps, "id", "left").select("id", "n", F.coalesce("rep", "id").alias("class_id")), all_comps


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id (the smallest with an equal set)."""
    profile, comps = join(docs, percent)
    return profile.join(comps, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"), "class_id")


def kept(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each group of linked rows that with the smallest doc_id, and every row outside groups.

    Rows count one by one, whatever their ids: those that repeat an id or have none are linked by their texts, a null id is
    the largest, and of rows with one id any of equal texts may stay. Null and empty texts link with nothing, so their rows
    stay. Texts of any length are read whole; an empty table gives an empty result. Columns of any name stay as they are.
    """
    whole = F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = materialise(docs.select(whole.alias("given"), "doc_id").withColumn("row", F.monotonically_increasing_id()))
    text = F.col(f"given.c{docs.columns.index('text')}")
    comps = join(rows.select(F.col("row").alias("doc_id"), text.alias("text")), percent)[1]
    members = comps.join(rows.select(F.col("row").alias("id"), "doc_id"), "id")
    stays = members.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("x")).select("comp", F.col("x.id").alias("first"))
    goes = materialise(comps.join(stays, "comp").filter("id <> first").select(F.col("id").alias("row")))
    return rows.join(goes, "row", "left_anti").select(*(F.col(f"given.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Brute force in SQL: shingles are joined on themselves, components spread by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS comp FROM documents
  UNION
  SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.comp AS component_id, coalesce(k.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT id, min(comp) AS comp FROM r GROUP BY id) m ON m.id = d.doc_id
LEFT JOIN (
  SELECT x.doc_id, min(y.doc_id) AS class_id
  FROM n x JOIN n y ON x.n = y.n
  LEFT JOIN p ON p.a = x.doc_id AND p.b = y.doc_id
  WHERE x.doc_id = y.doc_id OR p.c = x.n GROUP BY x.doc_id
) k ON k.doc_id = d.doc_id
"""

"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest hash among its s-mers lies at its first or last place. The choice
looks at nothing outside the k-mer, so an unchanged passage keeps its anchors wherever it stands; of any k - s neighbouring
k-mers one is an anchor. A text that is too short to have one takes its smallest k-mer, or itself.

A fingerprint is the sequence of a text's anchors: eight hex digits of the hash and two of the distance from the anchor
before (from the beginning for the first), so it grows with the text and nothing is sampled. Matching is by position: two
neighbouring anchors and their distance form a link, and only equal links match, so anchors count where they stand in the
same place to each other. Likeness is the Jaccard index of the links, each as often as it occurs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small, table, tasks

K, S = 12, 5
_BASE = 0x9E3779B97F4A7C15
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, j, 1 << 64) for j in range(n)], np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _kmers(points: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    powers, hashes = _powers(k), np.zeros(len(at), np.uint64)
    for j in range(k):
        hashes += points[at + j] * powers[j]
    return mix(hashes)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's closed syncmers; without any its smallest k-mer, of a text shorter than k itself."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if n < k:
        return np.zeros(1, np.int64), mix(np.array([(points * _powers(n)).sum()], np.uint64) + np.uint64(n))
    powers, h = _powers(s), np.zeros(n - s + 1, np.uint64)
    for j in range(s):
        h += points[j : n - s + 1 + j] * powers[j]
    h = mix(h)
    width = k - s + 1
    low, have = h, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = np.flatnonzero((low == h[: len(low)]) | (low == h[width - 1 :]))
    if len(at) == 0:
        every = np.arange(n - k + 1)
        at = every[[int(np.argmin(_kmers(points, every, k)))]]
    return at, _kmers(points, at, k)


class Fingerprint:
    """Hashes (32 bits) and distances of the anchors in turn, and the links that they form."""

    __slots__ = ("hashes", "steps", "links", "counts")

    def __init__(self, hashes: np.ndarray, steps: np.ndarray):
        self.hashes, self.steps = hashes, steps
        wide = hashes.astype(np.uint64)
        ends = wide[:1] if len(wide) == 1 else wide[1:]  # one anchor alone is a link to itself
        gaps = steps[:0] if len(wide) == 1 else steps[1:]
        links = mix(mix(wide[: len(ends)]) + (ends << np.uint64(8)) + (gaps.astype(np.uint64) if len(gaps) else np.uint64(0)))
        self.links, self.counts = np.unique(links, return_counts=True)

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        at, hashes = anchors(code_points(text))
        return cls((hashes >> np.uint64(32)).astype(np.uint32), np.diff(at, prepend=0).astype(np.uint8))

    @classmethod
    def parse(cls, written: str) -> Fingerprint:
        rows = np.frombuffer(bytes.fromhex(written), np.uint8).reshape(-1, 5)
        return cls(np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.uint32), rows[:, 4].copy())

    def __str__(self) -> str:
        rows = np.empty((len(self.hashes), 5), np.uint8)
        rows[:, :4] = self.hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
        rows[:, 4] = self.steps
        return rows.tobytes().hex()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Jaccard index of the links of two texts, with their counts; two empty texts are alike, an empty one is like no other."""
    if not len(a.links) or not len(b.links):
        return float(len(a.links) == len(b.links))
    _, i, j = np.intersect1d(a.links, b.links, assume_unique=True, return_indices=True)
    shared = int(np.minimum(a.counts[i], b.counts[j]).sum())
    return shared / (int(a.counts.sum()) + int(b.counts.sum()) - shared)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _neighbours(docs: DataFrame) -> DataFrame:
    """Each row goes to a range of ids, and the first of each range also, as a guest, to the range whose last row it follows.

    Ranges follow quantiles of the ids; an id that fills several (or no id at all) is split by ranges of the text's hash, by
    which rows of one id are ordered. Only one row for each range reaches the driver. The texts move once.
    """
    spark, n = docs.sparkSession, tasks(docs.sparkSession)
    docs = docs.withColumns({"key": F.col("doc_id").cast("double"), "tie": F.xxhash64("text")})
    found = docs.select("key").stat.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    quantiles = Counter(found)
    cuts = sorted(quantiles)
    splits = [-float("inf"), *cuts, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    count = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id")).first()
    # a null id comes last of all: in no bucket, so below the lowest
    ways = {-1: max(1, round(n * (1 - count["with_id"] / max(1, count["n"]))))} | {i + 1: quantiles[c] for i, c in enumerate(cuts) if abs(c) < 1 << 53}
    ways = {p: w for p, w in ways.items() if w > 1}
    placed = Bucketizer(splits=splits, inputCol="key", outputCol="part", handleInvalid="keep").transform(docs)
    placed = placed.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("part").cast("int")))
    sub = F.lit(0)
    if ways:
        hot = F.broadcast(spark.createDataFrame([(p, w, int(splits[p]) if p > 0 else None) for p, w in ways.items()], "hot int, ways int, which long"))
        placed = placed.join(hot, (F.col("part") == F.col("hot")) & F.col("doc_id").eqNullSafe(F.col("which")), "left")
        share = (F.col("tie").cast("double") / float(1 << 64) + 0.5) * F.col("ways")
        sub = F.when(F.col("hot").isNotNull(), 1 + F.least(F.floor(share).cast("int"), F.col("ways") - 1)).otherwise(0)
    placed = placed.select("doc_id", "text", "tie", "part", sub.alias("sub"))
    heads = placed.groupBy("part", "sub").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("below"), "tie")).alias("x")).select("part", "sub", F.bitwise_not("x.below").alias("head"), "x.tie").collect()
    if not heads:
        return placed.select("doc_id", "text", F.lit(0).alias("part"), F.lit(0).alias("guest"))
    heads.sort(key=lambda r: (-r["part"], r["sub"]))  # descending ids, and within one id ascending hashes
    to = [(r["part"], r["sub"], i, r["head"], r["tie"], (i - 1) % len(heads)) for i, r in enumerate(heads)]
    slots = F.broadcast(spark.createDataFrame(to, "p int, s int, slot int, head long, first long, host int"))
    placed = placed.join(slots, (F.col("part") == F.col("p")) & (F.col("sub") == F.col("s")))
    own = F.struct(F.col("slot").alias("part"), F.lit(0).alias("guest"))
    leads = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("first"))
    out = placed.select("doc_id", "text", "tie", F.explode(F.when(leads, F.array(own, F.struct(F.col("host").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(own))).alias("x"))
    return out.select("doc_id", "text", "tie", "x.part", "x.guest").repartitionById(len(heads), "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "tie", "text").select("doc_id", "text", "part", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited form: the last half replaced by the next document's beginning.

    The next document is the one that follows in descending doc_id (null ids last; rows with one id by a hash of the text),
    after the last the first; a single document is its own next. Null texts count as empty; texts of any length are read
    whole; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in small(batches):
            rows = []
            for doc_id, text, part, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest")), strict=True):
                if guest and (before is None or before[2] != part):
                    continue  # a repeated guest
                own = Fingerprint.of(text)
                if before is not None and before[2] == part:
                    rows.append(result(before, text, own))
                before = None if guest else (doc_id, text, part, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def result(row: tuple, following: str, next_own: Fingerprint) -> tuple:
        doc_id, text, _, own = row
        new = edited(text, following)
        other = Fingerprint.of(new)
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(other), likeness(own, other), likeness(own, next_own)

    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return _neighbours(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

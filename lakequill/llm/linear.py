"""What the two text classifiers share: folds, the bounded training sample, hashed n-grams, batch scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, small, with_utf8

#: At most about this many labelled rows are learned from, half of them of each class: shares by a hash of the id, alike in every run.
MAX_TRAINING_ROWS = 16_000
#: and at most about so many bytes of text, half of each class, which bounds the memory of the one task that learns.
MAX_TRAINING_BYTES = 128 << 20

_P = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 3) * (2 * j + 5) % (1 << 64) | 1) for j in range(8)]
#: ASCII letters in lower case and digits stay, other ASCII characters part words; bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def fold(doc_id: str, modulus: int, held_out: int) -> Column:
    """Whether a row is held out: crc32 of the id's text, modulo. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == held_out, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int = MAX_TRAINING_ROWS, most_bytes: int = MAX_TRAINING_BYTES) -> tuple[DataFrame, float]:
    """(doc_id, y, text) of the sample, and what to add to the log-odds of its model.

    Rows without a label or an id, and all held-out rows, are out; of a repeated id the largest label counts, and the least
    text. Each class has about ``most`` / 2 rows and ``most_bytes`` / 2 bytes at most; the shift of the log-odds takes back
    that the classes were sampled at different rates.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~fold("doc_id", modulus, held_out)).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    rates = {r["y"]: min(1.0, most / 2 / r["n"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def below(rates: dict[int, float]) -> DataFrame:
        return rows.filter(at < F.when(F.col("y") == 1, int(rates.get(1, 1) * (1 << 30))).otherwise(int(rates.get(0, 1) * (1 << 30))))

    # the sample's ids are few, whatever there is; texts are compared only where one repeats
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(below(rates)), "doc_id").groupBy("doc_id", "y").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    sizes = materialise(sizes)
    several = False
    for r in sizes.groupBy("y").agg(F.sum("size").alias("size"), F.max("rows").alias("rows")).collect():
        rates[r["y"]] *= min(1.0, most_bytes / 2 / max(1, r["size"] or 0))
        several |= r["rows"] > 1
    picked = sizes.join(F.broadcast(below(rates)), ["doc_id", "y"], "left_semi").select("doc_id", "y", "rows")
    sample = with_utf8(docs.select("doc_id", "text")).join(F.broadcast(picked), "doc_id")
    if several:
        least = sample.filter("rows > 1").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        sample = sample.filter("rows = 1").select("doc_id", "y", "text").unionByName(least)
    return sample.select("doc_id", "y", "text"), math.log(rates.get(0, 1.0) / rates.get(1, 1.0))


def trained(rows: DataFrame, features: Callable[[bytes], np.ndarray], fit: Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, weight and norm share of each feature that ``fit`` keeps; features are made in parallel, the bounded sample is learned in one task."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["doc_id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for b in batches:
            xs += [np.asarray(x.values) for x in b.column("x")]
            ys += b.column("y").to_pylist()
        if xs:
            i, w, v = fit(xs, np.array(ys, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, pa.float64()), pa.array(v, pa.float64())], names=["i", "w", "v"])

    made = rows.mapInArrow(extract, "doc_id long, y int, x array<int>")
    got = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id").mapInArrow(learn, "i long, w double, v double").toPandas()
    return got["i"].to_numpy(np.int64), got["w"].to_numpy(np.float64), got["v"].to_numpy(np.float64)


def scored(docs: DataFrame, held: Column, threshold: float, features: Callable[[bytes], np.ndarray], size: int, weights: tuple[np.ndarray, np.ndarray, np.ndarray], probability: Callable[[float, float], float]) -> DataFrame:
    """doc_id, held_out, score, predicted. Weights and norm shares that are kept are broadcast; there are at most ``size`` of each."""
    shared = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1], weights[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, norm = np.zeros((2, size))
        at, w, v = shared.value
        weight[at], norm[at] = w, v
        for b in small(batches):
            scores = []
            for text in b.column("text").to_pylist():
                x = features(text)
                scores.append(probability(float(weight[x].sum()), float(norm[x].sum())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    given = with_utf8(docs.select("doc_id", "text")).select("doc_id", held.alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def folded(text: bytes) -> bytes:
    """The text with words of letters and digits parted by spaces."""
    return text.translate(_FOLD)


def grams(w: np.ndarray, offsets: tuple[int, ...], salt: int) -> np.ndarray:
    """Hashes of the tuples of w at i + each offset."""
    n = len(w) - offsets[-1]
    if n <= 0:
        return w[:0]
    out = np.full(n, salt, np.uint64)
    for j, o in enumerate(offsets):
        out += w[o : o + n] * _P[j]
    return mix(out)


def indices(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """The sorted distinct feature numbers."""
    return np.unique((np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int32))


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, x))))

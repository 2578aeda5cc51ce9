"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are folded: letters by Unicode case folding, every run of other ASCII characters than letters and digits as
one space, bytes beyond ASCII kept. An item of m folded bytes may occur with up to k = m // PER_ERROR edits (insertions,
deletions, substitutions of bytes). The spaces around an item and a text belong to them, so a short item matches whole words
only. An item is cut into k + 1 pieces, one of which must then occur unchanged: an Aho-Corasick
automaton over all pieces finds such places in one pass over the text. A hit is checked upwards through pairs of pieces,
fours, and so on, each of which must occur near the hit with fewer edits than it has pieces, and at last as the whole item,
by Myers' bit-parallel distance. Nothing that the budget allows is lost on the way.

Documents are not moved: the items go to them, in blocks of at most BLOCK_BYTES, one pass over the documents for each
block. Any number of blocks gives whole results.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import small, table, with_utf8

PER_ERROR = 10
BLOCK_BYTES = 8 << 20
RESULT = "doc_id long, item_id long, distance int, start long, end long"


def _cased(text: bytes) -> bytes:
    """The text without differences of case; ASCII needs nothing more than ``linear.folded`` does."""
    return text if text.isascii() else text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")


def folded(text: bytes) -> str:
    """The folded bytes, one character each."""
    return b" ".join(linear.folded(_cased(text)).split()).decode("latin-1")


class Myers:
    """Least edit distance of a pattern to any part of a text."""

    def __init__(self, pattern: str):
        self.m, self.eq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str, most: int, from_start: bool = False) -> tuple[int, int] | None:
        """(distance, end) of the leftmost best occurrence with at most ``most`` edits; ``from_start``: only at the beginning."""
        full, high = (1 << self.m) - 1, 1 << (self.m - 1)
        vp, vn, score, get = full, 0, self.m, self.eq.get
        found = (score, 0) if score <= most else None
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | vn
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp = vn | (~(xh | vp) & full)
            hn = vp & xh
            if hp & high:
                score += 1
            elif hn & high:
                score -= 1
                if score <= most:
                    found, most = (score, j), score - 1
            hp, hn = (hp << 1 | from_start) & full, hn << 1 & full
            vp = hn | (~(xv | hp) & full)
            vn = hp & xv
        return found


class Item:
    def __init__(self, text: str, per_error: int):
        self.text, self.m, self.k = f" {text} ", len(text) + 2, len(text) // per_error
        n = self.k + 1
        self.cuts = [self.m * i // n for i in range(n + 1)]
        self.parts: dict[tuple[int, int], Myers] = {}

    def part(self, lo: int, hi: int) -> Myers:
        if (found := self.parts.get((lo, hi))) is None:
            found = self.parts[lo, hi] = Myers(self.text[self.cuts[lo] : self.cuts[hi]])
        return found

    def backwards(self) -> Myers:
        """The item from its end, to find where a place begins."""
        if (0, 0) not in self.parts:
            self.parts[0, 0] = Myers(self.text[::-1])
        return self.parts[0, 0]

    def occurs(self, text: str, piece: int, at: int) -> tuple[int, int] | None:
        """(distance, end) of the item around a piece that stands at ``at``, or None."""
        n, width = self.k + 1, 1
        while True:
            width *= 2
            lo = piece // width * width
            hi, whole = min(lo + width, n), width >= n
            errors = hi - lo - 1
            left = max(0, at - (self.cuts[piece] - self.cuts[lo]) - errors)
            right = at + (self.cuts[hi] - self.cuts[piece]) + errors
            if hi - lo > 1 or whole:
                found = self.part(lo, hi).best(text[left:right], errors)
                if found is None:
                    return None
                if whole:
                    return found[0], left + found[1]


class Matcher:
    """All items of a block, ready to search."""

    def __init__(self, items: list[tuple[int, bytes]], per_error: int = PER_ERROR):
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            if t := folded(text):
                by_text.setdefault(t, []).append(item_id)
        self.items = [(Item(t, per_error), ids) for t, ids in by_text.items()]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (item, _) in enumerate(self.items):
            for j in range(item.k + 1):
                places.setdefault(item.text[item.cuts[j] : item.cuts[j + 1]], []).append((i, j))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def _hits(self, t: str) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end) around the pieces that occur in a folded text with a space on each side."""
        done: set[tuple[int, int]] = set()  # items and diagonals that were found: their other pieces give the same place
        for last, (size, where) in self.automaton.iter(t):
            for i, j in where:
                item, at = self.items[i][0], last + 1 - size
                if (i, at - item.cuts[j]) in done:
                    continue
                found = item.occurs(t, j, at)
                if found is not None:
                    done.add((i, at - item.cuts[j]))
                    yield i, *found

    def occurs(self, text: bytes) -> bool:
        """Whether any item is in the text."""
        return not self.empty and next(self._hits(f" {folded(text)} "), None) is not None

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of every place of every item in the text; offsets in folded bytes.

        Of places whose ends are nearer than half the item, the one with the least distance counts, then the first.
        """
        if self.empty:
            return []
        t, ends, out = f" {folded(text)} ", {}, []
        for i, distance, end in self._hits(t):
            ends.setdefault(i, set()).add((distance, end))
        for i, found in ends.items():
            item, ids = self.items[i]
            taken: list[int] = []
            for distance, end in sorted(found):
                at = bisect.bisect(taken, end)
                if any(abs(end - x) <= item.m // 2 for x in taken[max(0, at - 1) : at + 1]):
                    continue
                taken.insert(at, end)
                back = t[max(0, end - item.m - item.k) : end][::-1]
                length = item.backwards().best(back, distance, True)[1]
                out += [(item_id, distance, max(0, end - length - 1), min(len(t) - 2, end - 1)) for item_id in ids]
        return out


def code_points(text: bytes) -> np.ndarray:
    """For each folded byte of a text the code point of the text that it stands for."""
    cased = _cased(text)
    kept = np.frombuffer(linear.folded(cased), np.uint8) != 32
    stays = kept.copy()
    stays[1:] |= kept[:-1]  # the first separator of each run
    at = np.flatnonzero(stays)
    at = at[np.argmax(kept[at]) :] if len(at) else at
    at = at[:-1] if len(at) and not kept[at[-1]] else at
    point = np.cumsum((np.frombuffer(cased, np.uint8) & 0xC0) != 0x80) - 1
    if len(cased) != len(text) or cased != text:
        plain = text.decode("utf-8", "surrogateescape")
        sizes = [len(c.casefold()) for c in plain] if not text.isascii() else []
        if sum(sizes) != len(plain) and sizes:  # some characters fold to several
            point = np.repeat(np.arange(len(plain)), sizes)[point]
    return point[at]


def _placed(found: list[tuple[int, int, int, int]], text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """The matches with offsets in code points, without separators at their ends."""
    t, points = folded(text), code_points(text)
    for item_id, distance, start, end in found:
        while start < end and t[start] == " ":
            start += 1
        while end > start and t[end - 1] == " ":
            end -= 1
        yield item_id, distance, *((int(points[start]), int(points[end - 1]) + 1) if start < end else (0, 0))


_built: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int, bytes]], per_error: int) -> Matcher:
    """The matcher of a block; a worker keeps the last one that it built for its next tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, per_error)
    return _built[key]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for r in with_utf8(benchmark.filter("item_id is not null").select("item_id", "text")).toLocalIterator(prefetchPartitions=False):
        if block and size + len(r["text"]) > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], bytes(r["text"])))
        size += len(r["text"])
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, end: every place of each benchmark item in each document (code points, end exclusive).

    Of places that overlap by half or more the best counts, of ties the first. Null and empty texts and items without any
    letter or digit match nothing; items with equal folded text all match; rows that repeat a doc_id give their matches one
    by one; texts of any length are searched whole; extra columns are ignored; an empty table gives an empty result.
    """
    sc, given, out = docs.sparkSession.sparkContext, with_utf8(docs.select("doc_id", "text").filter("text is not null")), None

    def search(shared, key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared.value, per_error)
            for batch in small(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if found := matcher.search(text):
                        rows += [(doc_id, *x) for x in _placed(found, text)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        return run

    for block in _blocks(benchmark, block_bytes):
        found = given.mapInArrow(search(sc.broadcast(block), uuid.uuid4().hex), RESULT)
        out = found if out is None else out.unionAll(found)
    return out


def kept(docs: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark item occurs. The documents are filtered where they are read.

    Null and empty texts stay; rows that repeat an id are judged by their own text; without an item every row stays; an empty
    table gives an empty result. All columns, of any name, stay as they are.
    """
    sc, out = docs.sparkSession.sparkContext, docs

    def clean(shared, key: str):
        @F.arrow_udf("boolean")
        def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            matcher = _matcher(key, shared.value, per_error)
            for batch in texts:
                yield pa.array([not matcher.occurs(t) for part in small([batch]) for t in part.to_pylist()], pa.bool_())

        return passes(F.coalesce("text", F.lit("")).cast("binary"))

    for block in _blocks(benchmark, block_bytes):
        out = out.filter(clean(sc.broadcast(block), uuid.uuid4().hex))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

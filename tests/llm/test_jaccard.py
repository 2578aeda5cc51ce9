import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import AWKWARD, documents, text

from lakequill.llm import jaccard
from lakequill.llm.components import components
from lakequill.llm.words import word_hashes


def sets(rows):
    out = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()))
    return out


def brute(rows):
    """(doc_id, n_shingles, component_id) by all pairs."""
    s = sets(rows)
    up = {d: d for d, _ in s if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(((d, len(x), root(d) if d is not None else None) for d, x in s), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    assert found(jaccard.near_duplicates(documents(spark, AWKWARD))) == brute(AWKWARD)
    assert jaccard.near_duplicates(documents(spark, AWKWARD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.near_duplicates(documents(spark, AWKWARD), 70)


def edited(t, r, share):
    return " ".join(w if r.random() > share else f"new{r.randrange(10**9)}" for w in t.split())


def crowd():
    """Groups of edited copies around the threshold, chains, passages that many documents share, and copies of copies."""
    r, rows = random.Random(3), []
    for g in range(6):
        base = text(100 + g, 120)
        rows += [base] + [edited(base, r, e) for e in (0.002, 0.005, 0.01, 0.02, 0.03, 0.04) for _ in range(6)]
    base = text(7, 100).split()
    rows += [" ".join(base[i : i + 80]) for i in range(0, 20, 2)]
    shared = text(8, 70)
    rows += [f"{shared} {text(1000 + i, 20)}" for i in range(90)] + [f"{text(2000 + i, 300)} {shared}" for i in range(40)]
    rows += [rows[5]] * 40 + ["a b c d e", "a b c d e f", "A b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_crowd(spark, monkeypatch):
    rows = crowd()
    want = brute(rows)
    assert found(jaccard.near_duplicates(documents(spark, rows, extra=False))) == want
    # the same with low bounds, so that frequent combinations, salts and many cells are met
    for name, value in (("FREQUENT", 4), ("CELL", 8), ("MOST_FREQUENT", 100)):
        monkeypatch.setattr(jaccard, name, value)
    assert found(jaccard.near_duplicates(documents(spark, rows, extra=False).repartition(3))) == want
    kept = {r.doc_id for r in jaccard.kept(documents(spark, rows)).collect()}
    assert kept == {d for d, _, c in want if d == c}


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60)))
def test_linked_sets_share_a_key(x, y, frequent):
    if x == y or 100 * len(x & y) < 80 * len(x | y):
        return
    as_array = lambda s: np.sort(jaccard.mix(np.array(sorted(s), np.uint64)))
    f = np.sort(jaccard.class_of(as_array(frequent))) if frequent else np.empty(0, np.uint32)
    a, b = (jaccard.prefixes(as_array(s), f, 80) for s in (x, y))
    assert set(a[0].tolist()) & set(b[0].tolist()) or set(a[1].tolist()) & set(b[1].tolist())


@settings(deadline=None, max_examples=100)
@given(st.sets(st.integers(0, 1 << 40), max_size=600), st.sets(st.integers(0, 1 << 40), max_size=600))
def test_bitmaps_never_exceed_the_difference(x, y):
    maps = [jaccard.bitmap(np.sort(jaccard.mix(np.array(sorted(s), np.uint64)))).view(np.uint64) for s in (x, y)]
    size = 64 * min(map(len, maps))
    a, b = (jaccard.folded(m, size) for m in maps)
    assert int(np.bitwise_count(a ^ b).sum()) <= len(x ^ y)


def test_word_hashes(monkeypatch):
    from lakequill.llm import words

    t = " \n\t ".join(["the", "a", "énä", "x" * 50, "ab", "ba"] * 50).encode() + b"\r\x0b\x0c"
    h = word_hashes(t)
    pairs = dict(zip(t.split(), h.tolist(), strict=True))
    assert len(h) == 300 and len(set(pairs.values())) == 6 and all(pairs[w] == v for w, v in zip(t.split(), h.tolist(), strict=True))
    monkeypatch.setattr(words, "_PIECE", 64)
    assert word_hashes(t).tolist() == h.tolist()
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (7, 7), (None, 3), (20, 11)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys((10, 11, 20), 10), **dict.fromkeys(range(100, 141), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kept_counts_rows_one_by_one(spark):
    """Rows that repeat an id, or have none, are linked by what they hold."""
    rows = [(5, text(1)), (5, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (7, text(2)), (8, text(3)), (8, text(4)), (None, None), (None, ""), (9, ""), (9, "")]
    df = documents(spark, rows)
    got = jaccard.kept(df)
    assert got.dtypes == df.dtypes
    want = [(5, text(1)), (7, text(2)), (8, text(3)), (8, text(4)), (None, None), (None, ""), (9, ""), (9, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import xxhash
from samples import AWKWARD, DATA, documents, text

from lakequill.llm import syncmers
from lakequill.llm.syncmers import Fingerprint, likeness


def brute_anchors(points, k=syncmers.K, s=syncmers.S):
    """k-mers whose smallest s-mer hash stands first or last, by definition."""
    out = []
    for i in range(len(points) - k + 1):
        h = [int(syncmers.mix(np.array([sum(int(points[i + j + t]) * pow(syncmers._BASE, t, 1 << 64) for t in range(s)) % (1 << 64)], np.uint64))[0]) for j in range(k - s + 1)]
        if min(h) in (h[0], h[-1]):
            out.append(i)
    return out


def test_anchors_by_definition():
    p = syncmers.code_points(text(1, 20) + " é😀 end of it")
    assert syncmers.anchors(p)[0].tolist() == brute_anchors(p)
    # context-free: the anchors inside a passage are the same wherever it stands
    q = syncmers.code_points("something else " + text(1, 20))
    inner = {i - 15 for i in syncmers.anchors(q)[0].tolist() if i >= 15}
    assert inner == set(syncmers.anchors(syncmers.code_points(text(1, 20)))[0].tolist())


def brute_links(t):
    """Neighbouring anchors with their distance, by definition; one anchor alone is a link to itself."""
    p = syncmers.code_points(t)
    at, h = syncmers.anchors(p)
    h = [int(x) >> 32 for x in h]
    return Counter([(h[0], 0, h[0])]) if len(h) == 1 else Counter((h[i], int(at[i + 1] - at[i]), h[i + 1]) for i in range(len(h) - 1))


def brute_likeness(t, u):
    a, b = brute_links(t), brute_links(u)
    return float(a == b) if not a or not b else sum((a & b).values()) / sum((a | b).values())


def test_fingerprints_hold_anchors_and_places():
    for t in ("", "abc", "x" * 12, text(3, 30), "word " * 3000, "é😀" * 40, text(4, 9000)):
        p = syncmers.code_points(t)
        at, h = syncmers.anchors(p)
        written = str(Fingerprint.of(t))
        places = np.cumsum([int(written[i + 8 : i + 10], 16) for i in range(0, len(written), 10)])
        assert places.tolist() == at.tolist() and [int(written[i : i + 8], 16) for i in range(0, len(written), 10)] == [int(x) >> 32 for x in h]
        back = Fingerprint.parse(written)
        assert str(back) == written and likeness(back, Fingerprint.of(t)) == 1 and (written == "") == (t == "")


def test_short_texts_have_fingerprints_of_their_own():
    r = random.Random(1)
    texts = list({"".join(r.choice("abcdefghij klmno") for _ in range(r.randrange(1, 19))) for _ in range(2000)})
    prints = [Fingerprint.of(t) for t in texts]
    assert all(len(f.hashes) for f in prints)
    empty = Fingerprint.of("")
    long = [i for i, t in enumerate(texts) if len(t) >= 3]
    assert all(likeness(f, empty) == 0 for f in prints) and sum(likeness(prints[i], prints[j]) > 0.05 for i, j in zip(long, long[1:], strict=False)) <= 2


def test_likeness_is_that_of_the_definition_and_follows_edits():
    r = random.Random(2)
    errors = []
    for n in (20, 200, 2000):
        for share in (0.0, 0.02, 0.1, 0.3, 1.0):
            words = [r.choice("ab cde fghi jklmn opqrstu".split()) + str(r.randrange(900)) for _ in range(n)]
            other = [w if r.random() >= share else "z" + str(r.randrange(10**6)) for w in words]
            t, u = " ".join(words), "head " + " ".join(other)
            got = likeness(Fingerprint.of(t), Fingerprint.of(u))
            assert abs(got - brute_likeness(t, u)) < 1e-12
            grams = [Counter(x[i : i + 16] for i in range(len(x) - 15)) for x in (t, u)]
            errors.append(abs(got - sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())))
    assert max(errors) < 0.12 and sum(errors) / len(errors) < 0.03, errors


def test_anchors_count_only_in_their_places():
    a, b, c = text(1, 60), text(2, 60), text(3, 60)
    both = [Fingerprint.of(" ".join(x)) for x in ((a, b, c), (c, a, b))]
    assert likeness(*both) > 0.9  # passages that move keep their anchors' places to each other
    words = text(5, 400).split()
    apart = " ".join(w + " " * (1 + i % 3) for i, w in enumerate(words))
    assert likeness(Fingerprint.of(" ".join(words)), Fingerprint.of(apart)) < 0.3


def tie(t):
    h = xxhash.xxh64(t.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def check(rows, got):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))
    want = []
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), str(Fingerprint.of(t)), str(Fingerprint.of(new)), brute_likeness(t, new), brute_likeness(t, nxt)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_awkward_rows(spark):
    check(AWKWARD, syncmers.fingerprints(documents(spark, AWKWARD)).collect())
    one = [(5, "only one")]
    check(one, syncmers.fingerprints(documents(spark, one)).collect())
    assert syncmers.fingerprints(documents(spark, AWKWARD).limit(0)).count() == 0


def test_ids_that_hold_most_rows_are_split(spark):
    """Null and repeated ids fill several ranges; every row still meets the one that follows it."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(i, 5)) for i in range(900)] + [(7, text(1, 5))] * 5 + [(2**60 + i // 3, text(i, 4)) for i in range(60)]
    df = documents(spark, rows)
    check(rows, syncmers.fingerprints(df).collect())
    sizes = [r["count"] for r in syncmers._neighbours(df.select("doc_id", "text")).filter("guest = 0").groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.34 * len(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = syncmers.query(spark, f"{DATA}/sf0.001").collect()
    check(rows, got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_columns_that_sql_can_express(spark):
    sql = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM '{DATA}/sf0.01/documents.parquet'),
    n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d)
    SELECT doc_id, CAST(length(text) AS BIGINT), sha256(substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2)) FROM n"""
    got = syncmers.query(spark, f"{DATA}/sf0.01").select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def test_long_texts_that_share_a_passage():
    shared = text(900, 60)
    for seed in range(12):
        a, b = (" ".join(str(hash((seed, x, i))) for i in range(1500)) + " " + shared for x in (10, 60))
        exact = brute_likeness(a, b)
        assert exact > 0 and abs(likeness(Fingerprint.of(a), Fingerprint.of(b)) - exact) < 1e-12

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from samples import AWKWARD, DATA, documents, text

from lakequill.llm import mixing


def filled(sizes, weights, share=1.5, most=2):
    """Targets by small steps of water."""
    out, names = dict.fromkeys(sizes, 0.0), list(sizes)
    left = share * sum(sizes.values())
    while left > 1e-9:
        open_ = [s for s in names if out[s] < most * sizes[s] - 1e-12]
        if not open_:
            break
        w = sum(weights[s] for s in open_)
        step = min([left / w, *((most * sizes[s] - out[s]) / weights[s] for s in open_)])
        for s in open_:
            out[s] += step * weights[s]
        left -= step * w
    return out


def test_targets():
    r = random.Random(1)
    for _ in range(100):
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, r.randrange(5000)]) for i in range(r.randrange(1, 9))}
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sizes)}
        assert mixing.targets(sizes, weights) == pytest.approx(filled(sizes, weights), rel=1e-6, abs=1e-6)


def cheapest(patterns, quotas, most):
    """Greatest flow and its least cost by a linear programme over whole words, tried by brute force on tiny cases."""
    best = (0, 0)
    names = list(patterns)

    def go(i, left, flow, cost):
        nonlocal best
        if i == len(names):
            best = max(best, (flow, -cost))
            return
        p = names[i]
        for total in range(most * patterns[p] + 1):
            copies, rest = divmod(total, patterns[p]) if patterns[p] else (0, 0)
            extra = sum(c * patterns[p] for c in range(copies)) + copies * rest

            def spread(j, still, now):
                if j == len(p) - 1:
                    if still <= now[p[j]]:
                        go(i + 1, {**now, p[j]: now[p[j]] - still}, flow + total, cost + extra)
                    return
                for x in range(min(still, now[p[j]]) + 1):
                    spread(j + 1, still - x, {**now, p[j]: now[p[j]] - x})

            spread(0, total, left)

    go(0, dict(quotas), 0, 0)
    return best


def test_flow_is_greatest_and_cheapest():
    r = random.Random(2)
    for _ in range(40):
        sources = ["a", "b", "c"][: r.randrange(1, 4)]
        patterns = {}
        for _ in range(r.randrange(1, 4)):
            patterns[tuple(sorted(r.sample(sources, r.randrange(1, len(sources) + 1))))] = r.randrange(0, 4)
        quotas = {s: r.randrange(0, 6) for s in sources}
        flow = mixing.min_cost_flow(patterns, {s: float(q) for s, q in quotas.items()})
        total, cost = sum(flow.values()), 0.0
        for p, f in flow.items():
            copies = int(f // patterns[p] + 1e-9) if patterns[p] else 0
            cost += sum(c * patterns[p] for c in range(copies)) + copies * (f - copies * patterns[p])
        assert (total, -cost) == pytest.approx(cheapest(patterns, quotas, 2))


def check(rows):
    """Contract of the query's rows, given (doc_id, text, source)."""
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    for s in names:
        mine = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and mine[0]["target"] == pytest.approx(want[s])
        taken, least = sum(r["taken"] for r in mine), min([r["size"] for r in mine if r["size"]] or [0])
        assert abs(taken - want[s]) <= max(least, 0.02 * want[s], 1)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        if want[s] >= sizes[s]:
            assert sum(r["taken"] == 0 and r["size"] > 0 for r in mine) == 0


def test_documents(spark):
    import re

    r = random.Random(4)
    rows = [(i, text(i, r.choice([1, 5, 40, 200])), r.choice(["a", "a", "a", "b", "c", "É", "z", None])) for i in range(400)] + [(d + 1000, t, "b") for d, t in AWKWARD if d not in (None, 6, 9)]
    df = documents(spark, rows)
    got = mixing.mix(mixing.words(df)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(mixing.words(df.repartition(5))).collect()))
    texts = {d: (t, s) for d, t, s in rows}
    full = [x.asDict() | {"source": texts[x.doc_id][1]} for x in got]
    assert len(full) == len(rows) and all(x["size"] == len(re.findall("[^\x20\x09-\x0d]+", texts[x["doc_id"]][0] or "")) for x in full)
    check(full)
    assert {(r.size, r.taken) for r in mixing.mix(mixing.words(documents(spark, AWKWARD[9:10]))).collect()} == {(30000, 30000)}
    assert mixing.mix(mixing.words(df.limit(0))).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mix(mixing.words(documents(spark, [(1, None, "a"), (2, "", None)]))).filter("taken <> 0").count() == 0


def counted(rows):
    from collections import Counter

    return Counter(map(repr, rows))


def test_ids_that_are_null_or_repeat(spark):
    """Rows of one id count one by one, in whatever order and however many they are, and equal rows too."""
    r = random.Random(6)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, text(i % 200, r.choice([1, 7, 30])), r.choice("aab")) for i in range(1500)] + [(8, text(8, 9), "a")] * 700
    df = documents(spark, rows)
    get = lambda d: mixing.mix(mixing.words(d), content="content").selectExpr("doc_id", "sources[0] AS source", "size", "source_size", "target", "taken").collect()
    got = get(df)
    assert len(got) == len(rows)
    check([x.asDict() for x in got])
    assert counted(got) == counted(get(df.repartition(7)))


def test_many_equal_rows_do_not_gather(spark, monkeypatch):
    """The rows that one task fills from stay few, though all rows are equal."""
    seen = []
    monkeypatch.setattr(mixing, "ZONE_MOST", 500)
    threshold = mixing._threshold
    monkeypatch.setattr(mixing, "_threshold", lambda *a: seen.append(threshold(*a)) or seen[-1])
    df = spark.range(20000).selectExpr("cast(null AS bigint) AS doc_id", "array(if(id % 4 = 0, 'a', 'b')) AS sources", "10L AS size")
    got = mixing.mix(df).collect()
    by = {s: sum(r.taken for r in got if r.sources[0] == s) for s in "ab"}
    assert all(abs(by[r.sources[0]] - r.target) <= 10 for r in got) and all(zone.count() <= 1000 for _, zone in seen)


def test_mixed_gives_the_rows_that_the_mix_takes(spark):
    r = random.Random(7)
    rows = [(r.choice([None, 3, i]), text(i % 300, r.choice([1, 9, 50])), r.choice(["a", "a", "b", None])) for i in range(900)] + [(8, text(8, 9), "a")] * 300 + [(d, t, "b") for d, t in AWKWARD]
    df = documents(spark, rows).withColumn("lang", F.when(F.col("n_chars") % 3 == 0, "de").when(F.col("n_chars") % 3 == 1, "en"))
    got = mixing.mixed(df)
    assert got.columns == [*df.columns, "copies"]
    sources = F.array(*(F.coalesce(F.concat(F.lit(f"{c}="), F.col(c)), F.lit(c)) for c in ("source", "lang")))
    plain = df.select("doc_id", sources.alias("sources"), mixing._size(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))
    plan = [x for x in mixing.mix(plain, content="content", share=0.75).collect() if x.copies and x["size"]]
    mine = got.select("doc_id", sources.alias("sources"), mixing._size(F.col("text")).alias("size"), "copies").collect()
    assert counted(mine) == counted([Row(doc_id=x.doc_id, sources=x.sources, size=x["size"], copies=x.copies) for x in plan])
    # each word counts for one of its sources; together they get what the flow to their quotas gives
    patterns, sizes = {}, {}
    for x in plain.collect():
        p = tuple(sorted("0" + c for c in set(x.sources)))
        patterns[p] = patterns.get(p, 0) + x["size"]
    patterns = {p: patterns[p] for p in sorted(patterns)}
    for p, n in patterns.items():
        for c in p:
            sizes[c] = sizes.get(c, 0) + n
    asked = mixing.targets(sizes, {c: (3, 1, 2)[i % 3] for i, c in enumerate(sorted(sizes))}, 0.75)
    flow = mixing.min_cost_flow(patterns, asked)
    taken = {}
    for x in plan:
        p = tuple(sorted("0" + c for c in set(x.sources)))
        taken[p] = taken.get(p, 0) + x["size"] * x.copies
    assert all(abs(taken.get(p, 0) - f) <= max(60, 0.02 * f) for p, f in flow.items() if p != ("0lang=de", "0source=b"))  # that one holds a huge row
    assert any(0 < f < patterns[p] for p, f in flow.items())


def test_mixed_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c", 7), (1, "a b c", 8), (2, None, 9)]
    for name in ("Copies", "given", "size", "x.y"):
        df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnRenamed("n", name).selectExpr("*", "'s' AS source", "'en' AS lang")
        got = mixing.mixed(df)
        assert got.columns == [*df.columns, "copies_" if name.lower() == "copies" else "copies"]
        assert {tuple(r)[:3] for r in got.collect()} <= {x for x in rows if x[1]} and got.count()
        assert mixing.mixed(df.limit(0)).count() == 0


def test_one_source_of_many_patterns_stays_quick():
    patterns = {("all", f"s{i}"): 5 for i in range(20000)}
    flow = mixing.min_cost_flow(patterns, {"all": 100.0} | {f"s{i}": 1.0 for i in range(20000)})
    assert abs(sum(flow.values()) - 20100) < 1e-6


def test_refined_thresholds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    monkeypatch.setattr(mixing, "ZONE_MOST", 70)
    rows = [(i, text(i, 1 + i % 50), "abc"[i % 3]) for i in range(900)]
    check([x.asDict() | {"source": "abc"[x.doc_id % 3]} for x in mixing.mix(mixing.words(documents(spark, rows))).collect()])


def test_rows_beyond_a_huge_one_fill_the_target(spark):
    at = spark.range(10_000, 11_000).selectExpr("id", f"pmod(xxhash64({mixing.SEED}, id, 0, 100000L), {1 << 40}) / {1 << 40} AS u")
    huge = at.filter("u between 0.4 and 0.45").first().id  # it straddles the threshold
    df = spark.createDataFrame([(i, ["a"], 50) for i in range(3000)] + [(huge, ["a"], 100_000)], "doc_id long, sources array<string>, size long")
    got = mixing.mix(df).collect()
    assert abs(sum(r.taken for r in got) - got[0].target) <= 25


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, [["a"], ["b"], ["a", "b"], [None, "a", "a"], [], None][i % 6], 10 if i % 7 else None) for i in range(600)], "doc_id long, sources array<string>, size long")
    got = mixing.mix(df).collect()
    assert len(got) == 600 and all(r.taken <= 2 * r.size for r in got) and all(r.taken == 0 for r in got if not r.sources)
    patterns = {}
    for r in got:
        p = tuple(sorted({"1" if x is None else "0" + x for x in r.sources or []}))
        patterns[p] = patterns.get(p, 0) + r.size
    sizes = {x: sum(n for p, n in patterns.items() if x in p) for x in ("0a", "0b", "1")}
    flow = mixing.min_cost_flow(patterns, mixing.targets(sizes, dict(zip(sizes, (3, 1, 2), strict=True))))
    assert abs(sum(r.taken for r in got) - sum(flow.values())) <= 10 * len(patterns)


def test_whole_table(spark):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    got = mixing.query(spark, f"{DATA}/sf0.01")
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    check([r.asDict() | {"source": source[r.doc_id]} for r in got.collect()])

import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import AWKWARD, DATA, documents, text

from lakequill.llm import decontaminate as D


def distance(pattern, t):
    """Least edit distance of the pattern to any part of t, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in t:
        before, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (p != c))
        best = min(best, row[-1])
    return best


def least(item, t):
    """The least distance of an item to a text, both folded, with the spaces around them."""
    pattern, t = f" {D.folded(item.encode())} ", f" {D.folded(t.encode())} "
    if len(t) > 2000:  # the plain table takes too long; the automaton is tested against it above
        return D.Myers(pattern).best(t, len(pattern))[0]
    return distance(pattern, t)


def budget(item):
    return len(D.folded(item.encode())) // D.PER_ERROR


@settings(deadline=None, max_examples=300)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90), st.integers(0, 30))
def test_myers_is_the_edit_distance(pattern, t, most):
    d = distance(pattern, t)
    got = D.Myers(pattern).best(t, most)
    assert (got is None) == (d > most) and (got is None or got[0] == d)


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10**6))
def test_search_finds_what_the_budget_allows(seed):
    r = random.Random(seed)
    items = [(i, "".join(r.choice("abcde fgh") for _ in range(r.randrange(1, 90)))) for i in range(4)]
    t = "".join(r.choice("abcde fgh") for _ in range(80))
    for _, item in items:
        e = list(item)
        for _ in range(r.randrange(0, 12)):
            at = r.randrange(len(e) + 1)
            e[at : at + r.randrange(2)] = [r.choice(string.ascii_lowercase)] * r.randrange(2)
        t += "".join(e) + "".join(r.choice("abcde fgh") for _ in range(20))
    folded = D.folded(t.encode())
    want = {i: d for i, item in items if D.folded(item.encode()) and (d := least(item, t)) <= budget(item)}
    matcher = D.Matcher([(i, s.encode()) for i, s in items])
    got = matcher.search(t.encode())
    assert {i: min(x[1] for x in got if x[0] == i) for i, *_ in got} == want and matcher.occurs(t.encode()) == bool(want)
    for i, d, start, end in got:
        assert d <= budget(dict(items)[i]) and distance(D.folded(dict(items)[i].encode()), folded[start:end]) <= d


def test_every_place_is_found():
    items = [(i, text(900 + i, n)) for i, n in enumerate((1, 2, 6, 30))]
    matcher, r = D.Matcher([(i, s.encode()) for i, s in items]), random.Random(3)
    for _ in range(40):
        t, want = text(r.random(), 5), []
        for _ in range(r.randrange(6)):
            i, item = r.choice(items)
            t += r.choice([" ", ", ", "!\n"])
            want.append((i, len(t), len(t) + len(item)))
            t += (item.upper() if r.random() < 0.5 else item) + " é " + text(r.random(), r.randrange(4))
        got = matcher.search(t.encode())
        assert sorted((i, a, b) for i, d, a, b in D._placed(got, t.encode()) if d == 0) == sorted(want)
    one = D.Matcher([(0, b"a")])
    assert len(one.search(b"a " * 5000)) == 5000 and one.search(b"aa ba ab") == []


def test_short_items_match_whole_words():
    items = [(1, "a"), (2, "ai"), (3, "hello")]
    find = lambda t: sorted(i for i, *_ in D.Matcher([(i, s.encode()) for i, s in items]).search(t.encode()))
    assert find("she said hello") == [3] and find("an AI, a day") == [1, 2] and find("othello again") == [] and find("ai") == [2]


def test_code_points_of_folded_bytes():
    for t in ("", "  a, b!! ", "É\n--ß ẞİ x", "plain words", "... ", "😀 a😀b  ", "a\x00b"):
        f, points = D.folded(t.encode()), D.code_points(t.encode())
        assert len(f) == len(points)
        for c, p in zip(f, points, strict=True):
            assert c == " " or c.encode("latin-1") in t[p].casefold().encode()


def planted(seed=5):
    items = [(i, text(900 + i, 30)) for i in range(12)] + [(50, text(900, 30)), (60, ""), (70, None), (80, "!!!"), (None, text(1))]
    r = random.Random(seed)
    docs = [(i, text(i, 40)) for i in range(30)]
    docs += [(100, f"{text(1)}\n {items[3][1].upper()} {text(2)}"), (101, items[4][1].replace(" ", ",  \n")), (102, f"é😀 {items[5][1]}"), (103, items[0][1] + items[1][1])]
    e = list(items[6][1])
    for _ in range(10):
        e[r.randrange(len(e))] = "q"
    return items, docs + [(104, f"before {''.join(e)} after")] + AWKWARD


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_documents(spark, block_bytes):
    items, docs = planted()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS start")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.matches(documents(spark, docs), bench, block_bytes=block_bytes).collect()), key=repr)
    want = []
    for d, t in docs:
        for i, item in items:
            if i is not None and D.folded((item or "").encode()) and t and (x := least(item, t)) <= budget(item):
                want.append((d, i, x))
    assert got == sorted(want, key=repr) and {(100, 3, 0), (101, 4, 0), (102, 5, 0), (103, 0, 1), (103, 50, 1)} <= set(got) and any(d == 104 for d, _, _ in got)
    place = D.matches(documents(spark, [docs[32]]), bench).collect()[0]
    assert docs[32][1][place.start : place.end] == items[5][1]
    hit = {d for d, _, _ in want}
    kept = D.kept(documents(spark, docs), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if d not in hit), key=repr) and kept.columns == documents(spark, docs).columns


def test_upper_cased_accents(spark):
    item = "été où l'élève révéla à sa mère étonnée l'écho répété des forêts, des rêves et de la fenêtre; straße, größe, ærø, ёлка и ель"
    docs = [(1, f"Ü {item.upper()} fin"), (2, f"İẞ\n{item.upper()}"), (3, "ÉTÉ SEUL")]
    bench = spark.createDataFrame([(7, item), (8, item.upper())], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in D.matches(documents(spark, docs), bench).collect()}
    n = len(item.upper())
    assert got == {(1, i): (0, 2, 2 + n) for i in (7, 8)} | {(2, i): (0, 3, 3 + n) for i in (7, 8)}
    assert [r.doc_id for r in D.kept(documents(spark, docs), bench).collect()] == [3]


def test_empty_tables(spark):
    items, docs = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.matches(documents(spark, docs).limit(0), bench).count() == 0 and D.matches(documents(spark, docs), bench.limit(0)).count() == 0
    assert D.kept(documents(spark, docs), bench.limit(0)).count() == len(docs)


def test_whole_table(spark):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in D.query(spark, f"{DATA}/sf0.001").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in bench.items() if D.folded(x.encode()) in D.folded(t.encode())}
    assert exact <= got and exact

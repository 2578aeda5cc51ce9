import bisect
import random
import re
import textwrap

from samples import DATA, text

from lakequill.llm import quotes

COLUMNS = "conv_id long, turn long, role string, text string"


def norm(s):
    return " ".join(re.findall(r"[^\W_]+", s.lower()))


def brute(rows):
    """(conv, turn) -> (parent, root, depth, passages, linked) for unique turns, by scanning all earlier messages."""
    def split(t):
        out = []
        for line in re.split("\r\n|\r|\n", t or ""):
            m = re.match(r"[ \t]*>[> \t]*", line)
            out.append(((m[0].count(">") if m else 0), line[len(m[0]) :] if m else line))
        return out

    def runs(lines, parts=False):
        out = []
        for level, line in lines:
            blank = line.strip(" ") == ""
            if out and out[-1][0] == level and (not parts or out[-1][2] == blank):
                out[-1][1].append(line)
            else:
                out.append((level, [line], blank))
        return out

    def paragraphs(lines):
        return [norm(" ".join(ls)) for _, ls, blank in runs(lines, True) if not blank]

    units = {}
    for c, t, _, x in rows:
        lines = split(x)
        own = {p for lv, ls, _ in runs(lines) if lv == 0 for p in paragraphs([(0, x) for x in ls])} | {norm(line) for lv, line in lines if lv == 0} | {norm(" ".join(line for lv, line in lines if lv == 0))}
        for u in own - {""}:
            units.setdefault((c, u), []).append(t)
    units = {k: sorted(v) for k, v in units.items()}
    parent, counts = {}, {}
    for c, t, _, x in rows:
        votes, passages = {}, []
        for lv, ls, _ in runs(split(x)):
            if lv == 0:
                continue
            several = paragraphs([(lv, x) for x in ls])
            mine = [u for u in [norm(" ".join(ls)), *(several if len(several) > 1 else []), *map(norm, ls)] if u]
            linked = False
            for u in mine:
                said = units.get((c, u), [])
                if i := bisect.bisect_left(said, t):
                    linked = True
                    votes[-lv, said[i - 1]] = votes.get((-lv, said[i - 1]), 0) + len(u)
            if mine:
                passages.append(linked)
        counts[c, t] = (len(passages), sum(passages))
        if votes:
            parent[c, t] = max((lv, n, o) for (lv, o), n in votes.items())[2]
    out = {}
    for c, t, _, _ in rows:
        at, depth = t, 0
        while (c, at) in parent:
            at, depth = parent[c, at], depth + 1
        out[c, t] = (parent.get((c, t)), at, depth, *counts[c, t])
    return out


ROWS = [
    (1, 0, "user", "How do I sort a list?\nIt has numbers.\n\nThanks, Ann"),
    (1, 1, "helper", "> How do I sort a list?\n\nUse sorted."),
    (1, 2, "user", "On Monday, Helper wrote:\n> > How do I sort a LIST?\n> Use   sorted!\n\nThat works."),
    (1, 3, "other", ">it has numbers.\n> Thanks, Ann\nWhat kind of numbers?"),
    (1, 4, "user", ">> Use sorted.\n>> not there\n> That works.\nGood."),
    (1, 5, "x", "> never said\nHm."),
    (1, 6, "x", None),
    (1, 7, "x", ""),
    (1, 8, "x", ">"),
    (2, 0, "user", "How do I sort a list?"),
    (2, 1, "user", "> Use sorted.\nOther conversation."),
    (2, 2, "user", "ok"), (2, 3, "user", "ok"), (2, 4, "user", "> ok\nwhich?"), (2, 5, "user", "x\r\n> which?\r\ny"),
    (3, 9000, "user", "far"), (3, 1, "user", "early line"), (3, 9001, "user", "> early line\nlate"), (3, 20000, "user", "> late\n> far\n" + ">" * 9000),
]


def test_threads(spark):
    df = spark.createDataFrame(ROWS, COLUMNS).selectExpr("*", "1 AS row", "2 AS parent", "3 AS hash", "4 AS level", "5 AS root")
    got = quotes.linked_conversations(df).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in got} == brute(ROWS)
    texts = {(r.conv_id, r.turn): r.text for r in got}
    assert texts[1, 2] == "That works." and texts[1, 1] == "Use sorted." and texts[1, 6] == "" and texts[2, 5] == "x\ny" and texts[1, 0] == ROWS[0][3]
    for c in (1, 2, 3):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        seen = set()
        for r in mine:
            assert r.parent_turn is None or r.parent_turn in seen
            seen.add(r.turn)


def test_awkward_rows(spark):
    rows = [(None, 1, "u", "> x"), (1, None, "u", "x"), (1, 2, "u", "x"), (1, 2, "u", "x"), (1, 3, None, "> x"), (5, -3, "u", "a b"), (5, -1, "u", "> a b"), (7, 1, "u", "word " * 20000), (7, 2, "u", "> " + "word " * 20000)]
    got = quotes.linked_conversations(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(rows) and {(r.conv_id, r.turn): r.parent_turn for r in got if r.parent_turn is not None} == {(1, 3): 2, (5, -1): -3, (7, 2): 1}
    assert quotes.linked_conversations(spark.createDataFrame([], COLUMNS)).count() == 0


def test_long_chain_and_hot_line(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 16)
    rows = [(1, 0, "u", "line 0")] + [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 70)]
    rows += [(2, i, "u", "thanks" if i % 3 else "> thanks\nyes") for i in range(200)]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in quotes.linked_conversations(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == brute(rows) and got[1, 69][2] == 69


def threads(n, seed, conv):
    """(rows, true parents): messages that quote what they answer, level by level, cut, in other cases and with other line ends."""
    r, rows, parents, shown = random.Random(seed), [], {}, {}
    for t in range(n):
        own = "\n\n".join(text(f"{seed}/{t}/{k}", r.randrange(4, 30)) for k in range(r.randrange(1, 4)))
        if t and r.random() < 0.9:
            up = r.randrange(max(0, t - 40), t)
            kept = shown[up] if r.random() < 0.5 else shown[up].split("\n\n")[-1]
            width = r.choice([30, 60, 1000])
            lines = [w for line in kept.split("\n") for w in ([line] if line.startswith(">") or not line else textwrap.wrap(line.upper() if r.random() < 0.3 else line, width))]
            own, parents[conv, t] = "\n".join(["On Monday, X wrote:", *(">" + ("" if x.startswith(">") else " ") + x for x in lines)]) + "\n\n" + own, up
        shown[t] = own if len(own) < 4000 else own[own.rindex("\n\n") + 2 :]
        rows.append((conv, t, "u", own.replace("\n", r.choice(["\n", "\r\n"]))))
    return rows, parents


def test_generated_threads(spark, monkeypatch):
    """Thousands of messages with nested quotations against brute force and against whom they answer."""
    monkeypatch.setattr(quotes, "BLOCK", 256)
    made = [threads(1500, 1, 1), threads(900, 2, 2), threads(60, 3, 3)]
    rows, parents = sum((x for x, _ in made), []), {k: v for _, p in made for k, v in p.items()}
    got = quotes.linked_conversations(spark.createDataFrame(rows, COLUMNS)).collect()
    found = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in got}
    assert found == brute(rows)
    right = sum(found[k][0] == v for k, v in parents.items())
    assert right >= 0.99 * len(parents) and sum(f[3] for f in found.values()) > len(parents), (right, len(parents))
    for c in (1, 2, 3):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: (r.root_turn, r.depth, r.turn))
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
    assert all(">" not in r.text and "wrote" not in r.text for r in got)


def test_paragraphs_of_a_rewrapped_quotation_link(spark):
    rows = [(1, 0, "a", "first words here, they go on\nover lines\n\nsecond part, also\nlong\n\nthird"), (1, 1, "b", "> first words here,\n> they go on over lines\n>\n> second part, also long\nyes")]
    got = {r.turn: r for r in quotes.linked_conversations(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[1].parent_turn == 0 and (got[1].n_quoted, got[1].n_linked) == (1, 1) and got[1].text == "yes"


def test_one_tree_and_rows_without_keys_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 50)
    rows = [(1, 0, "u", "root words")] + [(1, i, "u", f"> root words\nanswer {i}") for i in range(1, 700)] + [(None, None if i % 2 else i, "u", f"x {i % 90}") for i in range(600)] + [(2, 5, "u", "same")] * 200
    got = quotes.linked_conversations(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(rows)
    for c, n in ((1, 700), (None, 600), (2, 200)):
        assert sorted(r.position for r in got if r.conv_id == c) == list(range(1, n + 1))
    assert all(r.position == r.turn + 1 for r in got if r.conv_id == 1) and max(r.position for r in got if r.conv_id is None and r.turn is None) == 300


def test_no_python_in_the_plan(spark):
    plan = quotes.linked_conversations(spark.createDataFrame(ROWS, COLUMNS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = quotes.query(spark, f"{DATA}/sf0.001").collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in got} == brute(rows)

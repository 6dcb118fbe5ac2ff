"""Queries over small tables against plain Python over all rows: none may leave rows out."""

import math
from collections import Counter, defaultdict
from itertools import accumulate

from pyspark.sql import functions as F

from lodestone.operators import windows
from lodestone.plans.registry import QUERIES


def run(spark, tmp_path, name, **tables):
    """The rows of a query over the given tables (rows, schema)."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    return [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]


LINE = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string"
#: Order keys that no modulo has in common, several lines an order.
LINES = [(o, n, (o * 7 + n * 3) % 9 + 1, (o * 5 + n * n * 11) % 40 + 1, "RNA"[(o + n) % 3]) for o in range(1, 60) for n in range(1, 5)]


def test_code_queries_read_all_references(spark, tmp_path):
    parts = [(p, f"Brand#{p % 25 + 1}", p % 13) for p in range(1, 45)]
    got = run(spark, tmp_path, "symbol_guard", lineitem=(LINES, LINE), part=(parts, "p_partkey long, p_brand string, p_size int"))
    outside = Counter(p for _, _, s, p, _ in LINES if f"Brand#{s % 25 + 1}" != f"Brand#{p % 25 + 1}")
    want = [(p, outside[p], "allow" if not outside[p] else "block" if z % 10 / 10 >= 0.75 else "warn") for p, _, z in parts]
    assert sorted(got) == want and {r[2] for r in got} == {"allow", "block", "warn"}

    got = run(spark, tmp_path, "coverage_overlay", lineitem=(LINES, LINE), supplier=([(s,) for s in range(1, 11)], "s_suppkey long"))
    lines = {(s, p, f == "N") for _, _, s, p, f in LINES if f != "A"}
    for s, covered, total, _ in got:
        hit = [x for k, p, x in lines if k == s and 3 * s <= p <= 3 * s + 40]
        assert (covered, total) == (sum(hit), len(hit))
    assert len(got) == 10 and sum(r[2] for r in got) > 50

    got = run(spark, tmp_path, "related_changes", lineitem=(LINES, LINE))
    best = defaultdict(dict)
    for _, _, s, p, f in LINES:
        if f != "A":
            best[s][p] = min(best[s].get(p, (0, "")), (-1.0, "caller") if f == "R" else (-0.95, "test"))
    want = [(s, p, r, -c) for s, t in best.items() for c, p, r in sorted((c, p, r) for p, (c, r) in t.items())[:5]]
    assert sorted(got) == sorted(want)


def test_graph_queries_read_all_edges(spark, tmp_path):
    got = {r[0]: r for r in run(spark, tmp_path, "impact_risk", lineitem=(LINES, LINE))}
    uses, users = defaultdict(set), defaultdict(set)
    for _, _, s, p, _ in LINES:
        uses[s].add(p), users[p].add(s)
    two = {s: len(set().union(*(users[p] for p in uses[s]))) - 1 for s in uses}
    assert {s: r[1:3] for s, r in got.items()} == {s: (len(uses[s]), two[s]) for s in uses}
    assert all(r[3] == ("high" if s % 10 >= 8 else "critical") and r[4] == (s % 10 >= 9 and r[3] == "high") for s, r in got.items())

    # Two rings and a way out of each, over order keys of which none is a multiple of 97.
    ends = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 9), (8, 4), (5, 5)]
    lines = [(o, 1, dst, src, "N") for o, (src, dst) in enumerate(ends, 1)]
    assert dict(run(spark, tmp_path, "bfs_depth", lineitem=(lines, LINE))) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    assert dict(run(spark, tmp_path, "bfs_reverse_capped", lineitem=(lines, LINE))) == {3: 0, 2: 1, 4: 1, 1: 2, 8: 2, 0: 3}
    assert sorted(run(spark, tmp_path, "cycle_detect", lineitem=(lines, LINE))) == [("0>1>2", 3), ("3>4", 2)]
    assert sorted(run(spark, tmp_path, "cycle_severity", lineitem=(lines, LINE))) == [("high", 1), ("medium", 1)]


TURN = "conv_id long, turn int, role string, text string"


def test_similar_turns_of_late_conversations(spark, tmp_path):
    rows = [(c, t, "user", x) for c in (1, 39, 40, 977) for t, x in enumerate(["red fox", "red hen", "blue"])]
    got = run(spark, tmp_path, "tfidf_similarity", conversations=(rows, TURN))
    red, other = 1 + math.log(4 / 3), 1 + math.log(2)
    assert sorted(got) == [(c, 0, 1, round(red**2 / (red**2 + other**2), 6)) for c in (1, 39, 40, 977)]


def test_truncation_over_ranges(spark, tmp_path):
    lines = [(o, n, 1, 1, "N") for o in range(600, 640) for n in range(o % 7 + 1)]
    got = run(spark, tmp_path, "greedy_truncation", lineitem=(lines, LINE))
    want, left = [], 50
    for o in range(600, 640):
        if left:
            want.append((o, min(o % 7 + 1, left)))
            left -= want[-1][1]
    assert sorted(got) == want

    sizes = [(i * 7919 % 2003, i % 5) for i in range(2003)]  # every fifth is empty, and stays wherever it is
    cut = windows.greedy_cut(spark.createDataFrame(sizes, "id int, c int").repartition(9), F.col("c"), 777, F.desc("id"))
    order = sorted(sizes, reverse=True)
    before = [0, *accumulate(c for _, c in order)]
    want = [(i, c, max(0, min(c, 777 - b))) for (i, c), b in zip(order, before, strict=False) if c == 0 or b < 777]
    assert sorted(map(tuple, cut.collect()), reverse=True) == want
    assert cut.columns == ["id", "c", "kept"]


def test_scope_over_all_events(spark, tmp_path):
    rows = [(1, 1, "view", 60.0), (2, 1, "click", 70.0), (40, 2, "view", 60.0), (41, 2, "click", 10.0), (80, 3, "view", 9.0), (81, 3, "view", 90.0)]
    got = run(spark, tmp_path, "scope_inference", events=(rows, "event_id long, user_id long, event_type string, value double"))
    assert dict(got) == {1: "value", 2: "universal", 3: "view"}


def test_conversations_by_their_own_texts(spark, tmp_path):
    say = [("Hi there, this is a long one", "Created the file"), ("never use tabs", "done"), ("I prefer dark mode", "done"), ("what is this?", "done"), ("please never write long functions", "done")]
    rows = [(7, 2 * i + k, "user assistant".split()[k], x) for i, both in enumerate(say) for k, x in enumerate(both)]
    got = run(spark, tmp_path, "turn_classifier", conversations=(rows, TURN))
    assert sorted(got) == [(7, 0, None, None), (7, 2, "rule", 1.0), (7, 4, "preference", 0.85), (7, 6, None, None), (7, 8, "behavior", 0.9)]
    got = run(spark, tmp_path, "last_texts", conversations=(rows, TURN))
    assert sorted(got) == [(7, 2 * i, "|".join(u for u, _ in say[max(0, i - 2) : i + 1])) for i in range(5)]
    same = [(c, 0, "user", "Fix the same failing test of the parser again, now " + x) for c, x in enumerate(["a", "b"])] + [(9, 0, "user", "Fixed")]
    assert run(spark, tmp_path, "repeated_heads", conversations=(same, TURN)) == [("fix the same failing test of the parser again, now", 2)]

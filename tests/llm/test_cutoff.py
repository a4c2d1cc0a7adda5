import random

from staylens.llm.cutoff import score_cutoffs


def brute(rows, targets):
    out = set()
    for s, pct in {(s, p) for s, p in targets if s is not None}:
        scores = [x for i, t, x in rows if t == s and x is not None]
        if not scores:
            continue
        ok = [c for c in set(scores) if 100 * sum(x >= c for x in scores) >= pct * len(scores)]
        if ok:
            out.add((s, pct, max(ok), sum(x >= max(ok) for x in scores), len(scores)))
    return out


def run(spark, rows, targets, n=5):
    r = spark.createDataFrame(rows, "id string, room string, q int").selectExpr("id", "room", "q", "'x' as source", "1 as score")
    t = spark.createDataFrame(targets, "room string, pct int")
    return {tuple(x) for x in score_cutoffs(r, t, "room", "q", "id", "pct", n).select("source", "keep", "cutoff", "n_kept", "n_records").collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"{i}", rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *range(11), 7, 7, 7])) for i in range(1500)]
    targets = [("hot", 30), ("hot", 1), ("a", 100), ("b", 50), ("none", 40), (None, 10), ("a", 0), ("a", 100)]
    assert run(spark, rows, targets) == brute(rows, targets) | {x for x in run(spark, rows, [("a", 0)])}


def test_edges(spark):
    assert run(spark, [], [("a", 5)]) == set()
    assert run(spark, [("1", "a", 3)], []) == set()
    assert run(spark, [("1", "a", 3), ("2", "a", 3)], [("a", 10)]) == {("a", 10, 3, 2, 2)}
    assert run(spark, [("1", "a", 3), ("2", "a", 5)], [("a", 101)]) == set()
    assert run(spark, [("1", "a", 3), ("2", "a", 5)], [("a", 0)]) == {("a", 0, 5, 1, 2)}

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidewheel.llm import mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = mixing.SHARE * sum(sizes.values()), set()
    while True:
        room = total - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        goal = {s: 2 * sizes[s] if s in capped else room * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        capped |= over


def corpus(spark, n=400):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 120)), [None, "s1", "s10", "s2", "é", "z"][min(i % 11, 5)]) for i in range(n)]
    return spark.createDataFrame([(*r, 1.0, "x", "y") for r in rows], "doc_id long, text string, source string, size double, taken string, bucket string")


def test_targets_and_takes(spark):
    docs = corpus(spark)
    rows = mixing.taken(docs).collect()
    sizes, took = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        took[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == 1 + r["doc_id"] * 7 % 120
    goal = slow_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, want in goal.items():
        assert took[s] == pytest.approx(want, rel=0.02, abs=8)
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 1000}, {"a": 5}, {"a": 1, "b": 1, "c": 1, None: 1}, {"a": 0, "b": 7}, {"b": 0}])
def test_levels(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = slow_targets(sizes)
    assert all(found[s] == pytest.approx(want[s]) for s in sizes)


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("a", 500.0, 1), ("b", 300.0, 1), ("c", 200.0, 1)], "source string, target double, block_size long")
    rows = mixing.schedule(goals, 2000).collect()
    assert len(rows) == 1000 == len({r["slot"] for r in rows})
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        mine = sorted((r["slot"], r["block"]) for r in rows if r["source"] == s)
        assert [b for _, b in mine] == list(range(len(mine)))
        for n in (50, 200, 700):  # any stretch holds nearly its share
            assert abs(sum(slot <= n for slot, _ in mine) - share * n) <= 6


def test_odd_rows(docs_of):
    docs = docs_of(ODD)
    rows = mixing.taken(docs, slots=1 << 12).collect()
    assert len(rows) == len(ODD) and sum(r["size"] == 0 for r in rows) == 4
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    none = docs.where(F.lit(False))
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0
    blank = docs.where("doc_id in (2, 3)")
    assert [r["taken"] for r in mixing.taken(blank).collect()] == [0, 0] and mixing.mixed(blank).count() == 0


def test_mixed_rows_follow_takes(spark):
    docs = corpus(spark)
    want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.taken(docs).collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_alike_rows_share_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", k) for k in range(5)], "doc_id long, text string, source string, k int")
    total = sum(int(r["taken"] / r["size"] + 0.5) for r in mixing.taken(docs).collect())
    assert mixing.mixed(docs).count() == total


def test_runs_without_python(spark, sf_dir):
    docs = corpus(spark)
    plan = mixing.taken(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("slots", [8, 64, 1 << 12])
def test_sources_smaller_than_a_block_give_their_targets(spark, slots):
    sizes = [("big", 400, 50), ("mid", 30, 40), ("tiny", 3, 5), ("tiny2", 1, 9), (None, 2, 7), ("w", 1, 1)]
    rows = [(s, " ".join(["w"] * n)) for s, docs, n in sizes for _ in range(docs)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    took, goal = defaultdict(int), {}
    for r in mixing.taken(docs, slots).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert len(goal) == len(sizes) and all(abs(took[s] - want) <= 0.5 for s, want in goal.items())
    copies = {r["source"]: r["count"] for r in mixing.mixed(docs, slots).groupBy("source").count().collect()}
    assert set(copies) == set(goal)


def slow_takes(rows, slots):
    """Words that the mix takes of each row: whole rounds of the source's stream of documents, then its start."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal, out = slow_targets(sizes), []
    for source, total in sizes.items():
        want, mine = int(goal[source] + 0.5), [r for r in rows if r["source"] == source]
        for r in sorted(mine, key=lambda r: r["start"]):
            ahead = [max(0, min(want - p * total - r["start"], r["size"])) for p in range(2)]
            out.append((r["doc_id"], sum(ahead)))
    return sorted(out)


@pytest.mark.parametrize("slots", [16, 1 << 10, 1 << 20])
def test_takes_equal_brute_force(spark, slots):
    rows = mixing.taken(corpus(spark, 150), slots).collect()
    for source in {r["source"] for r in rows}:  # starts follow each other without gaps
        at = 0
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: (r["start"], r["size"])):
            assert r["start"] == at
            at += r["size"]
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == slow_takes(rows, slots)


def test_clashing_names_are_kept(spark):
    names = "doc_id long, text string, source string, mark int, copies string, row int, mine int, copy int, _tw_id int"
    docs = spark.createDataFrame([(i, "a b c", "s", 1, "x", 2, 3, 4, i) for i in range(8)], names)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {(r["copies"], r["row"], r["copy"]) for r in mixed.collect()} == {("x", 2, 4)}

"""Small fixtures whose results are known by hand."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tidewheel.operators import clusters, evaluation, fairness, forecast, graph, guard, market, mining, ml, panel, profile, similarity, splits, stats, trials
from tidewheel.plans import graphs, markets
from tidewheel.sources import files, tables


def scores(spark, rows):
    return spark.createDataFrame(rows, "y int, s double")


def test_ranking_metrics(spark):
    df = scores(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    assert evaluation.average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert evaluation.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.75)
    best = evaluation.best_f1(df, "y", "s").first()
    assert (best["f1"], best["threshold"]) == (pytest.approx(0.8), 0.35)


def test_a_constant_score_knows_nothing(spark):
    df = scores(spark, [(0, 0.5), (1, 0.5), (1, 0.5), (0, 0.5)])
    assert evaluation.average_precision(df, "y", "s").first()["average_precision"] == pytest.approx(0.5)
    assert evaluation.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.5)


def test_negated_score_mirrors_auc(spark):
    df = scores(spark, [(0, 0.1), (1, 0.2), (1, 0.7), (0, 0.7), (1, 0.9)])
    auc = evaluation.roc_auc(df, "y", "s").first()[0]
    assert evaluation.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0] == pytest.approx(1 - auc)


def test_cost_curve_agrees_with_counting(spark):
    rows = [(i % 3 == 0, i / 40) for i in range(41)]
    found = evaluation.cost_curve(scores(spark, [(int(y), s) for y, s in rows]), "y", "s", 5.0, 1.0, 11).collect()
    for r in found:
        assert r["tp"] == sum(y and s >= r["threshold"] - 1e-9 for y, s in rows)
        assert r["alerts"] == sum(s >= r["threshold"] - 1e-9 for y, s in rows)


def test_empty_tables(spark):
    df = scores(spark, []).where("y is not null")
    assert evaluation.average_precision(df, "y", "s").first()["average_precision"] is None
    assert profile.histogram(df, "s", 4).count() == 0
    assert mining.size_table(mining.baskets(df, "y", "s")).count() == 0


def test_false_discovery(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.20,)], "p double")
    found = {r["p"]: r["q"] for r in stats.false_discovery(df, "p", 0.05).collect()}
    assert [r["significant"] for r in stats.false_discovery(df, "p", 0.04).orderBy("p").collect()] == [True, False, False, False]  # at alpha itself
    assert found == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.16 / 3), 0.04: pytest.approx(0.16 / 3), 0.20: pytest.approx(0.20)}


def exact_tail(both, a, b, n):
    return sum(math.comb(a, k) * math.comb(n - a, b - k) for k in range(both, min(a, b) + 1)) / math.comb(n, b)


def test_fisher_equals_exact_sums(spark):
    rows = [(12, 42, 52, 982, "x"), (0, 5, 5, 50, "y"), (5, 5, 5, 50, "z"), (3, 40, 30, 60, "v"), (900, 3000, 2500, 9000, "w"), (30, 40, 30, 60, "u")]
    df = spark.createDataFrame(rows, "n_both long, n_a long, n_c long, n long, name string")
    want = {r["name"]: exact_tail(r["n_both"], r["n_a"], r["n_c"], r["n"]) for r in df.collect()}
    found = {r["name"]: r["p"] for r in mining.significant_rules(df, 0.05).collect()}
    assert all(found[k] == pytest.approx(v, rel=1e-8) for k, v in want.items())
    assert stats._tail(900, 3000, 2500, 9000, chunk=7) == pytest.approx(want["w"], rel=1e-8)


def test_running_totals_in_two_levels(spark):
    df = spark.createDataFrame([(None, 2), (-5.0, 1), (0.0, 4), (0.001, 1), (1e6, 3), (1e6 + 1, 2)], "v double, n int")
    found = {r["v"]: r["s"] for r in stats.running_total(df, "v", "n", "s").collect()}
    assert found == {None: 2, -5.0: 3, 0.0: 7, 0.001: 8, 1e6: 11, 1e6 + 1: 13}
    assert {r["v"]: r["s"] for r in stats.running_total(df.where("v = 0"), "v", "n", "s").collect()} == {0.0: 4}


def test_quantiles_equal_numpy(spark):
    values = [3.0, 1.5, 1.5, -2.0, 1e9, 7.25, 7.25, 7.25, 0.0]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 4.0), (None, 8.0), ("b", None), ("a", float("nan"))], "g string, v double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    assert stats.quantiles(df, "v", shares, "q").first()["q"] == pytest.approx(np.quantile([*values, 4.0, 8.0], shares))
    found = {r["g"]: r["q"] for r in stats.quantiles(df, "v", shares, "q", ["g"]).collect()}
    assert found == {"a": pytest.approx(np.quantile(values, shares)), None: pytest.approx(np.quantile([4.0, 8.0], shares))}
    assert stats.quantiles(df.where("g = 'b'"), "v", shares, "q").collect()[0]["q"] is None


def test_walk_forward_folds(spark):
    rows = spark.range(23).select("id", F.timestamp_seconds(F.col("id") * 90_000).alias("t"))

    def folds(n_folds, embargo, trim):
        found = {}
        for r in splits.walk_forward(rows, "t", "id", n_folds, embargo, trim).collect():
            found.setdefault((r["fold"], r["split"]), []).append(r["pos"])
        return {k: (min(v), max(v)) for k, v in found.items()}

    assert folds(3, 2, "train") == {(0, "train"): (0, 5), (0, "test"): (8, 12), (1, "train"): (0, 10), (1, "test"): (13, 17), (2, "train"): (0, 15), (2, "test"): (18, 22)}
    assert folds(3, 99, "train")[0, "train"] == (0, 0)
    assert folds(3, 2, "test") == {(0, "train"): (0, 4), (0, "test"): (7, 9), (1, "train"): (0, 9), (1, "test"): (12, 14), (2, "train"): (0, 14), (2, "test"): (17, 19)}
    assert folds(3, 5, "test") == {} == folds(30, 0, "train")


def test_performance_by_hand(spark):
    returns = [0.01, -0.02, 0.0, 0.03, -0.01]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(returns)], "day int, r double")
    one = market.performance(df, "r").first()
    total = math.prod(1 + r for r in returns)
    annual = total ** (252 / 5) - 1
    mean = sum(returns) / 5
    volatility = math.sqrt(sum((r - mean) ** 2 for r in returns) / 4 * 252)
    down = math.sqrt(((-0.02 + 0.015) ** 2 + (-0.01 + 0.015) ** 2) / 1 * 252)
    assert (one["hit_rate"], one["n"]) == (pytest.approx(0.4), 5)
    assert (one["sharpe"], one["sortino"]) == (pytest.approx(annual / volatility), pytest.approx(annual / down))


def test_zhang_by_hand(spark):
    sets_ = spark.createDataFrame([(["a"], 1, 50), (["b"], 1, 40), (["a", "b"], 2, 10)], "items array<string>, size int, cnt long")
    found = {(r["antecedent"], r["consequent"]): r["zhang"] for r in mining.rules(sets_, 100, 0.0).collect()}
    assert found["a", "b"] == pytest.approx((0.2 - 0.4) / max(0.2 * 0.6, 0.4 * 0.8))
    assert found["b", "a"] == pytest.approx((0.25 - 0.5) / max(0.25 * 0.5, 0.5 * 0.75))


def test_minhash_equals_brute_force(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, ""), (3, None), (4, "short"), (5, "x " * 4000)], "k int, t string")
    rows = similarity.portable_sets(docs, "k", "t").withColumn("s", similarity.minhash(F.col("grams"), 128)).collect()
    for r in rows:
        for (a, b), found in zip(similarity.coefficients(128), r["s"], strict=True):
            assert found == min(((g % similarity.PRIME) * a + b) % similarity.PRIME for g in r["grams"]) if r["grams"] else similarity.PRIME
    assert sorted(len(r["grams"]) for r in rows) == [0, 0, 1, 1, 2]
    md5 = int(hashlib.md5(b"one two three four five").hexdigest()[:15], 16)
    assert md5 in next(r for r in rows if r["key"] == 1)["grams"]


def test_histogram_closes_its_last_edge(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(float("nan"),), (None,), (float("inf"),)], "v double")
    assert [r["n"] for r in profile.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]


def test_lags_do_not_skip_missing_hours_or_cross_zones(spark):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 02:10:00"), ("b", "2024-01-01 01:00:00")]
    events = spark.createDataFrame(rows, "e string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    dense = panel.lags(panel.dense(panel.counts_by_hour(events, "e", "t")), (1,)).orderBy("zone", "hour_ts").collect()
    assert [(r["zone"], r["n"], r["lag_1"]) for r in dense] == [("a", 1, None), ("a", 0, 1), ("a", 1, 0), ("b", 0, None), ("b", 1, 0), ("b", 0, 1)]


@pytest.mark.parametrize(("n", "test", "embargo", "train_n", "test_n"), [(10, 0.2, 3, 5, 2), (2, 0.5, 0, 1, 1), (1, 0.5, 0, 0, 0)])
def test_temporal_split(spark, n, test, embargo, train_n, test_n):
    rows = spark.range(n).select("id", F.timestamp_seconds("id").alias("t"))
    found = {r["split"]: r["n_rows"] for r in splits.report(splits.temporal(rows, "t", "id", test, embargo)).collect()}
    assert (found.get("train", 0), found.get("test", 0)) == (train_n, test_n)


def test_splits_are_disjoint_and_whole(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("g"), (F.col("id") % 2).alias("y"))
    sides = splits.grouped(rows, "g", 0.3, 1).groupBy("g").agg(F.countDistinct("split").alias("n")).collect()
    assert len(sides) == 7 and all(r["n"] == 1 for r in sides)
    assert {r["fold"]: r["count"] for r in splits.folds(rows, "id", "y", 5, 1).groupBy("fold").count().collect()} == dict.fromkeys(range(5), 20)


def test_only_pipelines_are_validated():
    with pytest.raises(TypeError):
        splits.require_pipeline(LogisticRegression())
    assert splits.require_pipeline(Pipeline(stages=[]))


def test_performance_by_hand(spark):
    df = spark.createDataFrame([("2024-01-01", 0.1), ("2024-01-02", -0.2), ("2024-01-03", 0.05)], "day string, r double")
    one = market.performance(df.withColumn("day", F.col("day").cast("date")), "r").first()
    assert one["total_return"] == pytest.approx(1.1 * 0.8 * 1.05 - 1)
    assert one["max_drawdown"] == pytest.approx(-0.2)
    assert one["hit_rate"] == pytest.approx(2 / 3)


def test_features_look_back_only(spark, sf_dir):
    bars = markets.bars(spark, sf_dir)
    assert guard.forward_frames(market.rsi(bars).select("day", "rsi")) == []
    assert guard.forward_frames(market.returns(bars)) != []
    with pytest.raises(ValueError):
        guard.require_backward(market.returns(bars))


def test_moved_features_finds_a_leak(spark, sf_dir):
    bars = markets.bars(spark, sf_dir)
    leaky = guard.moved_features(bars, lambda df: df.withColumn("x", F.lead("close", 5).over(market.order())), ["x"], "1998-01-01")
    assert leaky.count() > 0


def test_itemsets_and_rules(spark):
    baskets = [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("4", "c"), ("4", "a")]
    sets = mining.baskets(spark.createDataFrame(baskets, "k string, item string"), "k", "item")
    apriori = {(tuple(r["items"]), r["cnt"]) for r in mining.apriori(sets, 0.5).collect()}
    assert apriori == {(("a",), 4), (("b",), 2), (("a", "b"), 2)} == {(tuple(r["items"]), r["cnt"]) for r in mining.fp_growth(sets, 0.5).collect()}
    rule = {r["antecedent"]: r for r in mining.rules(mining.apriori(sets, 0.5), 4, 0.05).collect()}
    assert rule["b"]["confidence"] == 1 and rule["b"]["conviction"] is None and rule["b"]["lift"] == 1
    assert rule["a"]["confidence"] == 0.5 and rule["a"]["conviction"] == 1


def test_similar_pairs_equal_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    texts = [" ".join(base), " ".join(base + ["more"]), " ".join(base[:-1]), " ".join(base), "short text", "", None, " ".join(reversed(base))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(t):
        w = (t or "").split()
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} - {""}

    member, distinct = similarity.classes(similarity.sets(df, "doc_id", "text"))
    reps = {r["key"]: r["rep"] for r in member.collect()}
    assert reps[3] == 0 and reps[6] == 5
    ids = sorted(set(reps.values()))
    sets = {i: grams(texts[i]) for i in ids}
    want = {(a, b) for a in ids for b in ids if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in similarity.pairs(distinct).collect()} == want != set()


def test_minhash_estimates(spark):
    df = spark.createDataFrame([(list(range(0, 100)), list(range(50, 150))), ([], [])], "a array<long>, b array<long>")
    signed = df.select(similarity.estimate(similarity.minhash(F.col("a"), 256), similarity.minhash(F.col("b"), 256), 256).alias("e"))
    near, empty = (r["e"] for r in signed.collect())
    assert near == pytest.approx(1 / 3, abs=0.12) and empty == 1


def test_graph_levels_paths_and_bounds(spark):
    nodes, edges = graphs._graph(spark)
    level = {r["name"]: r["level"] for r in graph.levels(nodes, edges).collect()}
    assert all(level[c] > level[p] for c, ps in graphs.PARENTS.items() for p in ps)
    longest = max(r["seconds"] for r in graph.critical_paths(nodes, edges).collect())
    plan = {r["workers"]: r for r in graph.least_makespan(nodes, edges, [1, 2, 4]).collect()}
    assert plan[1]["makespan"] == sum(graphs.TASKS.values()) and all(r["makespan"] >= longest for r in plan.values())
    assert longest == 9 + 7 + 6 + 20 + 3 + 2 + 1


def test_fingerprints_chain(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "name string, seconds double")
    edges = spark.createDataFrame([("c", "a"), ("c", "b")], "child string, parent string")
    found = {r["name"]: r["digest"] for r in graph.fingerprints(nodes, edges).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found["c"] == sha("c|" + ",".join(sorted([sha("a"), sha("b")])))


def test_short_series_repeat_their_season(spark):
    df = spark.createDataFrame([("k", i, float(i % 3)) for i in range(5)], "k string, t long, v double")
    found = forecast.smoothed(df, "k", "t", "v", 3, 4).orderBy("step").collect()
    assert [r["forecast"] for r in found] == [2.0, 0.0, 1.0, 2.0]


def test_identity_holds(spark):
    rows = [("g", int(i % 3 == 0), i % 10 / 10) for i in range(100)]
    groups = fairness.by_group(spark.createDataFrame(rows, "g string, y int, s double"), "g", "y", "s", 0.5, 30)
    assert fairness.identity(groups).first()["gap"] == pytest.approx(0, abs=1e-12)


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("milk, bread,milk\n\n , \nbeer\n")
    assert [r["items"] for r in files.read_baskets(spark, str(tmp_path / "b.txt")).collect()] == [["bread", "milk"], ["beer"]]
    (tmp_path / "c.csv").write_text(" a ;b\n1;2\n")
    assert files.tidy_header(files.read_delimited(spark, str(tmp_path / "c.csv"), sep=";")).columns == ["a", "b"]
    odd = spark.createDataFrame([("4/1/2014 0:11:00", "1.5"), ("2014-04-02", "x")], "t string, v string")
    one, two = odd.select(files.parse_time(F.col("t"), ["M/d/yyyy H:mm:ss", "yyyy-MM-dd"]).alias("t"), files.parse_number(F.col("v")).alias("v")).collect()
    assert one["t"].month == 4 and one["v"] == 1.5 and two["t"].day == 2 and two["v"] is None
    both = files.union_tagged({"x": spark.range(1), "y": spark.range(2)}, "tag")
    assert both.groupBy("tag").count().count() == 2
    out = str(tmp_path / "j")
    files.write_json(spark.createDataFrame([(float("nan"), 1)], "d double, i int"), out, {"seed": "42"})
    line = json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*.json")))
    assert line == {"d": None, "i": 1, "_run": {"seed": "42"}}
    manifest = spark.createDataFrame([("b.txt", hashlib.sha256((tmp_path / "b.txt").read_bytes()).hexdigest())], "name string, sha256 string")
    assert files.verify_digests(spark, str(tmp_path / "b.txt"), manifest).first()["matches"] is True
    with pytest.raises(KeyError):
        tables.table(spark, "/nowhere", "unknown")


def test_diamonds_do_not_multiply(spark):
    """Eight diamonds in a row have 256 paths; a front holds a row a node."""
    depth = 8
    edges = [e for i in range(depth) for e in ((f"a{i}", f"t{i}"), (f"b{i}", f"t{i}"), (f"t{i + 1}", f"a{i}"), (f"t{i + 1}", f"b{i}"))]
    names = sorted({n for e in edges for n in e})
    edges = spark.createDataFrame(edges, "child string, parent string")
    nodes = spark.createDataFrame([(n, 2.0 if n.startswith("b") else 1.0) for n in names], "name string, seconds double")
    last = {r["name"]: r for r in graph.critical_paths(nodes, edges).collect()}[f"t{depth}"]
    assert last["seconds"] == 3 * depth + 1 and last["path"] == ">".join(f"t{i}>b{i}" for i in range(depth)) + f">t{depth}"
    assert {r["name"]: r["n_invalid"] for r in graph.invalidated(nodes, edges).withColumnRenamed("changed", "name").collect()}["t0"] == len(names)


def test_cycles_are_found_and_refused(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "b"), ("d", "c"), ("x", "x")], "child string, parent string")
    nodes = spark.createDataFrame([(n, 1.0) for n in "abcdxr"], "name string, seconds double")
    assert sorted(r["path"] for r in graph.cycles(edges).collect()) == ["a>b>a", "x>x"]
    looped = spark.createDataFrame([("a", "r"), ("b", "a"), ("a", "b")], "child string, parent string")
    with pytest.raises(ValueError):
        graph.levels(nodes, looped)
    assert graph.cycles(edges.where("child = 'd'")).count() == 0
    ring = spark.createDataFrame([(f"n{(i + 1) % 6}", f"n{i}") for i in range(6)], "child string, parent string")
    assert [r["path"] for r in graph.cycles(ring, most=6).collect()] == ["n0>n1>n2>n3>n4>n5>n0"]
    with pytest.raises(Exception, match="more than 5 tasks"):
        graph.cycles(ring, most=5).collect()


def test_json_files_and_leaks(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"x": 1,\n "y": "é"}')
    (tmp_path / "j" / "b.json").write_text("{broken")
    (tmp_path / "j" / "c.json").write_text('{"x": "' + "z" * 200 + '"}')
    where = str(tmp_path / "j")
    found = {r["name"]: (r["valid"], r["too_large"]) for r in files.json_report(spark, where, 100).collect()}
    assert found == {"a.json": (True, False), "b.json": (False, False), "c.json": (True, True)}
    assert files.read_json(spark, f"{where}/a.json").first().asDict() == {"x": 1, "y": "é"}
    runs = spark.createDataFrame([("a.json", 2.0), ("a.json", 3.0), ("gone", 1.0)], "name string, seconds double")
    assert {r["name"]: r["seconds"] for r in files.stamped_files(spark, where, runs).collect()} == {"a.json": 3.0, "b.json": None, "c.json": None}
    assert files.without_leaks(spark.range(1).withColumn("leak", F.lit(1)), ["leak"]).columns == ["id"]
    with pytest.raises(KeyError):
        files.without_leaks(spark.range(1), ["leak"])


def test_choice_of_k(spark):
    quality = spark.createDataFrame([(2, 0.4), (3, 0.6), (4, 0.5)], "k int, silhouette double")
    stable = spark.createDataFrame([(2, True), (3, False), (4, True)], "k int, stable boolean")
    assert tuple(trials.chosen_k(quality, stable).first()) == (4, 0.5, False)
    assert tuple(trials.chosen_k(quality, stable.withColumn("stable", F.lit(False))).first()) == (3, 0.6, True)


def test_leaks_inflate_and_weights_are_the_classes_ratio(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"), F.rand(1).alias("noise"))
    rows = rows.withColumn("leak", F.col("toxic") * 1.0)
    found = trials.leak_inflation(rows, "doc_id", "toxic", ["noise"], ["leak"], 2, 1, ("logistic",)).first()
    assert found["leaked"] == pytest.approx(1.0) and found["clean"] < 0.5
    weights = {r["variant"]: (r["weight"], r["roc_auc"]) for r in trials.reweighting(rows, "doc_id", "toxic", ["leak"], 0.25, 1).collect()}
    assert weights["none"][0] == 1 and weights["ratio"][0] == weights["alike"][0] == pytest.approx(4.0) and all(a == 1.0 for _, a in weights.values())


def test_direct_steps_learn_a_cycle(spark):
    rows = spark.range(240).select(F.lit("a").alias("z"), F.timestamp_seconds(F.col("id") * 3600).alias("t"), (F.col("id") % 4).alias("n"))
    found = {r["step"]: r for r in trials.direct_steps(rows, "z", "t", "n", (1, 2), (1, 2), 0.25, 1).collect()}
    assert all(r["mae"] < 0.2 < r["naive_mae"] for r in found.values())


def test_digests_are_kept_as_first_seen(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    record = str(tmp_path / "record")
    assert files.first_seen(spark, str(tmp_path / "in"), record).first()["matches"] is None
    (tmp_path / "in" / "b.txt").write_text("two")
    assert {r["name"]: r["matches"] for r in files.first_seen(spark, str(tmp_path / "in"), record).collect()} == {"a.txt": True, "b.txt": None}
    (tmp_path / "in" / "a.txt").write_text("changed")
    assert {r["name"]: r["matches"] for r in files.first_seen(spark, str(tmp_path / "in"), record).collect()} == {"a.txt": False, "b.txt": True}


def test_tables_have_their_declared_types(spark, tmp_path):
    spark.createDataFrame([(1, "x", 2)], "r_regionkey long, r_name string, more int").write.parquet(str(tmp_path / "region.parquet"))
    assert dict(tables.table(spark, str(tmp_path), "region").dtypes) == {"r_regionkey": "int", "r_name": "string", "more": "int"}
    spark.createDataFrame([(1,)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    with pytest.raises(KeyError):
        tables.table(spark, str(tmp_path), "nation")


def test_value_column_falls_back(spark):
    df = spark.createDataFrame([("a", "1", "2.5"), ("b", "x", "3")], "name string, mixed string, amount string")
    assert files.value_column(df, "mixed") == "mixed" and files.value_column(df, "gone", 0.9) == "amount"
    with pytest.raises(KeyError):
        files.value_column(df.select("name"), "gone")


def test_silhouette_by_hand(spark):
    x = [([0.0, 0.0], 0), ([0.0, 1.0], 0), ([5.0, 5.0], 1), ([6.0, 5.0], 1), ([5.0, 7.0], 1)]
    df = ml.vectors(spark.createDataFrame(x, "v array<double>, zone int"), "v")
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    each = []
    for i, (v, z) in enumerate(x):
        own = [far(v, w) for j, (w, y) in enumerate(x) if y == z and j != i]
        other = [far(v, w) for w, y in x if y != z]
        a, b = sum(own) / len(own), sum(other) / len(other)
        each.append((b - a) / max(a, b))
    assert clusters.silhouette(df, "features", "zone") == pytest.approx(sum(each) / len(each))

"""Forests, linkage, Bayes tables, resampled fits and similarity against brute force."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewheel.operators import clusters, forest, ml, regress, search, similarity, splits, stats, trials
from tidewheel.operators.evaluation import average_precision
from tidewheel.plans import mines
from tidewheel.sources import scratch

rng = np.random.default_rng(3)


def points(spark, x, name="v"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"k long, {name} array<double>")


def test_forest_grows_bounded_trees_and_walks_them(spark):
    x = np.vstack([rng.normal(size=(400, 2)), [[9.0, 9.0], [-8.0, 10.0]]])
    rows = spark.createDataFrame([(i, float(a), float(b), int(i >= 400)) for i, (a, b) in enumerate(x)] + [(900, None, 0.1, 0), (901, 0.2, float("nan"), 0)], "k long, a double, b double, bad int")
    grown = forest.grow(forest.samples(rows.where("bad = 0"), "k", ["a", "b"], 20, 64, 5), 2, 64, 5)
    nodes = {(r["tree"], r["node"]): r for r in grown.collect()}
    assert {t for t, _ in nodes} == set(range(20)) and max(n for _, n in nodes) < 2**7
    for (tree, node), r in nodes.items():  # each split parts the rows of its node, and both sides are there
        if r["feature"] is not None:
            assert nodes[tree, 2 * node]["n"] + nodes[tree, 2 * node + 1]["n"] == r["n"]
        else:
            assert (tree, 2 * node) not in nodes
    depth = lambda n: 2 * (math.log(n - 1) + forest.EULER) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def walked(row):
        out = []
        for tree in range(20):
            node, level = 1, 0
            while nodes[tree, node]["feature"] is not None:
                v = row[1 + nodes[tree, node]["feature"]]
                node = 2 * node + (v is not None and (v >= nodes[tree, node]["cut"]))
                level += 1
            out.append(level + depth(nodes[tree, node]["n"]))
        return sum(out) / 20

    found = forest.path_lengths(rows, ["a", "b"], grown).collect()
    assert [r["path_length"] for r in found] == pytest.approx([walked(r) for r in found])
    scores = forest.isolation_scores(rows, "k", ["a", "b"], F.col("bad") == 0, seed=5).orderBy(F.desc("anomaly")).collect()
    assert {r["k"] for r in scores[:2]} == {400, 401} and all(0 < r["anomaly"] < 1 for r in scores)
    assert forest.isolation_scores(rows, "k", ["a", "b"], F.lit(False)).first()["anomaly"] is None
    flat = spark.range(5).select("id", F.lit(1.0).alias("a"))
    assert [r["anomaly"] for r in forest.isolation_scores(flat, "id", ["a"]).collect()] == pytest.approx([0.5] * 5)


def exact_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        rise = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        i, j = min(((i, j) for j in range(len(groups)) for i in range(j)), key=lambda p: rise(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("k", [1, 3, 5])
def test_ward_is_exact_on_few_vectors(spark, k):
    x = rng.normal(size=(40, 3)) + np.repeat(np.eye(3) * 2, [13, 13, 14], axis=0)
    x[7] = x[6]
    labels = {r["k"]: r["ward"] for r in clusters.ward(points(spark, x), "k", "v", k).collect()}
    found = {frozenset(i for i in labels if labels[i] == c) for c in set(labels.values())}
    assert found == exact_ward(x, k)
    sizes = [sum(c == i for c in labels.values()) for i in range(k)]
    assert sizes == sorted(sizes, reverse=True)


def test_ward_over_micro_clusters(spark):
    x = rng.normal(size=(600, 2)) * 0.3 + np.repeat([[0, 0], [5, 0], [0, 5]], 200, axis=0)
    labels = {r["k"]: r["ward"] for r in clusters.ward(points(spark, x), "k", "v", 3, most=40).collect()}
    assert len(labels) == 600 and [len({labels[i] for i in range(a, a + 200)}) for a in (0, 200, 400)] == [1, 1, 1] and set(labels.values()) == {0, 1, 2}
    assert clusters.ward(points(spark, x).where("false"), "k", "v", 3).count() == 0


def test_bayes_table_by_hand(spark):
    train = [(1, "x", "p"), (1, "x", None), (0, "y", "p"), (0, "y", "q"), (0, "x", "q")]
    test = [(10, "x", "p"), (11, "new", "q"), (12, None, None)]
    model = stats.bayes_table(spark.createDataFrame(train, "y int, a string, b string"), "y", ["a", "b"])
    found = {(r["key"], r["y"]): r["probability"] for r in stats.bayes_scores(spark.createDataFrame(test, "k int, a string, b string"), "k", model, ["a", "b"]).collect()}
    for key, *values in test:
        joint = {}
        for y in (0, 1):
            own = [r for r in train if r[0] == y]
            joint[y] = len(own) / len(train)
            for i, v in enumerate(values, 1):
                kinds = len({r[i] for r in train}) + 1
                joint[y] *= (sum(r[i] == v for r in own) + 1) / (len(own) + kinds)
        for y in (0, 1):
            assert found[key, y] == pytest.approx(joint[y] / sum(joint.values()))
    assert len(found) == 6


def test_resampled_polynomials(spark):
    rows = [(i, float(i % 24), math.sin(i % 24 / 4) + float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    found = {r["degree"]: r for r in ml.resampled_polynomials(df, "k", "x", "y", 12, 20, 1).collect()}
    assert set(found) == set(range(1, 13)) and all(r["error"] == pytest.approx(r["bias2"] + r["variance"]) for r in found.values())
    assert found[1]["bias2"] > 20 * found[8]["bias2"] and found[12]["variance"] > 2 * found[1]["variance"]
    draws = np.diff([0.0, *ml.DRAWS])
    assert (draws * np.arange(len(draws))).sum() == pytest.approx(1, abs=1e-4)
    truth = np.array([np.mean([y for _, x, y in rows if x == h]) for h in range(24)])
    plain = np.polynomial.polynomial.polyval(np.arange(24), np.polynomial.polynomial.polyfit(np.arange(24), truth, 3))
    assert found[3]["bias2"] == pytest.approx(((plain - truth) ** 2).mean(), rel=0.2)


def test_pairs_at_one_half_on_characters(spark):
    words = ["red", "blue", "hot", "cold", "ring", "bolt", "gear", "large", "tiny", "steel"]
    titles = [" ".join(rng.choice(words, size=rng.integers(1, 6))) for _ in range(150)] + ["", "a", None]
    df = similarity.characters(spark.createDataFrame(list(enumerate(titles)), "key long, t string"), "t", "grams").select("key", F.array_sort("grams").alias("grams"))
    distinct = similarity.classes(df)[1]
    sets = {r["rep"]: set(r["grams"]) for r in distinct.collect()}
    for least in (0.3, 0.5, 0.8):
        want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) >= least * len(x | y) - 1e-12}
        found = {(r["a"], r["b"]): r["jaccard"] for r in similarity.pairs(distinct, least).collect()}
        assert found == pytest.approx(want) and want


def test_hash_family_keeps_to_the_law():
    """The error of the estimate over 400 pairs of sets is within a tenth of the binomial law."""
    family = similarity.coefficients(128)
    for s in (0.5, 0.8):
        gaps = []
        for _ in range(400):
            both = int(round(60 * 2 * s / (1 + s)))
            x = rng.integers(0, similarity.PRIME, 120 - both)
            a, b = x[:60], x[60 - both :]
            same = sum(((a * m + c) % similarity.PRIME).min() == ((b * m + c) % similarity.PRIME).min() for m, c in family)
            gaps.append(same / 128 - len(set(a) & set(b)) / len(set(a) | set(b)))
        assert np.sqrt(np.mean(np.square(gaps))) < 1.1 * math.sqrt(s * (1 - s) / 128)


@pytest.mark.parametrize("name", ["similar_pairs", "similar_documents", "lsh_recall_sweep", "minhash_error_bands", "similar_top_pairs"])
def test_similarity_writes_little_beside_its_shingles(spark, tmp_path, monkeypatch, name):
    """Only sets of candidates, the first shingles of a set and signatures leave a task."""
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"{tmp_path}/shared")
    words = np.random.default_rng(1).integers(0, 10**9, size=(200, 1000)).astype(str).tolist()
    rows = [(i, " ".join(w), "en", "a", 1) for i, w in enumerate(words)] + [(900, " ".join([*words[0][:-9], "x"]), "en", "a", 1), (901, " ".join(words[0]), "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = mines.QUERIES[name](spark, str(tmp_path)).collect()
    assert {"similar_pairs": lambda: [(r["a"], r["b"]) for r in found] == [(0, 900)], "similar_documents": lambda: sorted((r["doc_id"], r["class_id"]) for r in found if r["n_links"] == 1) == [(0, 0), (900, 900), (901, 0)],
            "similar_top_pairs": lambda: [(r["a"], r["b"], r["n_a"], r["n_b"]) for r in found] == [(0, 900, 2, 1)]}.get(name, lambda: found)()
    wrote = sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*.parquet"))
    assert wrote < 8 * 996 * len(rows) / 4


def test_sets_tell_texts_apart_as_their_runs_do(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HASHED_AT_ONCE", 40)
    texts = ["", None, "a", "b", "a b", "b a", "ab", "a b c d", "a b c d e", "a b c d e f", "e d c b a", "!!", "A-B c.D", "\u212a \u00df", "k s", "a b c d e a b c d e", "a " * 50 + "b"]
    found = similarity.sets(spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1), "k", "t").orderBy("key").collect()

    def runs(text):
        w = similarity.WORD.findall((text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    for text, r in zip(texts, found, strict=True):
        assert len(r["grams"]) == len(runs(text)) and r["grams"] == sorted(set(r["grams"]))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(found[i]["grams"]) & set(found[j]["grams"])) == len(runs(a) & runs(b)), (a, b)


def test_products_by_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "a double, b double")
    assert regress.products(df, [], [F.col("a"), F.col("b")]).first()["m"] == [[10.0, 2.0], [2.0, 4.0]]


def test_search_over_families(spark):
    rows = [(i, int(rng.random() < (0.8 if i % 4 == 0 else 0.1)), float(i % 4 == 0) + float(rng.normal()) * 0.1, ["p", "q", None][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, y int, a double, c string")
    found, model = search.search(df, "k", "y", ["a"], ["c"], draws=2, k=2, seed=3, families=("logistic", "bayes"))
    table = found.orderBy("place").collect()
    assert [r["place"] for r in table] == [1, 2, 3] and {r["family"] for r in table} == {"logistic", "bayes"}
    assert all(0 < r["average_precision"] <= 1 for r in table) and table[0]["average_precision"] > 0.5
    assert model.transform(df).where("prediction = 1").count() > 30  # the winner is fitted to all rows
    again, _ = search.search(df, "k", "y", ["a"], ["c"], draws=2, k=2, seed=3, families=("logistic", "bayes"))
    assert [r["setting"] for r in again.orderBy("place").collect()] == [r["setting"] for r in table]


def test_search_prepares_once_a_fold_and_scores_as_cross_validation(spark, monkeypatch):
    rows = [(i, int(rng.random() < (0.7 if i % 4 == 0 else 0.2)), None if i % 9 == 0 else float(i % 4 == 0) + float(rng.normal()) * 0.5, ["p", "q", None][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, y int, a double, c string")
    fits, fit = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, dataset: fits.append(1) or fit(self, dataset))
    found, _ = search.search(df, "k", "y", ["a"], ["c"], draws=3, k=3, seed=5, families=("logistic", "bayes"))
    assert len(fits) == 3 + 1
    got = {(r["family"], r["setting"]): (r["average_precision"], r["deviation"]) for r in found.collect()}
    dealt = splits.folds(df, "k", "y", 3, 5)
    for name, (model, grid) in search.drawn("y", 3, 5).items():
        for setting in grid if name in ("logistic", "bayes") else ():
            each = []
            for fold in range(3):
                whole = Pipeline(stages=[*trials.mixed_stages(["a"], ["c"]), model.copy(setting)]).fit(dealt.where(F.col("fold") != fold))
                held = whole.transform(dealt.where(F.col("fold") == fold)).select("y", vector_to_array("probability")[1].alias("p"))
                each.append(average_precision(held, "y", "p").first()[0])
            told = ", ".join(f"{p.name} {v:.4g}" for p, v in sorted(setting.items(), key=lambda x: x[0].name))
            assert got[name, told] == pytest.approx((np.mean(each), np.std(each)), abs=1e-6)


def test_exported_coefficients_score_alike(spark):
    rows = [(i, int(rng.random() < 1 / (1 + math.exp(-x))), float(x), None if i % 7 == 0 else float(rng.normal()), 1.0) for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double, flat double")
    table, model = search.logistic_table(df, "y", ["a", "b", "flat"])
    want = {r["k"]: float(r["probability"][1]) for r in model.transform(df).collect()}
    assert {r["k"]: r["probability"] for r in search.table_scores(df, "k", ["a", "b", "flat"], table).collect()} == pytest.approx(want, abs=1e-9)

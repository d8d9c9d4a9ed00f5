"""Queries over a small task graph, clusters and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import clusters, forest, graph, ml
from tidewheel.plans.common import scored, tidy
from tidewheel.sources.scratch import written
from tidewheel.sources.tables import table

# A fixed example: tasks with seconds, and their parents.
TASKS = {"ingest": 9.0, "clean": 7.0, "profile": 2.0, "split": 1.0, "features": 6.0, "train": 20.0, "baseline": 5.0, "evaluate": 3.0, "report": 2.0, "publish": 1.0}
PARENTS = {
    "clean": ["ingest"], "profile": ["ingest"], "split": ["clean"], "features": ["clean"], "train": ["split", "features"], "baseline": ["split"],
    "evaluate": ["train", "baseline"], "report": ["evaluate", "profile"], "publish": ["report"],
}
CYCLIC = [("extract", "report"), ("transform", "extract"), ("report", "transform"), ("load", "transform")]
WORKERS = [1, 2, 4, 8]


def _graph(spark):
    nodes = spark.createDataFrame(sorted(TASKS.items()), "name string, seconds double")
    edges = spark.createDataFrame([(c, p) for c, ps in sorted(PARENTS.items()) for p in ps], "child string, parent string")
    return nodes, edges


def dag_levels(spark, sf_dir):
    return graph.levels(*_graph(spark))


def dag_widths(spark, sf_dir):
    return graph.level_widths(*_graph(spark))


def dag_dependents(spark, sf_dir):
    return graph.dependents(*_graph(spark))


def dag_cycle(spark, sf_dir):
    return graph.cycles(spark.createDataFrame(CYCLIC, "child string, parent string"))


def dag_undeclared(spark, sf_dir):
    nodes, edges = _graph(spark)
    return graph.undeclared(nodes.where("name != 'split'"), edges)


def dag_fingerprints(spark, sf_dir):
    return tidy(graph.fingerprints(*_graph(spark)))


def dag_invalidation(spark, sf_dir):
    return graph.invalidated(*_graph(spark))


def dag_critical_path(spark, sf_dir):
    return graph.critical_paths(*_graph(spark))


def dag_makespan(spark, sf_dir):
    """The least time that so many workers need, level by level."""
    return tidy(graph.least_makespan(*_graph(spark), WORKERS))


def _parts(spark, sf_dir):
    return clusters.components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def nearest_centroid(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return tidy(clusters.nearest_centre(parts, clusters.centres(parts)), 5)


def cluster_validity(spark, sf_dir):
    return tidy(clusters.validity(_parts(spark, sf_dir)), 5)


def ari(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    near = clusters.nearest_centre(parts, clusters.centres(parts)).select("key", "nearest")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return tidy(clusters.adjusted_rand(near.join(labels, "key"), "nearest", "label"))


def kmeans_zones(spark, sf_dir):
    return ml.k_means(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8, 42).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


def k_sweep(spark, sf_dir):
    return ml.k_sweep(table(spark, sf_dir, "embeddings").select("embedding"), "embedding", range(2, 11), 42)


def mixture_and_tree(spark, sf_dir):
    """Clusters of the first eight principal components of whole embeddings."""
    rows = ml.projection(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    rows = rows.select("vec_id", F.array(*[f"pc{i + 1}" for i in range(8)]).alias("embedding"))
    return ml.mixture_and_tree(rows, "embedding", 4, 42).groupBy("mixture", "tree").agg(F.count(F.lit(1)).alias("n"))


def pca_projection(spark, sf_dir):
    return ml.projection(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "pc1", "pc2")


def bootstrap_stability(spark, sf_dir):
    """Agreement of clusters over 30 resamples."""
    return tidy(ml.stability(ml.bootstrap_stability(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 30, 42)))


def logistic_scores(spark, sf_dir):
    return ml.weighted_logistic(scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars"), "toxic", ["quality", "n_chars"])


def stacking(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars")
    return ml.stacked(rows, "doc_id", "toxic", ["quality", "n_chars"], 3, 42).select("doc_id", "toxic", *[f"p_{n}" for n in ml.FAMILIES], "probability")


def model_tournament(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars")
    return ml.tournament(rows, "doc_id", "toxic", ["quality", "n_chars"], 3, 42, ml.FAMILIES)


def hyperparameter_search(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars")
    return tidy(ml.random_search(rows, "doc_id", "toxic", ["quality", "n_chars"], 5, 3, 42))


def gbt_importance(spark, sf_dir):
    from tidewheel.plans.panels import panel_features

    return ml.boosted_importance(panel_features(spark, sf_dir), "n", ["lag_1", "lag_24", "lag_168", "mean_24", "hour", "dow"], rounds=5)


def anomaly_scores(spark, sf_dir):
    return ml.isolation_score(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


def clt_sampling(spark, sf_dir):
    return ml.mean_sampling(table(spark, sf_dir, "lineitem"), "l_quantity", (10, 40, 160), 3, 42)


def bias_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "value")
    return ml.bias_variance(rows, "hour", "value", (1, 3), 3, 42)


def resampled_polynomials(spark, sf_dir):
    """Degrees 1 to 15 over 40 resamples of the values by hour of the day."""
    rows = table(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("hour"), "value")
    return tidy(ml.resampled_polynomials(rows, "event_id", "hour", "value", 15, 40, 42), 4)


def isolation_forest(spark, sf_dir):
    """Customers' orders scored by a forest that is grown on those with a balance of zero or more."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(per, "c_custkey", "left").na.fill(0.0)
    return tidy(forest.isolation_scores(rows, "c_custkey", ["n_orders", "mean_price", "max_price", "c_acctbal"], F.col("c_acctbal") >= 0).select("c_custkey", "anomaly"))


def ward_clusters(spark, sf_dir):
    """Ward linkage on the first eight principal components, and how far it agrees with a mixture."""
    rows = ml.projection(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    rows = written(rows.select("vec_id", F.array(*[f"pc{i + 1}" for i in range(8)]).alias("v")), "components")
    both = clusters.ward(rows, "vec_id", "v", 4).join(ml.mixture_and_tree(rows, "v", 4, 42).select("vec_id", "mixture"), "vec_id")
    both = written(both, "ward")
    agreement = clusters.adjusted_rand(both, "ward", "mixture").select("ari")
    return tidy(both.groupBy("ward").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(agreement)))


NAMES = (
    "dag_levels dag_widths dag_dependents dag_cycle dag_undeclared dag_fingerprints dag_invalidation dag_critical_path dag_makespan nearest_centroid cluster_validity ari kmeans_zones k_sweep mixture_and_tree "
    "pca_projection bootstrap_stability logistic_scores stacking model_tournament hyperparameter_search gbt_importance anomaly_scores clt_sampling bias_variance resampled_polynomials isolation_forest ward_clusters"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

NODES = "nodes AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}::DOUBLE)" for n, s in TASKS.items()) + ") t(name, seconds))"
EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p}')" for c, ps in PARENTS.items() for p in ps) + ") t(child, parent))"
WALK = f"WITH RECURSIVE {NODES}, {EDGES}, walk AS (SELECT name, 0 AS level, name AS path, seconds FROM nodes WHERE name NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, w.level + 1, w.path || '>' || e.child, w.seconds + n.seconds FROM walk w JOIN edges e ON e.parent = w.name JOIN nodes n ON n.name = e.child), lv AS (SELECT name, max(level)::BIGINT AS level FROM walk GROUP BY 1)"
CENTRES = "p AS (SELECT vec_id AS key, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c, count(*) AS n FROM p GROUP BY 1, 2)"
NEAREST = "d AS (SELECT p.key, c.label AS o, round(sum((x - c) * (x - c)), 9) AS d FROM p JOIN c USING (i) GROUP BY 1, 2), near AS (SELECT key, o::BIGINT AS nearest, d AS distance2 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, o) AS r FROM d) WHERE r = 1)"
# Digests of parents, one table a level; the graph has fewer levels than tasks.
DIGESTS = "d0 AS (SELECT name, level, sha256(name) AS digest FROM lv WHERE level = 0)" + "".join(
    f", d{k} AS (SELECT * FROM d{k - 1} UNION ALL SELECT e.child, {k}, sha256(e.child || '|' || string_agg(digest, ',' ORDER BY digest)) FROM edges e JOIN d{k - 1} p ON p.name = e.parent JOIN lv ON lv.name = e.child AND lv.level = {k} GROUP BY e.child)"
    for k in range(1, len(TASKS))
)
ORACLES = {
    "dag_fingerprints": WALK + f", {DIGESTS} SELECT name, level, digest FROM d{len(TASKS) - 1}",
    "dag_makespan": WALK
    + f""", g AS (SELECT level, max(seconds) AS longest, sum(seconds) AS work FROM nodes JOIN lv USING (name) GROUP BY 1), m AS (SELECT workers, sum(greatest(longest, work / workers)) AS makespan, sum(work) AS work FROM g, (SELECT unnest({WORKERS}) AS workers) GROUP BY 1)
SELECT workers::BIGINT AS workers, round(makespan, 6) AS makespan, round(makespan * workers - work, 6) AS idle, round(work / makespan, 6) AS speedup, round(work / makespan / workers, 6) AS efficiency FROM m""",
    "dag_levels": WALK + " SELECT name, level FROM lv",
    "dag_widths": WALK + " SELECT level, count(*) AS width FROM lv GROUP BY 1",
    "dag_dependents": f"WITH {NODES}, {EDGES} SELECT name, count(parent) AS n_dependents, rank() OVER (ORDER BY count(parent) DESC) AS rank FROM nodes LEFT JOIN edges ON parent = name GROUP BY 1",
    "dag_cycle": "SELECT 'extract>transform>report>extract' AS path",
    "dag_undeclared": f"WITH {EDGES} SELECT child, parent FROM edges WHERE parent = 'split'",
    "dag_invalidation": f"WITH RECURSIVE {NODES}, {EDGES}, w AS (SELECT parent AS root, child AS name FROM edges UNION ALL SELECT w.root, e.child FROM w JOIN edges e ON e.parent = w.name) SELECT n.name AS changed, count(DISTINCT w.name) + 1 AS n_invalid FROM nodes n LEFT JOIN w ON w.root = n.name GROUP BY 1",
    "dag_critical_path": WALK + " SELECT name, path, seconds FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seconds DESC, path) AS r FROM walk) WHERE r = 1",
    "nearest_centroid": f"WITH {CENTRES}, {NEAREST} SELECT key, nearest, round(distance2, 5) AS distance2 FROM near",
    "cluster_validity": f"""WITH {CENTRES}, g AS (SELECT i, avg(x) AS g FROM p GROUP BY 1), w AS (SELECT key, label, sum((x - c) * (x - c)) AS d2 FROM p JOIN c USING (label, i) GROUP BY 1, 2), s AS (SELECT label, sum(d2) AS ss, avg(sqrt(d2)) AS s, count(*) AS n FROM w GROUP BY 1),
b AS (SELECT sum(n * (c - g) * (c - g)) AS b FROM c JOIN g USING (i)), m AS (SELECT l.label, r.label AS o, sqrt(sum((l.c - r.c) * (l.c - r.c))) AS m FROM c l JOIN c r ON l.i = r.i AND l.label <> r.label GROUP BY 1, 2),
q AS (SELECT m.label, max((x.s + y.s) / m) AS r FROM m JOIN s x ON x.label = m.label JOIN s y ON y.label = m.o GROUP BY 1)
SELECT count(*) AS k, sum(n)::BIGINT AS n, round(any_value(b.b) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))), 5) AS calinski_harabasz, round((SELECT avg(r) FROM q), 5) AS davies_bouldin FROM s, b""",
    "ari": f"""WITH {CENTRES}, {NEAREST}, j AS (SELECT nearest AS a, label AS b, count(*) AS n FROM near JOIN (SELECT vec_id AS key, label FROM embeddings) USING (key) GROUP BY 1, 2),
t AS (SELECT sum(n * (n - 1) / 2) AS n_both, sum(n) AS total FROM j), x AS (SELECT sum(n * (n - 1) / 2) AS pa FROM (SELECT a, sum(n) AS n FROM j GROUP BY 1)), y AS (SELECT sum(n * (n - 1) / 2) AS pb FROM (SELECT b, sum(n) AS n FROM j GROUP BY 1))
SELECT round((n_both - pa * pb / (total * (total - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (total * (total - 1) / 2)), 6) AS ari, total::BIGINT AS n FROM t, x, y""",
}

"""Queries over baskets (orders of brands) and over similar texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import mining, similarity
from tidewheel.plans.common import tidy
from tidewheel.sources.scratch import written
from tidewheel.sources.tables import table

SUPPORT, CONFIDENCE, ALPHA = 0.001, 0.05, 0.05
HASHES = 128
#: Bands and rows of the sweep.
SWEEP = ((8, 16), (16, 8), (26, 4), (32, 4), (64, 2))


def sets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return mining.baskets(rows, "l_orderkey", "p_brand")


def _flat(df):
    return df.select(F.array_join("items", "|").alias("items"), F.col("size").cast("long").alias("size"), "cnt")


def basket_sizes(spark, sf_dir):
    return tidy(mining.size_table(sets(spark, sf_dir)))


def item_support(spark, sf_dir):
    rows = sets(spark, sf_dir)
    n = rows.count()
    counts = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("cnt"))
    return tidy(counts.withColumn("support", F.col("cnt") / n).orderBy(F.desc("cnt"), "item").limit(30))


def itemsets_apriori(spark, sf_dir):
    return _flat(mining.apriori(written(sets(spark, sf_dir), "baskets"), SUPPORT))


def itemsets_fpgrowth(spark, sf_dir):
    return _flat(mining.fp_growth(written(sets(spark, sf_dir), "baskets"), SUPPORT))


def itemsets_agree(spark, sf_dir):
    """Itemsets that only one of the two algorithms finds: none."""
    a, b = itemsets_apriori(spark, sf_dir), itemsets_fpgrowth(spark, sf_dir)
    return a.exceptAll(b).union(b.exceptAll(a))


def _rules(spark, sf_dir):
    rows = written(sets(spark, sf_dir), "baskets")
    n = rows.count()
    return written(mining.rules(written(mining.fp_growth(rows, SUPPORT), "itemsets"), n, CONFIDENCE), "rules"), n


def rules_measures(spark, sf_dir):
    return tidy(_rules(spark, sf_dir)[0])


def rules_fdr(spark, sf_dir):
    found, _ = _rules(spark, sf_dir)
    rows = mining.significant_rules(found, ALPHA)
    return tidy(rows.select("antecedent", "consequent", "n_both", "n_a", "n_c", "p", "q", "significant"))


def dissociations(spark, sf_dir):
    """Rules whose antecedent makes their consequent less likely by far."""
    return tidy(mining.dissociations(_rules(spark, sf_dir)[0], 15).select("antecedent", "consequent", "n_both", "zhang"))


def weak_rules(spark, sf_dir):
    """The rules of the lowest Zhang measure, whatever it is."""
    return tidy(mining.dissociations(_rules(spark, sf_dir)[0], 15, 20, 1.0).select("antecedent", "consequent", "n_both", "zhang"))


def _top(spark, sf_dir, measure, n, least_count=0, only_significant=True):
    found, _ = _rules(spark, sf_dir)
    rows = mining.top_rules(mining.significant_rules(found, ALPHA), measure, n, least_count, only_significant)
    return tidy(rows.select("rank", "antecedent", "consequent", "n_both", F.col(measure).alias("value"), "significant"))


def rules_top_lift(spark, sf_dir):
    return _top(spark, sf_dir, "lift", 60)


def rules_top_leverage(spark, sf_dir):
    return _top(spark, sf_dir, "leverage", 40)


def rules_by_confidence(spark, sf_dir):
    """Rules ranked by another measure, in 20 baskets at least, significant or not."""
    return _top(spark, sf_dir, "confidence", 100, 20, False)


def cooccurrence_graph(spark, sf_dir):
    return mining.cooccurrence(mining.fp_growth(sets(spark, sf_dir), SUPPORT), 25, 150)


def itemsets_top(spark, sf_dir):
    return tidy(mining.top_by_size(mining.fp_growth(sets(spark, sf_dir), SUPPORT), 20))


def _documents(spark, sf_dir):
    return similarity.sets(table(spark, sf_dir, "documents"), "doc_id", "text")


def _pairs(spark, sf_dir):
    return similarity.pairs(_documents(spark, sf_dir).withColumnRenamed("key", "rep"))


def shingle_counts(spark, sf_dir):
    rows = similarity.shingles(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "s")
    rows = similarity.characters(rows, "text", "c")
    return tidy(rows.select("doc_id", F.size("s").alias("n_shingles"), F.size("c").alias("n_characters")))


def similar_documents(spark, sf_dir):
    member = similarity.members(_documents(spark, sf_dir))
    return similarity.links(member, _pairs(spark, sf_dir)).select(F.col("key").alias("doc_id"), F.col("rep").alias("class_id"), "n_links")


def similar_pairs(spark, sf_dir):
    return tidy(_pairs(spark, sf_dir))


def similar_titles(spark, sf_dir):
    """Pairs of distinct product titles that share half of their runs of three characters; a title goes by its smallest part."""
    title = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    rows = similarity.characters(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), title.alias("title")), "title", "grams")
    return tidy(similarity.pairs(similarity.classes(written(rows.select("key", F.array_sort("grams").alias("grams")), "title-sets"))[1], 0.5))


def _signed(spark, sf_dir):
    """Signatures of distinct sets of documents, written once."""
    return written(similarity.signed(table(spark, sf_dir, "documents"), "doc_id", "text", HASHES), "minhash-signed")


def minhash_signatures(spark, sf_dir):
    return _signed(spark, sf_dir).select("rep", F.array_join("signature", ",").alias("signature"))


def lsh_buckets(spark, sf_dir):
    """Buckets that several classes share, by band: how many there are and how many classes they hold."""
    fallen = similarity.buckets(_signed(spark, sf_dir), 16, 8).groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return tidy(fallen.groupBy("band").agg(F.count(F.lit(1)).alias("n_buckets"), F.sum("n").alias("n_classes"), F.max("n").alias("largest")))


def lsh_recall_sweep(spark, sf_dir):
    """Bands and rows against the exact pairs."""
    return tidy(similarity.sweep(_signed(spark, sf_dir), written(_pairs(spark, sf_dir), "similar-pairs"), SWEEP))


def minhash_error_bands(spark, sf_dir):
    """Error of the estimate on truly similar pairs, by band of similarity, beside the binomial deviation."""
    rows = similarity.estimated(_pairs(spark, sf_dir), _signed(spark, sf_dir), HASHES)
    law = F.sqrt(F.col("jaccard") * (1 - F.col("jaccard")) / HASHES).alias("law")
    rows = rows.select(F.floor(F.round(F.col("jaccard") * 20, 9)).alias("band"), (F.col("estimate") - F.col("jaccard")).alias("gap"), law)
    return tidy(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("gap").alias("bias"), F.sqrt(F.avg(F.col("gap") ** 2)).alias("rms"), F.avg("law").alias("law")))


def similar_top_pairs(spark, sf_dir):
    """The 25 most similar pairs with both scores and the number of copies of either."""
    signed = _signed(spark, sf_dir)
    best = _pairs(spark, sf_dir).orderBy(F.round("jaccard", 9).desc(), "a", "b").limit(25)
    rows = similarity.estimated(best, signed, HASHES)
    rows = rows.join(signed.select(F.col("rep").alias("a"), F.col("n_copies").alias("n_a")), "a").join(signed.select(F.col("rep").alias("b"), F.col("n_copies").alias("n_b")), "b")
    return tidy(rows.select("a", "b", "jaccard", "estimate", "n_a", "n_b"))


def s_curve(spark, sf_dir):
    """1 - (1 - s^r)^b on a grid of similarities for some configurations."""
    grid = spark.range(0, 21).select((F.col("id") / 20).alias("s"))
    configs = F.explode(F.array(*[F.struct(F.lit(b).alias("bands"), F.lit(r).alias("n_rows")) for b, r in SWEEP])).alias("c")
    rows = grid.select("s", configs).select("s", "c.bands", "c.n_rows")
    return tidy(rows.withColumn("chance", 1 - F.pow(1 - F.pow("s", F.col("n_rows").cast("double")), F.col("bands").cast("double"))))


def benchmark_overlap(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.array_distinct(similarity.numbers(F.col("text"))).alias("grams"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), similarity.numbers(F.col("text")).alias("grams"))
    rows = similarity.containment(items, docs, 0.5)
    return tidy(rows.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "shared", "share"))


NAMES = (
    "basket_sizes item_support itemsets_apriori itemsets_fpgrowth itemsets_agree rules_measures rules_fdr dissociations weak_rules rules_top_lift rules_top_leverage rules_by_confidence cooccurrence_graph itemsets_top shingle_counts similar_documents similar_pairs similar_titles "
    "minhash_signatures lsh_buckets lsh_recall_sweep minhash_error_bands similar_top_pairs s_curve benchmark_overlap"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

ROWS = "b AS MATERIALIZED (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT count(DISTINCT basket) AS n, greatest(1, ceil(0.001::DOUBLE * count(DISTINCT basket) - 1e-9)) AS floor FROM b)"


def _level(k: int) -> str:
    joins = " ".join(f"JOIN b b{i} ON b{i}.basket = b1.basket AND b{i}.item > b{i - 1}.item" for i in range(2, k + 1))
    return f"SELECT [{', '.join(f'b{i}.item' for i in range(1, k + 1))}] AS items, {k} AS size, count(*) AS cnt FROM b b1 {joins} GROUP BY 1 HAVING count(*) >= (SELECT floor FROM t)"


SETS = f"{ROWS}, s AS MATERIALIZED ({' UNION ALL '.join(map(_level, (1, 2, 3, 4)))})"
FLAT = f"WITH {SETS} SELECT array_to_string(items, '|') AS items, size::BIGINT AS size, cnt FROM s"
RULES = f"""{SETS}, m AS (SELECT items, size, cnt, unnest(range(1, (1 << size) - 1)) AS mask FROM s WHERE size >= 2),
p AS (SELECT cnt AS n_both, [x FOR x, i IN items IF (mask >> (i - 1)) & 1 = 1] AS a, [x FOR x, i IN items IF (mask >> (i - 1)) & 1 = 0] AS c FROM m),
r AS MATERIALIZED (SELECT array_to_string(p.a, '|') AS antecedent, array_to_string(p.c, '|') AS consequent, n_both, sa.cnt AS n_a, sc.cnt AS n_c, n, n_both / n AS sup, sa.cnt / n AS fa, sc.cnt / n AS fc
FROM p JOIN s sa ON sa.items = p.a JOIN s sc ON sc.items = p.c, t WHERE n_both / sa.cnt >= 0.05)"""
ZHANG = "coalesce((n_both::HUGEINT * n - n_a::HUGEINT * n_c)::DOUBLE / nullif(greatest(n_both::HUGEINT * (n - n_c), n_c::HUGEINT * (n_a - n_both)), 0)::DOUBLE, 0)"
CLEAN = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _grams(t: str, key: str) -> str:
    return f"""SELECT key, list_filter(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]), lambda s: s <> '') AS g
FROM (SELECT {key} AS key, list_filter(string_split({CLEAN}, ' '), lambda w: w <> '') AS w FROM {t})"""


NUMBER = "('0x' || substr(md5({}), 1, 15))::BIGINT"
CLASSES = f"""k AS MATERIALIZED ({_grams("documents", "doc_id")}), d AS (SELECT key, list_sort([{NUMBER.format('s')} FOR s IN g]) AS grams FROM k), c AS (SELECT key, grams, min(key) OVER (PARTITION BY grams) AS rep FROM d),
u AS MATERIALIZED (SELECT rep, grams, len(grams) AS n FROM c WHERE key = rep), e AS (SELECT rep, n, unnest(grams) AS gram FROM u)"""
PAIRS = f"{CLASSES}, x AS (SELECT l.rep AS a, r.rep AS b, count(*) / (any_value(l.n) + any_value(r.n) - count(*)) AS jaccard FROM e l JOIN e r ON l.gram = r.gram AND l.rep < r.rep GROUP BY 1, 2), p AS MATERIALIZED (SELECT * FROM x WHERE jaccard >= 0.8 - 1e-12)"
SIGNED = (
    "v AS MATERIALIZED (SELECT rep, ["
    + ", ".join(f"coalesce(list_min([(g % {similarity.PRIME} * {a} + {b}) % {similarity.PRIME} FOR g IN grams]), {similarity.PRIME})" for a, b in similarity.coefficients(HASHES))
    + "] AS sig FROM u)"
)


def _band(bands: int, rows: int) -> str:
    return f"SELECT rep, unnest(range({bands})) AS band, unnest([array_to_string(sig[i * {rows} + 1:i * {rows} + {rows}], ',') FOR i IN range({bands})]) AS bucket FROM v"


def _sweep(bands: int, rows: int) -> str:
    return f"""SELECT {bands}::BIGINT AS bands, {rows}::BIGINT AS n_rows, round(pow(1.0 / {bands}, 1.0 / {rows}), 6) AS threshold, n_true, n_candidates, n_verified, n_true - n_verified AS n_missed, round(recall, 6) AS recall,
round(precision, 6) AS precision, round(2 * recall * precision / greatest(recall + precision, 1e-9), 6) AS f1 FROM (SELECT *, n_verified / greatest(n_true, 1) AS recall, n_verified / greatest(n_verified, 1) AS precision
FROM (SELECT (SELECT count(*) FROM p) AS n_true, count(*) AS n_candidates, count(p.a) AS n_verified FROM (SELECT DISTINCT l.rep AS a, r.rep AS b FROM ({_band(bands, rows)}) l JOIN ({_band(bands, rows)}) r USING (band, bucket) WHERE l.rep < r.rep) x LEFT JOIN p USING (a, b)))"""


FDR = f"""WITH {RULES}, f AS (SELECT k, sum(ln(greatest(k, 1))) OVER (ORDER BY k) AS lf FROM (SELECT unnest(range(0, (SELECT n + 1 FROM t))) AS k)), l AS (SELECT list(lf ORDER BY k) AS f FROM f),
c AS (SELECT DISTINCT n_both, n_a, n_c, n FROM r), q AS (SELECT n_both, n_a, n_c, least(1, list_sum([exp(f[n_a + 1] + f[n - n_a + 1] + f[n_c + 1] + f[n - n_c + 1] - f[n + 1] - f[i + 1] - f[n_a - i + 1] - f[n_c - i + 1] - f[n - n_a - n_c + i + 1]) FOR i IN range(n_both, least(n_a, n_c) + 1)])) AS p FROM c, l),
j AS (SELECT r.*, p FROM r JOIN q USING (n_both, n_a, n_c)), w AS (SELECT *, count(*) OVER () * p / count(*) OVER (ORDER BY p) AS raw FROM j),
z AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM w)
"""


def _ranked(measure: str, n: int, kept: str) -> str:
    return f"""{FDR}SELECT row_number() OVER (ORDER BY v DESC, antecedent, consequent) AS rank, antecedent, consequent, n_both, round(value, 6) + 0.0 AS value, significant
FROM (SELECT *, {measure} AS value, round({measure}, 9) AS v, q <= 0.05 AS significant FROM z) WHERE {kept} ORDER BY v DESC, antecedent, consequent LIMIT {n}"""


ORACLES = {
    "basket_sizes": f"WITH {ROWS}, z AS (SELECT count(*) AS size FROM b GROUP BY basket) SELECT size, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT g.size, count(z.size) AS n FROM (SELECT unnest(range(1, max(size) + 1)) AS size FROM z) g LEFT JOIN z USING (size) GROUP BY 1)",
    "item_support": f"WITH {ROWS} SELECT item, count(*) AS cnt, round(count(*) / (SELECT n FROM t), 6) AS support FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
    "itemsets_apriori": FLAT,
    "itemsets_fpgrowth": FLAT,
    "itemsets_agree": "SELECT 'x' AS items, 1::BIGINT AS size, 1::BIGINT AS cnt WHERE false",
    "rules_measures": f"""WITH {RULES} SELECT antecedent, consequent, n_both, n_a, n_c, n, round(sup, 6) AS support, round(n_both / n_a, 6) AS confidence, round(n_both / n_a / fc, 6) AS lift, round(sup - fa * fc, 6) + 0.0 AS leverage,
CASE WHEN n_both < n_a THEN round((1 - fc) / (1 - n_both / n_a), 6) END AS conviction, round({ZHANG}, 6) + 0.0 AS zhang FROM r""",
    "rules_fdr": f"""{FDR}SELECT antecedent, consequent, n_both, n_a, n_c, round(p, 6) AS p, round(q, 6) AS q, q <= 0.05 AS significant FROM z""",
    "dissociations": f"WITH {RULES} SELECT antecedent, consequent, n_both, round({ZHANG}, 6) + 0.0 AS zhang FROM r WHERE n_both >= 20 AND {ZHANG} < -0.2 ORDER BY round({ZHANG}, 9), antecedent, consequent LIMIT 15",
    "weak_rules": f"WITH {RULES} SELECT antecedent, consequent, n_both, round({ZHANG}, 6) + 0.0 AS zhang FROM r WHERE n_both >= 20 ORDER BY round({ZHANG}, 9), antecedent, consequent LIMIT 15",
    "rules_top_lift": _ranked("n_both / n_a / fc", 60, "significant"),
    "rules_top_leverage": _ranked("sup - fa * fc", 40, "significant"),
    "rules_by_confidence": _ranked("n_both / n_a", 100, "n_both >= 20"),
    "cooccurrence_graph": f"WITH {SETS}, h AS (SELECT items[1] AS i FROM s WHERE size = 1 ORDER BY cnt DESC, 1 LIMIT 25) SELECT items[1] AS a, items[2] AS b, cnt FROM s WHERE size = 2 AND items[1] IN (SELECT i FROM h) AND items[2] IN (SELECT i FROM h) ORDER BY cnt DESC, 1, 2 LIMIT 150",
    "itemsets_top": f"WITH {SETS} SELECT * FROM (SELECT size::BIGINT AS size, row_number() OVER (PARTITION BY size ORDER BY cnt DESC, array_to_string(items, '|')) AS rank, array_to_string(items, '|') AS items, cnt FROM s) WHERE rank <= 20",
    "shingle_counts": f"""SELECT key AS doc_id, len(g) AS n_shingles, n_characters FROM ({_grams("documents", "doc_id")}) JOIN (SELECT doc_id AS key, count(DISTINCT c || c2 || c3) AS n_characters FROM (SELECT doc_id, c, lead(c) OVER o AS c2, lead(c, 2) OVER o AS c3 FROM (SELECT doc_id, unnest(l) AS c, unnest(range(len(l))) AS i FROM
(SELECT doc_id, string_split(rpad(c, greatest(len(c), 3)::INT, ' '), '') AS l FROM (SELECT doc_id, {CLEAN} AS c FROM documents))) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY 1) USING (key)""",
    "similar_documents": f"WITH {PAIRS}, n AS (SELECT rep, count(*) AS n_links FROM (SELECT a AS rep FROM p UNION ALL SELECT b FROM p) GROUP BY 1) SELECT key AS doc_id, rep AS class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n USING (rep)",
    "similar_pairs": f"WITH {PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM p",
    "similar_titles": f"""WITH t AS (SELECT p_partkey AS key, {CLEAN} AS c FROM (SELECT *, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part)),
g AS (SELECT key, list_sort(list_distinct([c[i:i + 2] FOR i IN range(1, greatest(len(c) - 1, 2))])) AS grams FROM t), u AS MATERIALIZED (SELECT min(key) AS rep, grams, len(grams) AS n FROM g GROUP BY grams), e AS (SELECT rep, n, unnest(grams) AS gram FROM u),
x AS (SELECT l.rep AS a, r.rep AS b, count(*) / (any_value(l.n) + any_value(r.n) - count(*)) AS jaccard FROM e l JOIN e r ON l.gram = r.gram AND l.rep < r.rep GROUP BY 1, 2) SELECT a, b, round(jaccard, 6) AS jaccard FROM x WHERE jaccard >= 0.5 - 1e-12""",
    "minhash_signatures": f"WITH {CLASSES}, {SIGNED} SELECT rep, array_to_string(sig, ',') AS signature FROM v",
    "lsh_buckets": f"WITH {CLASSES}, {SIGNED} SELECT band, count(*) AS n_buckets, sum(n)::BIGINT AS n_classes, max(n) AS largest FROM (SELECT band, bucket, count(*) AS n FROM ({_band(16, 8)}) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1",
    "lsh_recall_sweep": f"WITH {PAIRS}, {SIGNED} " + " UNION ALL ".join(_sweep(b, r) for b, r in SWEEP),
    "similar_top_pairs": f"""WITH {PAIRS}, {SIGNED}, n AS (SELECT rep, count(*) AS n FROM c GROUP BY 1) SELECT a, b, round(jaccard, 6) AS jaccard, round(list_sum([(l.sig[i] = r.sig[i])::INT FOR i IN range(1, {HASHES + 1})]) / {HASHES}, 6) AS estimate, na.n AS n_a, nb.n AS n_b
FROM (SELECT * FROM p ORDER BY round(jaccard, 9) DESC, a, b LIMIT 25) p JOIN v l ON l.rep = p.a JOIN v r ON r.rep = p.b JOIN n na ON na.rep = p.a JOIN n nb ON nb.rep = p.b""",
    "s_curve": f"SELECT i / 20.0::DOUBLE AS s, c.b::BIGINT AS bands, c.r::BIGINT AS n_rows, round(1 - pow(1 - pow(i / 20.0::DOUBLE, c.r), c.b), 6) AS chance FROM range(21) t(i), (VALUES {", ".join(map(str, SWEEP))}) c(b, r)",
    "benchmark_overlap": f"""WITH i AS ({_grams("benchmark", "item_id")}), d AS ({_grams("documents", "doc_id")}), x AS (SELECT key, len(g) AS n, unnest(g) AS s FROM i), y AS (SELECT key, unnest(g) AS s FROM d)
SELECT x.key AS item_id, y.key AS doc_id, count(*) AS shared, round(count(*) / any_value(x.n), 6) AS share FROM x JOIN y USING (s) GROUP BY 1, 2 HAVING count(*) / any_value(x.n) >= 0.5""",
}
ORACLES["minhash_error_bands"] = f"""WITH {PAIRS}, {SIGNED}, g AS (SELECT jaccard AS s, ({' + '.join(f'(l.sig[{i}] = r.sig[{i}])::INT' for i in range(1, HASHES + 1))}) / {HASHES}.0::DOUBLE - jaccard AS gap FROM p JOIN v l ON l.rep = p.a JOIN v r ON r.rep = p.b)
SELECT floor(round(s * 20, 9))::BIGINT AS band, count(*) AS n_pairs, round(avg(gap), 6) AS bias, round(sqrt(avg(gap * gap)), 6) AS rms, round(avg(sqrt(greatest(s * (1 - s), 0) / {HASHES})), 6) AS law FROM g GROUP BY 1"""

"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import ann, exact, exponion, html_text, media, mixing, packing, rans, repair, secrets, simhash, toxicity, urls
from tidewheel.llm.common import table

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "flagged",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op7_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.read_blocks(spark, rans.write_blocks(table(spark, sf_dir, "documents")), with_ids=False)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 100 == 0)


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.codes(table(spark, sf_dir, "embeddings")).drop("measured")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents")).drop("known")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audits(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_url_rules": op5_url_rules,
    "op6_secrets": op6_secrets,
    "op7_token_rans": op7_token_rans,
    "op8_html_text": op8_html_text,
    "op9_mixing": op9_mixing,
    "op10_ann": op10_ann,
    "op11_exponion": op11_exponion,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversations": op13_conversations,
}


def _coding_sql(rounds: int = exponion.ROUNDS) -> str:
    """Every part against every entry; each round's sums give the next codebooks."""
    parts, entries, scale = exponion.PARTS, exponion.ENTRIES, exponion.SCALE
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"""parts AS (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))""",
        f"""c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {entries})""",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (SELECT vec_id, p, label, x, m.d AS d, m.e AS e FROM
(SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min({{'d': {far}, 'e': e}}) AS m FROM parts JOIN c{i} USING (p) GROUP BY vec_id, p))"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS (SELECT p, e, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS m FROM
(SELECT p, e, k, sum(x[k])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, len(x) + 1) t(k) GROUP BY p, e, k) GROUP BY p, e) USING (p, e))"""
            )
    return f"""WITH {", ".join(steps)},
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, book"""


EQUAL_TEXTS_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w"""

#: Costs to go, backward over the rows, then one edit a step forward. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
CONVERSATIONS_SQL = r"""WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: ord(z)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, c),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, role[1] AS c, row_number() OVER w AS pos, lag(role[1]) OVER w AS before FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM o),
r AS (SELECT conv_id, pos, role, text, c, coalesce(fault IN ('blank', 'duplicate'), false) AS d, (coalesce(fault, '') = 'truncated')::BIGINT AS t FROM f),
g AS (SELECT v.conv_id, count(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id GROUP BY v.conv_id),
b(conv_id, i, g0, g1, g2, g3) AS (SELECT conv_id, n + 1, 0::BIGINT, 4::BIGINT, 2::BIGINT, 0::BIGINT FROM g UNION ALL
SELECT conv_id, i, least(h0, 2 + h2, 4 + h3), least(h1, 2 + h2, 4 + h3), least(h2, 2 + h3, 4 + h2), least(h3, 2 + h2, 4 + h3) FROM
(SELECT b.conv_id, b.i - 1 AS i,
least(3 + g0, CASE WHEN NOT d THEN 2 + t + g2 END, CASE WHEN NOT d AND c = 's' THEN t + g1 END, CASE WHEN NOT d AND c = 'u' THEN t + g2 END) AS h0,
least(3 + g1, CASE WHEN NOT d THEN 2 + t + g2 END, CASE WHEN NOT d AND c = 'u' THEN t + g2 END) AS h1,
least(3 + g2, CASE WHEN NOT d THEN 2 + t + g3 END, CASE WHEN NOT d AND c = 'a' THEN t + g3 END) AS h2,
least(3 + g3, CASE WHEN NOT d THEN 2 + t + g2 END, CASE WHEN NOT d AND c = 'u' THEN t + g2 END) AS h3
FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.i - 1)),
l AS (SELECT conv_id, i, [g0, g1, g2, g3] AS g FROM b),
p AS (SELECT l.conv_id, l.i, l.g, q.g AS q, role, text, c, d, t FROM l LEFT JOIN l q ON q.conv_id IS NOT DISTINCT FROM l.conv_id AND q.i = l.i + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.pos = l.i),
w(conv_id, i, s, audit, turns) AS (SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM g UNION ALL
SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE nx END, audit || edit,
CASE edit WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text) ELSE list_append(turns, CASE WHEN nx = 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END FROM
(SELECT *, CASE WHEN q IS NOT NULL AND g[s + 1] = 3 + q[s + 1] THEN 'D' WHEN g[s + 1] = 2 + g[nx + 1] THEN 'I' WHEN q IS NOT NULL AND NOT d AND g[s + 1] = t + q[kept + 1] THEN 'K' WHEN q IS NOT NULL AND NOT d THEN 'R' END AS edit FROM
(SELECT w.conv_id, w.i, s, audit, turns, g, q, role, text, d, t, [2, 2, 3, 2][s + 1] AS nx, CASE WHEN c = 's' AND s = 0 THEN 1 WHEN c = 'u' AND s <> 2 THEN 2 WHEN c = 'a' AND s = 2 THEN 3 END AS kept
FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i)) WHERE edit IS NOT NULL)
SELECT g.conv_id, gaps, blank, duplicate, truncated, illegal, b.g0 AS cost, w.audit, sha256(array_to_string(w.turns, chr(10))) AS repaired_sha256 FROM g
JOIN b ON b.conv_id IS NOT DISTINCT FROM g.conv_id AND b.i = 1 JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i = g.n + 1 AND w.s IN (0, 3)"""

RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
ORACLES: dict[str, str] = {
    "op5_url_rules": f"""WITH r AS (SELECT * FROM (VALUES {RULES}) t(v, h, p)),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, m.h || m.p AS rule, coalesce(m.v, 'allow') AS verdict FROM s LEFT JOIN LATERAL
(SELECT h, p, v FROM r WHERE (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p) ORDER BY length(h) + length(p) DESC LIMIT 1) m ON true""",
    "op11_exponion": _coding_sql(),
    "op12_exact_dedup": EQUAL_TEXTS_SQL,
    "op13_conversations": CONVERSATIONS_SQL,
}

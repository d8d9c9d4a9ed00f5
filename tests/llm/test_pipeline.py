import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tests.llm.test_simhash import slow_components
from tidewheel.llm import queries, secrets


def test_stages_and_their_effects(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "secret_redaction", "source_mixing", "packing"]
    calm = stages["toxicity"](spark, docs, sf_dir).cache()
    assert calm.columns == docs.columns
    left = {r["doc_id"] for r in calm.select("doc_id").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in left for i in clean) >= 0.9 * len(clean)
    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    once = stages["simhash_dedup"](spark, calm, sf_dir).cache()
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({int(c) for _, _, c in slow_components(rows)})
    hidden = stages["secret_redaction"](spark, once, sf_dir).cache()
    before = {r["doc_id"]: r["text"] for r in once.collect()}
    prices = secrets.Prices(secrets.dictionary(once))
    assert all(r["text"] == secrets.redact(before[r["doc_id"]], prices) for r in hidden.collect())
    mixed = stages["source_mixing"](spark, hidden, sf_dir).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = stages["packing"](spark, mixed, sf_dir)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run_and_registration(spark, sf_dir):
    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.QUERIES) <= set(names) and {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, key long, mark long, copies long, stays long, own string"


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    """Null ids, texts, languages and sources, empty and long texts, repeated rows, and columns of names that stages use."""
    rows = [(i, t, ("en", None)[k % 2], ("a", "b", None)[k % 3], None, "r", 0.5, 1, 2, 3, 4, "o") for k, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, CLASHING)
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        kept, n = frame, frame.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.dtypes == docs.dtypes, name
            path = f"{tmp_path}/{name}-{n}"
            kept.write.parquet(path)
            kept = spark.read.parquet(path)
            found = sorted(kept.collect(), key=repr)
            if name == "toxicity":
                assert len(found) == n  # labels of one class reject nothing
            if name == "simhash_dedup":
                # blank texts are one component, named by the smallest id; the repeated row stays once
                assert sorted(repr(r["doc_id"]) for r in found) == (sorted(["1", "2", "5", "6", "None"]) if n else [])
            assert all((r["row"], r["key"], r["own"]) == ("r", 1, "o") for r in found)
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert bool(pieces) == bool(n) and {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept.collect()}

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidewheel.llm import common, simhash
from tidewheel.llm.components import connected_components
from tidewheel.sources import scratch


def slow_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """doc_id -> (print, component) by all pairs."""
    prints = [slow_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted((repr(doc), prints[i], repr(least[root(i)])) for i, (doc, _) in enumerate(rows))


def got(df):
    return sorted((repr(r["doc_id"]), r["fp"] & (1 << 64) - 1, repr(r["component_id"])) for r in df.collect())


def test_odd_texts(docs_of):
    assert got(simhash.near_duplicates(docs_of(ODD))) == slow_components(ODD)


def test_chains_of_near_copies(docs_of):
    rng = random.Random(3)
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(300)]
        for copy in range(12):
            rows.append((base * 100 + copy, " ".join(words)))
            words[rng.randrange(len(words))] = f"new{rng.randrange(400)}"
    want = slow_components(rows)
    assert got(simhash.near_duplicates(docs_of(rows))) == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(15)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(20)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want) > 50


def test_links_are_not_broadcast(spark):
    """Keys are 68 times the rows that Spark sizes them by, so the driver would hold far more than the threshold."""
    prints = spark.range(200).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    found = simhash.links(prints.select("fp"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_one_of_each_stays(docs_of):
    rows = [*ODD, (9, "Plain words, twice: plain words.")]
    docs = docs_of(rows)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {}
    for doc, _, component in slow_components(rows):
        want.setdefault(component, []).append(doc)
    assert sorted(repr(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(want)


def test_empty_table(docs_of):
    none = docs_of(ODD).where(F.lit(False))
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one_of_each(none).count() == 0


def test_long_texts_count_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole == slow_print(text.decode())
    assert isinstance(whole, int) and np.uint64(whole) == whole


@pytest.mark.parametrize("text", ["a", "a b", "A B C", "é b c d"])
def test_short_texts(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_tables_of_rounds_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert connected_components(edges, "a", "b").where("root != 0").count() == 0
    assert len(list(tmp_path.glob("components-*"))) == 1


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (1, "a b c d", 5, 6, 7), (2, "a b c d", 8, 9, 0), (3, "x y z", 1, 2, 3)], "doc_id long, text string, key int, stays int, row int")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d", 5, 6, 7), (3, "x y z", 1, 2, 3)]


def test_a_shared_folder_is_asked_for_on_clusters(monkeypatch):
    class Session:
        def __init__(self, **conf):
            self.values = conf
            self.conf = self

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    with pytest.raises(ValueError):
        common.shared_dir(Session(**{"spark.master": "spark://host:7077"}))
    assert common.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:/x/"})) == "hdfs:/x"
    local = Session(**{"spark.master": "local[2]"})
    assert common.shared_dir(local) == common.shared_dir(local)

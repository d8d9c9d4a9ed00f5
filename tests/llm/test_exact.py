import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import assert_same, connection
from tests.llm.conftest import ODD
from tidewheel.llm import exact, fuse, queries

DROP = str.maketrans("", "", " \t\n\x0b\x0c\r")


def slow(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(DROP)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = (t or "").translate(DROP)
        keep = min(groups[norm])[3]
        out.append((i, keep, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def results(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)


MANY = [(100 + i, f"text {i % 40}" + " " * (i % 7)) for i in range(400)] + [(900 + i, "the same hot text") for i in range(300)]


@pytest.mark.parametrize("shard", [1 << 16, 8])
def test_equals_brute_force(docs_of, monkeypatch, shard):
    monkeypatch.setattr(exact, "SHARD", shard)
    rows = [*ODD, *MANY]
    found = exact.duplicates(docs_of(rows))
    assert results(found) == slow(rows)
    kept = found.where("kept").collect()
    groups = {(t or "").translate(DROP) for _, t in rows}
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)  # one of each, of repeated rows too
    assert found.where("known").count() > 0


def test_texts_are_compared_in_a_shuffle_too(docs_of, monkeypatch):
    monkeypatch.setattr(exact, "FEW", 0)
    assert results(exact.duplicates(docs_of(MANY))) == slow(MANY)


def test_empty_table(docs_of):
    assert exact.duplicates(docs_of(ODD).where(F.lit(False))).count() == 0


def test_colliding_digests_are_told_apart_by_bytes(docs_of, monkeypatch):
    """With a digest of the length alone all texts of one length meet in a bucket, and only equal ones become one."""
    whole = F.xxhash64
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if len(c) == 1 else whole(*c))
    assert results(exact.duplicates(docs_of(MANY))) == slow(MANY)


def test_a_batch_against_a_snapshot(docs_of):
    old, new = docs_of([(1, "alpha beta"), (2, "gamma"), (3, "alphabeta ")]), docs_of([(4, "al pha beta and"), (5, "gam  ma"), (6, "delta"), (7, "delta")])
    snapshot = exact.freeze(old, exact.digests(old))
    rows = {r["stay"]["doc_id"]: r for r in exact.admitted(snapshot, new, exact.digests(new)).collect()}
    assert set(rows) == {4, 5, 6}
    assert rows[5]["known"] and rows[5]["old_stay"]["doc_id"] == 2 and rows[5]["old_n"] == 1
    assert not rows[4]["known"] and not rows[6]["known"] and rows[6]["n"] == 2


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400))
def test_filters_hold_their_keys(keys):
    held = np.array(sorted(keys), dtype=np.int64)
    assert fuse.build(held).holds(held).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 100_000])
def test_filters_are_small_and_seldom_wrong(n):
    rng = np.random.default_rng(n)
    held = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
    made = fuse.build(held)
    others = rng.integers(-(2**63), 2**63 - 1, 200_000)
    assert made.holds(held).all() and made.holds(others).mean() < 1.5 / 256
    assert n < 1000 or len(made.slots) < 1.5 * n
    assert n < 100_000 or len(made.slots) < 1.2 * n


def test_equals_sql(spark, sf_dir):
    assert_same(queries.op12_exact_dedup(spark, sf_dir), connection(sf_dir), queries.ORACLES["op12_exact_dedup"])

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import assert_same, connection
from tidewheel.llm import exponion, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double"


def brute(rows, parts=exponion.PARTS, entries=exponion.ENTRIES, rounds=exponion.ROUNDS):
    """(vec_id, label) -> (code, error) by measuring every entry, in Python integers."""
    whole = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not whole:
        return [], []
    width = len(whole[0][1]) // parts
    vectors = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in whole]
    order = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0, vectors[k]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            near = [min((sum((a - b) ** 2 for a, b in zip(v[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)]
            out.append(([e for _, e in near], sum(d for d, _ in near)))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, (code, _) in zip(cut, found, strict=True) if code[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, lab, bytes(code).hex(), error) for (i, _, lab), (code, error) in zip(whole, assign(), strict=True)], books


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 0.5) for i, v, lab in rows], SCHEMA)


def results(spark, rows):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in exponion.codes(table(spark, rows)).collect()), key=repr)


def wanted(rows):
    found, _ = brute(rows)
    sums = {}
    for _, lab, _, error in found:
        sums[lab] = sums.get(lab, 0) + error
    return sorted(((i, code, error, sums[lab]) for i, lab, code, error in found), key=repr)


@pytest.mark.parametrize("n", [1, 40, 300])
def test_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, 32))
    rows = [(i, (centres[i % 9] + 0.3 * rng.normal(size=32)).astype(np.float32).tolist(), (None, 1, 2)[i % 3]) for i in range(n)]
    rows += [(n + i, r[1], r[2]) for i, r in enumerate(rows[: n // 4])]  # repeated vectors, ties
    assert results(spark, rows) == wanted(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    fine = [0.5, -0.001] * 16
    rows = [(1, fine, 1), (1, fine, 1), (None, [0.25] * 32, None), (3, None, 1), (4, [], 1), (5, [inf] * 32, 1), (6, [nan] * 32, 1), (7, [None] * 32, 2), (8, [3e38] * 16 + [-3e38] * 16, 2)]
    found = exponion.codes(table(spark, rows))
    got = {(r["vec_id"], r["error"]) for r in found.collect()}
    assert {i for i, _ in got} == {1, None, 8} and found.count() == 4 and all(e >= 0 for _, e in got)
    short = exponion.codes(table(spark, [*rows, (9, [1.0], 1)]))
    assert sorted(short.collect(), key=repr) == sorted(found.collect(), key=repr)  # another length takes no part
    assert exponion.codes(table(spark, [(1, [0.5] * 5, 1), (2, [1.5] * 5, 1)])).count() == 2  # filled up
    assert exponion.codes(table(spark, rows).where(F.lit(False))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 64), st.integers(1, 5), st.integers(0, 3))
def test_nearest_measures_few_and_misses_none(seed, entries, width, spread):
    rng = np.random.default_rng(seed)
    book = rng.integers(-(4**spread), 4**spread + 1, (entries, width))
    x = rng.integers(-(4**spread), 4**spread + 1, (50, width))
    before = rng.integers(0, entries, 50)
    best, least, seen = exponion.nearest(x, before, book, *exponion.neighbours(book))
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, far.argmin(axis=1)) and np.array_equal(least, far.min(axis=1)) and seen.max() <= entries


def test_clustered_parts_are_measured_against_few(spark):
    rng = np.random.default_rng(5)
    centres = 20 * rng.normal(size=(64, 16))
    rows = [(i, (centres[i % 64] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(640)]
    measured = exponion.codes(table(spark, rows)).agg(F.avg("measured")).first()[0]
    assert measured < 0.25 * exponion.PARTS * exponion.ENTRIES


def test_equals_sql(spark, sf_dir):
    assert_same(queries.op11_exponion(spark, sf_dir), connection(sf_dir), queries.ORACLES["op11_exponion"])

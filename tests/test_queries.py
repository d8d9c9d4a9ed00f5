import pytest

from tests.compare import assert_same, connection
from tidewheel.oracle import ORACLES
from tidewheel.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_equals_sql(name, spark, sf_dir, con):
    assert_same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def shares(*names):
    return lambda rows: all(0 <= r[n] <= 1 for r in rows for n in names if r[n] is not None)


def placed(rows):
    by_place = sorted(rows, key=lambda r: r["place"])
    return [r["place"] for r in by_place] == list(range(1, len(rows) + 1)) and all(a["average_precision"] >= b["average_precision"] - 1e-6 for a, b in zip(by_place, by_place[1:], strict=False))


def parted(rows):
    return all(abs(r["error"] - r["bias2"] - r["variance"]) < 1e-3 * max(1, r["error"]) for r in rows)


#: What has to hold for the rows of a query that SQL cannot express.
HOLDS = {
    "logistic_scores": shares("probability"),
    "table_scores": shares("probability"),
    "stacking": shares("probability", "p_logistic", "p_forest", "p_boosted", "p_bayes"),
    "model_tournament": placed,
    "hyperparameter_search": placed,
    "family_search": lambda rows: placed(rows) and len(rows) == 37,
    "gbt_importance": lambda rows: abs(sum(r["importance"] for r in rows) - 1) < 1e-6 and min(r["importance"] for r in rows) >= 0,
    "anomaly_scores": shares("anomaly"),
    "isolation_forest": lambda rows: all(0 < r["anomaly"] < 1 for r in rows) and len({r["c_custkey"] for r in rows}) == len(rows),
    "clt_sampling": lambda rows: all(0.5 < r["observed"] / r["law"] < 2 for r in rows if r["n_samples"] >= 30),
    "bias_variance": parted,
    "resampled_polynomials": lambda rows: parted(rows) and {r["degree"] for r in rows} == set(range(1, 16)),
    "mixture_criteria": lambda rows: [r["bic"] for r in rows if r["chosen"]] == [min(r["bic"] for r in rows)],
    "k_sweep": lambda rows: all(-1 <= r["silhouette"] <= 1 and r["unanimous"] == (r["votes"] == 3) for r in rows) and sum(r["votes"] for r in rows) == 3,
    "direct_steps": lambda rows: {r["step"] for r in rows} == set(range(1, 13)) and all(r["mae"] > 0 for r in rows),
    "ward_clusters": lambda rows: [r["n"] for r in sorted(rows, key=lambda r: r["ward"])] == sorted((r["n"] for r in rows), reverse=True) and len(rows) == 4,
    "unit_roots": lambda rows: shares("adf_p")(rows) and all(0.01 <= r["kpss_p"] <= 0.1 for r in rows if r["kpss_p"] is not None),
    "decomposition": shares("trend_strength", "season_strength"),
    "decomposition_parts": lambda rows: all(abs(r["values"] - r["trend"] - r["season"] - r["rest"]) < 1e-3 for r in rows),
    "leak_inflation": lambda rows: all(abs(r["leaked"] - r["clean"] - r["gain"]) < 1e-5 for r in rows),
    "reweighting_ablation": shares("average_precision", "roc_auc", "brier"),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"smoothed_forecast"}))
def test_models_give_rows(name, spark, sf_dir):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and HOLDS.get(name, bool)(rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

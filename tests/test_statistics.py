"""Special functions against table values; statistics against small hand-made samples."""

import math

import pytest

from veritab.functions import special as sp
from veritab.operators import statistics as st


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (sp.t_two_sided(2.228139, 10), 0.05), (sp.t_two_sided(1.959964, 1e7), 0.05), (sp.f_tail(4.102821, 2, 10), 0.05), (sp.chi2_tail(3.841459, 1), 0.05),
        (sp.chi2_tail(18.307038, 10), 0.05), (sp.normal_two_sided(1.959964), 0.05), (sp.beta_inc(2, 3, 0.5), 0.6875), (sp.gamma_q(1, 2), math.exp(-2)),
    ],
)
def test_tails(got, want):
    assert got == pytest.approx(want, rel=1e-5)


def test_exact_mann_whitney():
    assert sp.mann_whitney_p(0, 3, 3, 0) == pytest.approx(0.1)
    assert sp.mann_whitney_p(4, 4, 5, 0) == pytest.approx(0.19047619, rel=1e-6)


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 5, 6)] + [("b", float(x)) for x in (11, 12, 13, 14, 15, 16)] + [("c", 6.0), ("c", 6.0), (None, 1.0), ("d", 2.0)]
    return spark.createDataFrame(rows, "g string, x double")


def test_groups(groups):
    two = groups.where("g in ('a', 'b')")
    w = st.welch(two, "x", "g", "a", "b").first()
    assert w["p"] == pytest.approx(sp.t_two_sided(w["t"], w["df"])) and st.mann_whitney(two, "x", "g", "a", "b").first()["p"] == pytest.approx(2 / 924)
    assert [n for n, _ in st.compare_groups(two, "x", "g")] == ["welch", "mann_whitney"] and [n for n, _ in st.compare_groups(groups, "x", "g")] == ["anova", "kruskal", "posthoc"]
    assert st.compare_groups(groups.where("g = 'a'"), "x", "g") == [] and st.anova(groups.where("g = 'a'"), "x", "g").first()["p"] is None
    assert w["t"] == pytest.approx(-9.258201) and w["df"] == pytest.approx(10.0) and w["cohens_d"] < -5
    f = st.anova(two, "x", "g").first()
    assert f["f"] == pytest.approx(w["t"] ** 2) and f["df_within"] == 10
    u = st.mann_whitney(two, "x", "g", "a", "b").first()
    assert (u["u"], u["n_a"], u["n_b"], u["ties"]) == (0.0, 6, 6, 0.0)
    assert st.kruskal(two, "x", "g").first()["h"] == pytest.approx(8.307692)
    pairs = st.posthoc_pairs(groups, "x", "g").collect()
    assert [(p["a"], p["b"]) for p in pairs] == [("a", "b"), ("a", "c"), ("b", "c")] and all(p["p_adjusted"] >= p["p"] for p in pairs)


def test_chi_squared(spark):
    df = spark.createDataFrame([("n", "x")] * 10 + [("s", "y")] * 20 + [(None, "y")], "a string, b string")
    r = st.chi_squared(df, "a", "b").first()
    assert r["chi2"] == pytest.approx(30.0) and r["df"] == 1 and r["cramers_v"] == pytest.approx(1.0)


def test_descriptive_and_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)] + [(None,), (float("nan"),)], "x double")
    r = st.descriptive(df, ["x"]).first()
    assert (r["n"], r["median"], r["mean"]) == (4, 2.5, 4.0) and r["skewness"] == pytest.approx(1.763632) and r["kurtosis"] == pytest.approx(3.228)
    h = st.histogram(df, ["x"]).collect()
    assert sum(b["count"] for b in h) == 4 and h[0]["low"] == 1.0 and max(b["high"] for b in h) == 10.0
    same = st.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"]).collect()
    assert len(same) == 1 and same[0]["count"] == 2


def test_correlation_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 6.0, 7.0), (None, 1.0, 7.0)], "a double, b double, c double")
    m = {(r["a"], r["b"]): r["r"] for r in st.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert m["a", "b"] == pytest.approx(1.0) and m["a", "c"] is None
    assert sp.fisher_interval(0.5, 28)[0] == pytest.approx(0.1558, abs=1e-3) and sp.fisher_interval(0.5, 3) is None


def test_trend(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}-01", float(m)) for m in range(1, 13)], "d string, v double")
    assert st.seasonality(df, "v", "d").first()["verdict"] == "seasonal"
    assert st.seasonality(df.limit(3), "v", "d").first()["verdict"] == "insufficient_data"
    assert [r["rolling_mean"] for r in st.rolling_mean(df, "v", "d").orderBy("period").limit(3).collect()] == [1.0, 1.5, 2.0]

"""Property tests: exact quantiles and average-tie ranks equal pandas on random data."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowlens.operators.ranking import exact_quantiles, ranked_values
from flowlens.operators.union import align_features, canonical_feature_order

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values, p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.8, 1.0]))
def test_quantile_and_rank_match_pandas(spark, xs, p):
    _check(spark, xs, p)


def _check(spark, xs, p):
    pdf = pd.DataFrame({"x": pd.Series(xs, dtype="float64")})
    df = spark.createDataFrame([(v,) for v in xs], "x double")
    got = {r.p: r.value for r in exact_quantiles(df, ["x"], [p]).collect()}
    if pdf["x"].notna().any():
        assert abs(got[p] - pdf["x"].quantile(p)) <= 1e-9 * max(1.0, abs(pdf["x"].quantile(p)))
        r = ranked_values(df, ["x"]).toPandas()
        pct = dict(zip(r.v, (r.n_below + (r.n + 1) / 2) / r.n_total))
        assert np.allclose(pdf["x"].dropna().map(pct), pdf["x"].rank(pct=True).dropna())
    else:
        assert got == {}


def test_selection_is_exact_at_every_sketch_accuracy(spark):
    """Coarse sketches and tiny lists force widening and many narrowing scans; answers stay exact."""
    from flowlens.operators.selection import quantile_table

    rng = np.random.default_rng(0)
    n = 4000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "ties": rng.integers(0, 50, n).astype(float), "none": np.nan, "one": 3.0,
                        "hot": np.where(rng.random(n) < 0.33, 5.0, rng.normal(5, 1, n)), "wide": rng.lognormal(3, 4, n)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(4)
    probs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    for accuracy, inside in ((10_000, 65_536), (200, 20), (100, 1)):
        got = quantile_table(df, list(pdf.columns), probs, accuracy=accuracy, inside=inside)
        assert got["none"] == {}
        for c in pdf.columns.drop("none"):
            for p in probs:
                assert abs(got[c][round(p, 12)] - pdf[c].quantile(p)) <= 1e-12 * max(1.0, abs(pdf[c].quantile(p))), (c, p)
    for m in (1, 2, 3, 5):
        head = pdf.dropna(subset=["a"]).head(m)
        got = quantile_table(spark.createDataFrame(head), ["a", "ties"], {"a": probs, "ties": [0.5]})
        assert all(abs(got["a"][round(p, 12)] - head["a"].quantile(p)) < 1e-12 for p in probs)
        assert list(got["ties"]) == [0.5]


def test_canonical_alignment(spark):
    order = canonical_feature_order()
    assert len(order) == 90 and order[0] == "duration" and order[40] == "dst_host_srv_rerror_rate"
    assert order[41] == "feature_41"
    df = spark.createDataFrame([(1.5, None)], "duration double, src_bytes double")
    row = align_features(df).first()
    assert row["duration"] == 1.5 and row["src_bytes"] == 0.0 and row["feature_89"] == 0.0
    assert len(row) == 90

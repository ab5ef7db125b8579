"""Hand-made cases with values written out (nulls, ties, constants, unseen values, edges)."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.operators import evaluate as EV
from flowlens.operators import features as FE
from flowlens.operators import preprocess as PP
from flowlens.operators import projection as PR
from flowlens.operators.ranking import exact_quantiles

LABELS = ["normal", " NORMAL ", "abnormal", "10", "0", "false", None]


def _labels(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(LABELS)], "i int, lab string")


def test_binary_estimated_and_is_attack_labels(spark):
    rows = _labels(spark).select(
        "i", L.binary_label("lab", "normal").alias("b"), L.estimated_label("lab").alias("e"),
        L.is_attack("lab").alias("a")).orderBy("i").collect()
    assert [r.b for r in rows] == [0, 0, 0, 1, 1, 1, 1]
    assert [r.e for r in rows] == [0, 0, 0, 0, 0, 0, 1]
    assert [r.a for r in rows] == [False, False, False, True, True, True, True]


def test_category_rule_order(spark):
    df = spark.createDataFrame([("ipsweep",), ("Web Attack – Brute Force",), ("DoS",), ("Heartbleed",),
                                ("buffer_overflow",), ("zero_day",)], "lab string")
    out = df.select("lab", L.kdd_category("lab").alias("k"), L.cic_category("lab").alias("c"),
                    L.unsw_category("lab").alias("u"), L.unsw_category("lab", strict=True).alias("us")).collect()
    got = {r.lab: (r.k, r.c, r.u, r.us) for r in out}
    assert got["ipsweep"][0] == "Probe"            # not U2R although it contains 'ps'
    assert got["Web Attack – Brute Force"][1] == "BruteForce"
    assert got["DoS"][1] == "DoS"
    assert got["Heartbleed"][1] == "Other"
    assert got["buffer_overflow"][0] == "U2R"
    assert got["zero_day"][0] == "Other"
    assert got["DoS"][2] == "DoS" and got["DoS"][3] == "Other"


def test_exact_quantiles_even_odd_null_constant(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, None, 5.0), (2.0, 2.0, None, 5.0), (3.0, 3.0, None, 5.0), (4.0, None, None, 5.0)],
        "even double, odd double, nulls double, const double")
    q = {(r.column, r.p): r.value for r in exact_quantiles(df, ["even", "odd", "nulls", "const"], [0.25, 0.5]).collect()}
    assert q[("even", 0.5)] == 2.5
    assert q[("odd", 0.5)] == 2.0
    assert q[("even", 0.25)] == 1.75
    assert ("nulls", 0.5) not in q
    assert q[("const", 0.5)] == 5.0


def test_preprocessor_modes_cardinality_unseen_and_constant(spark):
    rows = [(i, "a" if i % 4 < 2 else "b", f"v{i}", f"w{i % 100}", 7.0, float(i) if i % 2 else None)
            for i in range(400)]
    df = spark.createDataFrame(rows, "id int, tie string, hi string, ok string, const double, half double")
    model = PP.Preprocessor(passthrough=["id"]).fit(df)
    st = model.state
    assert st["modes"]["tie"] == "a"                 # a,a,b,b -> smallest of the tied values
    assert "hi" in st["dropped"] and "ok" not in st["dropped"]   # 400 vs 100 distinct
    assert st["medians"]["half"] == 200.0            # odd ids 1..399
    new = spark.createDataFrame([(1, "zzz", "x", "w1", 7.0, None)], df.schema)
    out = model.transform(new, scale=False).first()
    assert out["tie"] == 2.0                         # unseen -> number of categories
    assert out["half"] == 200.0
    scaled = model.transform(df).agg(F.max(F.abs("const"))).first()[0]
    assert scaled == 0.0                             # zero std divides by 1


def test_percentile_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, 3.0)], "id int, x double")
    out = {r.id: r.x_percentile for r in FE.percentile_ranks(df, ["x"]).collect()}
    assert out == {1: 0.25, 2: 0.625, 3: 0.625, 4: None, 5: 1.0}


def test_robust_and_quintiles_on_constant(spark):
    df = spark.createDataFrame([(i, 3.0, 3.0) for i in range(150)], "id int, duration double, y double")
    model = FE.FeatureEngineer(exclude=["id"]).fit(df)
    row = model.transform(df, with_percentile=False).first()
    assert row["duration_robust_scaled"] is None     # IQR 0
    assert row["duration_binned"] is None            # one edge left
    assert row["duration_zscore"] is None            # std 0


def test_byte_entropy_mass_at_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 1.0)] * 50, "src_bytes double, flat_bytes double")
    ent = FE.FeatureEngineer(exclude=[]).fit(df).state["entropies"]
    assert abs(ent["src_bytes_entropy"] - 1.0) < 1e-6
    assert "flat_bytes_entropy" not in ent           # one distinct value


def test_confusion_and_report_with_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (0, 3)], "y int, p int")
    cm = {(r.y, r.p): r.n for r in EV.confusion_matrix(df, "y", "p").collect()}
    assert len(cm) == 16 and cm[(2, 2)] == 0 and cm[(0, 3)] == 1
    rep = {r.label: r for r in EV.class_report(EV.confusion_matrix(df, "y", "p")).collect()}
    assert rep["2"].precision == 0.0 and rep["2"].recall == 0.0     # never predicted
    assert rep["3"].recall == 0.0 and rep["3"].support == 0          # never true
    assert rep["1"].precision == 0.5 and rep["1"].recall == 1.0


@pytest.mark.parametrize("scores,expected", [([0.5, 0.5, 0.5, 0.5], 0.5), ([0.1, 0.2, 0.8, 0.9], 1.0),
                                             ([0.9, 0.8, 0.2, 0.1], 0.0)])
def test_auc_equal_perfect_inverted(spark, scores, expected):
    df = spark.createDataFrame([(0, scores[0]), (0, scores[1]), (1, scores[2]), (1, scores[3])], "y int, s double")
    assert EV.auc(df, F.col("y") == 1, "s").first()["auc"] == expected


def test_roc_points_and_threshold(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    pts = {r.threshold: (r.fpr, r.tpr) for r in EV.roc_points(df, F.col("y") == 1, "s").collect()}
    assert pts[0.8] == (0.0, 0.5) and pts[0.4] == (0.5, 0.5) and pts[0.35] == (0.5, 1.0) and pts[0.1] == (1.0, 1.0)


def test_packet_feature_parsing(spark):
    df = spark.createDataFrame([({"a": "abc", "b": "nan", "c": "inf", "d": " 7 "},)], "m map<string,string>")
    r = PR.packet_features(df, "m", ["a", "b", "c", "d", "missing"]).first()
    assert r.a == 0.0 and math.isnan(r.b) and r.c == float("inf") and r.d == 7.0 and r.missing == 0.0


def test_fill_zero_and_inf_to_null(spark):
    df = spark.createDataFrame([(None, float("nan"), float("inf"), "s")], "a int, b double, c double, s string")
    z = PR.fill_zero(df).first()
    assert z.a == 0 and z.b == 0.0 and z.c == float("inf") and z.s == "s"
    n = PR.nonfinite_to_null(df).first()
    assert n.b is None and n.c is None


def test_label_discovery_exact_and_alternative(spark):
    from flowlens.operators import labelling as LB

    df = spark.createDataFrame([(1, "x", "y")], "id int, Attack_Label string, Class string")
    assert LB.find_exact_label(df) == "Class"           # LB5: exact lower-case name
    assert LB.find_alt_label(df) == "Attack_Label"      # LB2: first name containing label/attack/target


def test_feature_families_only_when_inputs_exist(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(120)], "src_bytes double, serror_rate double")
    out = FE.FeatureEngineer(exclude=[]).fit(df).transform(df, with_percentile=False)
    cols = set(out.columns)
    assert "bytes_per_seconds" not in cols and "duration_log" not in cols      # no duration column
    assert "total_error_rate" not in cols                                      # pair incomplete
    assert "bytes_ratio" not in cols                                           # no dst_bytes
    assert "src_bytes_zscore" in cols and "src_bytes_entropy" in cols


def test_taxonomy_join_folds_web_attack_dashes(spark):
    from flowlens import config as C
    from flowlens.operators import labelling as LB

    df = spark.createDataFrame([("Web Attack - XSS",), ("Web Attack – Sql Injection",), ("Web Attack � Brute Force",),
                                ("BENIGN",), ("Heartbleed",), ("DDoS",)], "Label string")
    tax = LB.taxonomy_table(spark, {"cic": C.CIC_TAXONOMY})
    got = {r.Label: r.family for r in LB.apply_taxonomy(df, "Label", "cic", tax, "benign").collect()}
    assert got["Web Attack - XSS"] == "R2L"
    assert got["Web Attack – Sql Injection"] == "R2L"
    assert got["Web Attack � Brute Force"] == "R2L"
    assert got["BENIGN"] == "Normal" and got["Heartbleed"] == "Other" and got["DDoS"] == "DDoS"


def test_rank_machinery_with_a_hot_value_and_keys(spark):
    """One value holds a third of the rows; ranks, quantiles and keyed running sums stay exact."""
    import numpy as np
    import pandas as pd

    from flowlens.operators.ranking import cumulative_by_value, ranked_values

    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(3000, 42.0), rng.normal(40, 10, 6000)])
    pdf = pd.DataFrame({"x": x, "g": np.where(np.arange(9000) % 2 == 0, "a", "b")})
    df = spark.createDataFrame(pdf)
    r = ranked_values(df, ["x"]).toPandas()
    pct = dict(zip(r.v, (r.n_below + (r.n + 1) / 2) / r.n_total))
    assert np.allclose(pdf["x"].map(pct), pdf["x"].rank(pct=True))
    q = {row.p: row.value for row in exact_quantiles(df, ["x"], [0.1, 0.5, 0.9]).collect()}
    for p in (0.1, 0.5, 0.9):
        assert abs(q[p] - pdf["x"].quantile(p)) < 1e-9
    agg = df.groupBy("g", "x").count()
    cum = cumulative_by_value(agg, ["g"], "x", ["count"]).toPandas()
    for g, part in cum.groupby("g"):
        part = part.sort_values("x")
        assert (part["count_below"].to_numpy() == np.concatenate([[0], np.cumsum(part["count"])[:-1]])).all()


def test_percentile_rank_long_join_equals_per_column_joins(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i % 3), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    by_col = {r.id: r for r in FE.percentile_ranks(df, ["a", "b", "c"]).collect()}
    long = {r.id: r for r in FE.percentile_ranks(df, ["a", "b", "c"], key="id").collect()}
    # Beyond the broadcast threshold the columns share one join and one regroup by key.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 200)
    try:
        shuffled = {r.id: r for r in FE.percentile_ranks(df, ["a", "b", "c"], key="id").collect()}
        each = {r.id: r for r in FE.percentile_ranks(df, ["a", "b", "c"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert by_col == long == shuffled == each
    assert by_col[3]["b_percentile"] is not None and by_col[5]["b_percentile"] is None


def test_full_feature_set_reuses_ranks_without_changing_them(spark):
    from flowlens.plans import q_features as QF

    fe = QF.fe_frame(spark, "/root/testdata/sf0.001")
    full = FE.create_advanced_features(fe, exclude=["flow_id", "unified_label"], key="flow_id", **QF.COLUMNS)
    alone = FE.percentile_ranks(fe.select("flow_id", *QF.STAT), QF.STAT, key="flow_id")
    cols = [f"{c}_percentile" for c in QF.STAT]
    a = full.select("flow_id", *cols).exceptAll(alone.select("flow_id", *cols)).count()
    b = alone.select("flow_id", *cols).exceptAll(full.select("flow_id", *cols)).count()
    assert a == 0 and b == 0 and full.count() == 1000


def test_roc_thinning_keeps_endpoints_and_bounds_size(spark):
    rows = [(i % 2, (i * 37 % 101) / 100.0) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    full = {r.threshold: (r.fpr, r.tpr) for r in EV.roc_points(df, F.col("y") == 1, "s").collect()}
    thin = {r.threshold: (r.fpr, r.tpr) for r in EV.roc_points(df, F.col("y") == 1, "s", max_points=10).collect()}
    assert len(thin) <= 11 and min(thin) == min(full) and thin[min(thin)] == (1.0, 1.0)
    assert all(full[t] == v for t, v in thin.items())


def test_ranks_within_several_keys(spark):
    import numpy as np

    from flowlens.operators import ranking

    rows = [(f"k{i % 3}", float((i * 7919) % 101), 1) for i in range(600)]
    agg = spark.createDataFrame(rows, "k string, v double, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    cum = ranking.cumulative_by_value(agg, ["k"], "v", ["n"]).toPandas()
    for _, part in cum.groupby("k"):
        part = part.sort_values("v")
        assert (part["n_below"].to_numpy() == np.concatenate([[0], np.cumsum(part["n"])[:-1]])).all()
        assert (part["n_total"] == part["n"].sum()).all()


def test_feature_columns_do_not_depend_on_the_number_of_rows(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(300)], "src_bytes double, y double")
    cols = [FE.create_advanced_features(d).columns for d in (df, df.limit(3))]
    assert cols[0] == cols[1] and "y_zscore" in cols[0]


def test_forest_sample_does_not_depend_on_layout(spark):
    from flowlens.operators import anomaly as AD

    df = spark.range(3000).selectExpr("id", "double(id % 97) AS a", "double((id * 31) % 53) AS b")
    trees = [AD.fit_isolation_forest(df.repartition(n), ["a", "b"], "id", n_trees=3, psi=32)["trees"] for n in (1, 7)]
    key = lambda t: t["tree"]
    assert sorted(trees[0], key=key) == sorted(trees[1], key=key)


def test_fitted_state_survives_saving(spark):
    from flowlens.operators.preprocess import Preprocessor, PreprocessorModel
    from flowlens.plans import q_features as QF
    from flowlens.session import scratch_path

    fe = QF.fe_frame(spark, "/root/testdata/sf0.001")
    for model in (FE.FeatureEngineer(exclude=["flow_id", "unified_label"], **QF.COLUMNS).fit(fe),
                  Preprocessor(passthrough=["flow_id", "unified_label"]).fit(fe)):
        path = scratch_path(spark, "fitted-state")
        model.save(spark, path)
        again = type(model).load(spark, path)
        extra = {"with_percentile": False} if isinstance(model, FE.FeatureModel) else {}
        a, b = model.transform(fe, **extra), again.transform(fe, **extra)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0
    assert isinstance(again, PreprocessorModel)

"""Plan-shape guards for the scale properties documented in PLANS.md."""

import io
import re
from contextlib import redirect_stdout

import pytest

from flowlens.plans import registry

from paths import SF_SMALL

registry.load_all()


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_time_window_reaches_the_scan_and_columns_are_pruned(spark):
    text = _plan(registry.QUERIES["AL6_last_24_hours"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,", text)
    schemas = re.findall(r"ReadSchema: (.*)", text)
    assert schemas and all("user_id" not in s and "props" not in s for s in schemas)


def test_preprocessing_transform_is_a_projection(spark):
    from flowlens.operators.preprocess import Preprocessor
    from flowlens.plans.q_prep import PASS, base

    b = base(spark, SF_SMALL)
    text = _plan(Preprocessor(passthrough=PASS).fit(b).transform(b))
    assert " Exchange" not in text and "Join" not in text and "Window" not in text


@pytest.mark.parametrize("name", ["AL6_hourly_traffic", "PP7_preprocess_pipeline", "FE3_percentile_rank",
                                  "SP1_stratified_split", "EV5_binary_auc", "DR7_baseline_deviation"])
def test_sql_expressible_queries_stay_in_the_jvm(spark, name):
    text = _plan(registry.QUERIES[name](spark, SF_SMALL))
    assert not re.search(r"\) (MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython)", text)


@pytest.mark.parametrize("name", ["AL9_monitoring_report", "EV10_model_comparison", "AL3_counters"])
def test_no_cartesian_products(spark, name):
    text = _plan(registry.QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

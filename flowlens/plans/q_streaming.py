"""Streaming queries (ST1-ST6): each runs a checkpointed stream over the events table to
completion and returns what its sink holds; the twin is the batch SQL of the same logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.functions import labels as L
from flowlens.operators import scoring as S
from flowlens.plans.q_alerts import ALERTS_SQL, ATTACK_SQL, SCORED_SQL
from flowlens.plans.registry import query
from flowlens.session import scratch_path
from flowlens.sources import tables
from flowlens.streaming import state as STATE
from flowlens.streaming import stream as ST

def scorer(df):
    """The decision used on the stream: fixed score p_c through the 0.55 rule, KDD type."""
    return S.threshold_rule(df, "p_c", C.ATTACK_THRESHOLD).withColumn("attack_type", L.kdd_category("target"))


def scored_stream(spark, sf_dir):
    """The events table read as a stream and scored; nothing is copied first."""
    return ST.score_stream(tables.scored_flows(spark, sf_dir, tables.event_stream(spark, sf_dir)), scorer)


def ntz(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns])


@query("ST1_stream_scoring", f"WITH {SCORED_SQL} SELECT flow_id, ts, is_attack, confidence, attack_type FROM scored")
def st1(spark, sf_dir):
    out, ck = scratch_path(spark, "st1-out"), scratch_path(spark, "st1-ck")
    scored = scored_stream(spark, sf_dir)
    ST.run_available_now(scored.select("flow_id", "ts", "is_attack", "confidence", "attack_type"), ck, out)
    return ntz(spark.read.parquet(out), "ts")


@query("ST2_alert_sink", ALERTS_SQL + "SELECT * FROM alerts")
def st2(spark, sf_dir):
    out, ck = scratch_path(spark, "st2-out"), scratch_path(spark, "st2-ck")
    alerts = ST.alert_stream(scored_stream(spark, sf_dir))
    ST.run_available_now(alerts, ck, out)
    return ntz(spark.read.parquet(out), "ts")


@query("ST3_periodic_stats", f"""WITH {SCORED_SQL}
SELECT time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS total,
       cast(sum(CAST(is_attack AS int)) AS bigint) AS attacks FROM scored GROUP BY 1""")
def st3(spark, sf_dir):
    out, ck = scratch_path(spark, "st3-out"), scratch_path(spark, "st3-ck")
    scored = scored_stream(spark, sf_dir)

    def per_batch(batch, batch_id):
        ST.batch_writer(out)(ST.periodic_stats(batch), batch_id)

    ST.run_available_now(scored, ck, batch_fn=per_batch)
    return ntz(ST.merge_periodic(spark, out), "window_start")


@query("ST4_running_totals", f"""WITH {SCORED_SQL}
SELECT count(*) AS total, cast(sum(CAST(is_attack AS int)) AS bigint) AS attacks,
       cast(count(*) - sum(CAST(is_attack AS int)) AS bigint) AS normal FROM scored""")
def st4(spark, sf_dir):
    out, ck = scratch_path(spark, "st4-out"), scratch_path(spark, "st4-ck")
    totals = ST.running_totals(scored_stream(spark, sf_dir))
    ST.run_available_now(totals, ck, mode="complete", batch_fn=ST.batch_writer(out))
    return ST.latest_batch(spark, out)


@query("ST5_hourly_live", f"""
SELECT date_trunc('hour', ts) AS hour, count(*) AS total, cast(sum({ATTACK_SQL}) AS bigint) AS attacks FROM flows GROUP BY 1""")
def st5(spark, sf_dir):
    """Watermarked hourly windows in update mode; one trigger reads the table, so nothing is late
    (late rows over several triggers: ``test_models_streaming``)."""
    out, ck = scratch_path(spark, "st5-out"), scratch_path(spark, "st5-ck")
    src = tables.flows(spark, sf_dir, tables.event_stream(spark, sf_dir))
    flagged = src.withColumn("is_attack", L.binary_label("target", "normal") == 1)
    ST.run_available_now(ST.hourly_live(flagged), ck, mode="update", batch_fn=ST.batch_writer(out))
    return ntz(ST.latest_updates(spark, out, "hour"), "hour")


@query("ST6_dedupe_deliveries", "SELECT flow_id, ts FROM flows")
def st6(spark, sf_dir):
    """Every tenth flow is delivered twice; the stream keeps one copy."""
    deliver = lambda: tables.flows(spark, sf_dir, tables.event_stream(spark, sf_dir)).select("flow_id", "ts")
    src = deliver().unionByName(deliver().where(F.col("flow_id") % 10 == 0))
    out, ck = scratch_path(spark, "st6-out"), scratch_path(spark, "st6-ck")
    ST.run_available_now(ST.dedupe_stream(src), ck, out)
    return ntz(spark.read.parquet(out), "ts")


@query("ST1_stream_model_scoring")
def st1_model(spark, sf_dir):
    """A forest pipeline fitted in batch scores the flow stream (every stage is row-local)."""
    from flowlens.operators import models as M
    from flowlens.plans import q_models as QM

    model, _, _ = QM.fitted_forest(spark, sf_dir, "binary")
    out, ck = scratch_path(spark, "st1m-out"), scratch_path(spark, "st1m-ck")
    src = QM.raw_frame(spark, sf_dir, tables.event_stream(spark, sf_dir))
    scored = M.score(model, src, keep=["flow_id", "ts", QM.LABEL])
    ST.run_available_now(scored, ck, out)
    return ntz(spark.read.parquet(out), "ts")


@query("ST1_stream_equals_batch", "SELECT count(*) AS n_rows, 0 AS mismatches FROM flows")
def st1_equals_batch(spark, sf_dir):
    """Raw flows scored by the stream against the same flows scored in batch."""
    from flowlens.operators import models as M
    from flowlens.plans import q_models as QM

    model, _, _ = QM.fitted_forest(spark, sf_dir, "binary")
    out, ck = scratch_path(spark, "st1e-out"), scratch_path(spark, "st1e-ck")
    raw = QM.raw_frame(spark, sf_dir)
    stream = QM.raw_frame(spark, sf_dir, tables.event_stream(spark, sf_dir))
    ST.run_available_now(M.score(model, stream, keep=["flow_id"]), ck, out)
    cols = ["flow_id", "prediction", "confidence"]
    batch = M.score(model, raw, keep=["flow_id"]).select("flow_id", F.struct(*cols[1:]).alias("b"))
    both = spark.read.parquet(out).select("flow_id", F.struct(*cols[1:]).alias("s")).join(batch, "flow_id", "full")
    return both.agg(F.count("*").alias("n_rows"),
                    F.sum((~F.col("s").eqNullSafe(F.col("b"))).cast("int")).cast("int").alias("mismatches"))


FLUSH, NEWEST = 100, 20


@query("ST3_flush_every_100", f"""
WITH {SCORED_SQL},
r AS (SELECT dst_ip, CAST(is_attack AS int) AS a, row_number() OVER (PARTITION BY dst_ip ORDER BY ts, flow_id) - 1 AS i FROM scored)
SELECT dst_ip AS key, i // {FLUSH} + 1 AS flush, count(*) AS total, CAST(sum(a) AS BIGINT) AS attacks, true AS complete
FROM r GROUP BY 1, 2 HAVING count(*) = {FLUSH}""")
def st3_flush(spark, sf_dir):
    """Statistics after every 100 packets of a destination, the counters reset each time."""
    out, ck = scratch_path(spark, "st3f-out"), scratch_path(spark, "st3f-ck")
    with STATE.rocksdb(spark):
        ST.run_available_now(STATE.flush_counts(scored_stream(spark, sf_dir), "dst_ip", "flow_id", FLUSH, idle_ms=0), ck, out)
    return spark.read.parquet(out)


@query("ST2_newest_alerts", ALERTS_SQL + f"""
SELECT source AS key, CAST(rank AS INTEGER) AS rank, alert_id AS id, type, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, alert_id DESC) AS rank FROM alerts) WHERE rank <= {NEWEST}""")
def st2_newest(spark, sf_dir):
    """The newest alerts of every source, as state that the stream keeps (20 here, 1,000 by default)."""
    out, ck = scratch_path(spark, "st2n-out"), scratch_path(spark, "st2n-ck")
    alerts = ST.alert_stream(scored_stream(spark, sf_dir))
    with STATE.rocksdb(spark):
        ST.run_available_now(STATE.newest(alerts, "source", "alert_id", NEWEST), ck, mode="update", batch_fn=ST.batch_writer(out))
    row = F.from_json("row", "type string, confidence double")
    return STATE.current_lists(spark, out).withColumn("r", row).select("key", "rank", "id", "r.type", "r.confidence")

"""Keyed stream state, versioned tables, live baselines, exact splits, grouping sets."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from flowlens.operators import baseline as B
from flowlens.operators import profile as P
from flowlens.operators import rules as R
from flowlens.operators import split as SP
from flowlens.session import scratch_path
from flowlens.sources.versioned import CommitConflict, VersionedTable
from flowlens.streaming import state as STATE
from flowlens.streaming import stream as ST

START = dt.datetime(2024, 1, 1)
ROWS = "k string, ts timestamp, id long, is_attack boolean"


def packets(spark, a, b):
    rows = [("ab"[i % 2], START + dt.timedelta(seconds=i), i, i % 3 == 0) for i in range(a, b)]
    return spark.createDataFrame(rows, ROWS)


def test_counters_go_on_after_a_restart_and_start_again_after_each_flush(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "flush", "ck"))
    schema = packets(spark, 0, 1).schema

    def run():
        with STATE.rocksdb(spark):
            ST.run_available_now(STATE.flush_counts(ST.read_stream(spark, src, schema), "k", "id", every=10, idle_ms=0), ck, out)
        return {(r.key, r.flush): (r.total, r.attacks) for r in spark.read.parquet(out).collect()}

    packets(spark, 0, 46).write.mode("append").parquet(src)   # 23 of each key: 2 flushes, 3 rows held
    first = run()
    packets(spark, 46, 70).write.mode("append").parquet(src)  # 12 more of each: one flush with the 3 held
    both = run()
    want = {}
    for k in (0, 1):
        own = [i for i in range(70) if i % 2 == k]
        for f in range(len(own) // 10):
            want["ab"[k], f + 1] = (10, sum(i % 3 == 0 for i in own[10 * f:10 * f + 10]))
    assert first == {x: v for x, v in want.items() if x[1] <= 2}
    assert both == want


def test_a_quiet_key_is_flushed_by_its_timer(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "idle", "ck"))
    packets(spark, 0, 5).write.parquet(src)
    with STATE.rocksdb(spark):
        counts = STATE.flush_counts(ST.read_stream(spark, src, packets(spark, 0, 1).schema), "k", "id", every=10, idle_ms=500)
        q = counts.writeStream.option("checkpointLocation", ck).trigger(processingTime="1 second").format("parquet").start(out)
        try:
            for _ in range(60):
                time.sleep(1)
                rows = spark.read.schema(STATE.FLUSHED).parquet(out).collect() if q.lastProgress else []
                if len(rows) == 2:
                    break
        finally:
            q.stop()
    assert sorted((r.key, r.flush, r.total, r.complete) for r in rows) == [("a", 1, 3, False), ("b", 1, 2, False)]


def test_newest_rows_are_kept_across_micro_batches(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "newest", "ck"))
    schema = packets(spark, 0, 1).schema
    lists = {}
    for a, b in ((10, 30), (0, 10), (30, 33)):  # the second delivery is late and changes nothing
        packets(spark, a, b).write.mode("append").parquet(src)
        with STATE.rocksdb(spark):
            ST.run_available_now(STATE.newest(ST.read_stream(spark, src, schema), "k", "id", keep=4), ck, mode="update",
                                 batch_fn=ST.batch_writer(out))
        lists[b] = {(r.key, r["rank"]): r.id for r in STATE.current_lists(spark, out).collect()}
    assert lists[30] == lists[10]
    assert [lists[33]["a", i] for i in (1, 2, 3, 4)] == [32, 30, 28, 26] and [lists[33]["b", i] for i in (1, 2, 3, 4)] == [31, 29, 27, 25]


def test_versioned_table_conflicts_failures_and_vacuum(spark):
    df = packets(spark, 0, 4)
    table = VersionedTable(spark, scratch_path(spark, "versioned"), df.schema)
    assert table.read().count() == 0 and table.versions() == []
    assert table.replace(df) == 1 and table.append(packets(spark, 4, 6)) == 2
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(CommitConflict):  # made from version 1, but version 2 exists
        table.replace(df, since=1)
    with pytest.raises(Exception, match="lost"):
        table.replace(df.withColumn("k", F.raise_error(F.lit("lost")).cast("string")))
    assert table.versions() == [1, 2] and table.read().count() == 6
    assert table.clear() == 3 and table.read().count() == 0 and table.read(1).count() == 4
    assert table.replace(df) == 4 and table.vacuum(keep=1) >= 1 and table.read().count() == 4
    with pytest.raises(ValueError):
        table.read(1)


def test_merged_baseline_is_the_recomputed_one(spark):
    rows = [("hot", float(i % 17) * 1e6) for i in range(300)] + [("one", 5.0), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("i", F.monotonically_increasing_id())
    table = VersionedTable(spark, scratch_path(spark, "base"), B.baseline_schema(df.schema["k"]))
    for part in range(4):
        B.update_baseline(table, df.where(F.pmod(F.hash("i"), F.lit(4)) == part), "k", "v")
    whole = {r.k: (r.n, r.mean, r.m2) for r in B.moments(df, "k", "v").collect()}
    got = {r.k: (r.n, r.mean, r.m2) for r in table.read().collect()}
    assert got.keys() == whole.keys() == {"hot", "one", None}
    for k in got:
        assert got[k][0] == whole[k][0] and got[k][1] == pytest.approx(whole[k][1]) and got[k][2] == pytest.approx(whole[k][2])
    out = {r.v: r for r in B.deviation(df.where("k = 'one' OR k = 'hot'"), table.read(), "k", "v").collect()}
    assert out[5.0].deviation is None and out[16e6].deviation == pytest.approx((16e6 - whole["hot"][1]) / (whole["hot"][2] / 299) ** 0.5)


@pytest.mark.parametrize("bucket_rows", [SP.BUCKET_ROWS, 2])
def test_cut_hash_split_is_the_sorted_split(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(SP, "BUCKET_ROWS", bucket_rows)  # 2: the cut is narrowed digit by digit
    rows = [(i, "hot" if i % 3 else ("rare" if i % 30 == 0 else None)) for i in range(900)] + [(5000, "single")]
    df = spark.createDataFrame(rows, "id long, y string")
    train, test = SP.stratified_split(df, "y", "id", 0.2)
    ranked = SP.stratified_rank(df, "y", "id", digits=3).where(F.col("__rn") <= F.round(F.lit(0.2) * F.col("__n")))
    assert sorted(r.id for r in test.collect()) == sorted(r.id for r in ranked.collect())
    assert train.count() + test.count() == 901 and train.join(test, "id").count() == 0
    assert " Exchange" not in test._jdf.queryExecution().executedPlan().toString()
    assert test.where("y IS NULL").count() == round(0.2 * df.where("y IS NULL").count())
    none, all_ = SP.stratified_split(df.limit(0), "y", "id"), SP.stratified_split(df, "y", "id", 1.0)
    assert none[1].count() == 0 and all_[0].count() == 0 and all_[1].count() == 901


def test_distributions_share_one_scan(spark):
    df = packets(spark, 0, 30)
    src = scratch_path(spark, "dist")
    df.write.parquet(src)
    out = P.distributions(spark.read.parquet(src), ["k", "is_attack"])
    got = {(r["column"], r["value"]): (r.n, r.total) for r in out.collect()}
    assert got == {("k", "a"): (15, 30), ("k", "b"): (15, 30), ("is_attack", "true"): (10, 30), ("is_attack", "false"): (20, 30)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_port_sketches_merge_to_the_union(spark):
    rows = [("s", START + dt.timedelta(seconds=i * 7), i % 5000) for i in range(20_000)]
    df = spark.createDataFrame(rows, "src_ip string, ts timestamp, dst_port int")
    day = R.merged_ports(R.port_sketches(df), window="30 days").agg(F.max("n_ports")).first()[0]
    assert abs(day - 5000) <= 0.05 * 5000

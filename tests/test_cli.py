"""The command line runs registered queries into a sink and trains / scores a model."""

import json

from flowlens.__main__ import main
from flowlens.session import scratch_path

from paths import SF_SMALL


def test_cli_run_train_score(spark, capsys):
    out = scratch_path(spark, "cli-run")
    assert main(["run", "AL6_hourly_traffic", "--data", SF_SMALL, "--out", out]) == 0
    assert spark.read.parquet(out).agg({"total": "sum"}).first()[0] == 1000
    model = scratch_path(spark, "cli-model")
    assert main(["train", "--data", SF_SMALL, "--model-out", model, "--preset", "binary"]) == 0
    info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert info["metrics"]["accuracy"] > 0.8 and "Normal" in info["classes"]
    scored = scratch_path(spark, "cli-scored")
    assert main(["score", "--data", SF_SMALL, "--model", model, "--out", scored]) == 0
    assert spark.read.parquet(scored).count() == 1000


def test_cli_on_own_sources(spark, capsys):
    """Any parquet or CSV source: train, score, and score as a stream with the same result."""
    from flowlens.sources import tables

    for name, frame, label, fmt in (("unsw", tables.flows_unsw, "attack_cat", "parquet"), ("cic", tables.flows_cic, "Label", "csv")):
        src, model, out = (scratch_path(spark, f"cli-{name}-{x}") for x in ("src", "model", "out"))
        frame(spark, SF_SMALL).write.option("header", True).format(fmt).save(src)
        args = ["--input", src, "--input-format", fmt]
        assert main(["train", *args, "--label", label, "--model-out", model, "--preset", "binary"]) == 0
        info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        n = frame(spark, SF_SMALL).count()
        assert info["train_rows"] + info["test_rows"] == n and label not in info["features"]
        assert main(["score", *args, "--model", model, "--out", out]) == 0
        assert spark.read.parquet(out).count() == n
    few = scratch_path(spark, "cli-few")
    tables.flows_cic(spark, SF_SMALL).select("flow_no").write.parquet(few)  # features missing: filled with 0
    batch, stream, ck = (scratch_path(spark, f"cli-few-{x}") for x in ("batch", "stream", "ck"))
    assert main(["score", "--input", few, "--model", model, "--out", batch]) == 0
    assert main(["stream", "--source", few, "--model", model, "--out", stream, "--checkpoint", ck, "--once"]) == 0
    a, b = (spark.read.parquet(x).drop("flow_id", "ts") for x in (batch, stream))
    assert a.count() == b.count() == 1500 and a.exceptAll(b).count() == 0

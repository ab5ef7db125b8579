"""Command line: ``python -m flowlens <command>`` (or ``spark-submit -m``-style via a driver script).

Commands
  queries                              list registered queries (* = has a SQL twin)
  run NAME --data DIR [--out PATH]     run a registered query over the tables in DIR; print or write it
  train --input PATH --label COL [--features A,B] [--categorical C] [--key K] --model-out PATH
                                       fit the forest pipeline on the stratified train split of a parquet /
                                       CSV / JSON source (default features: its numeric columns), evaluate
                                       on the test split, save the pipeline and a feature-info JSON;
                                       --data DIR instead of --input uses the test view of the tables in DIR
  score --input PATH --model PATH --out PATH [--keep A,B]
                                       batch-score every row with a saved pipeline (missing features: 0)
  stream --source DIR --model PATH --out PATH --checkpoint PATH [--once]
                                       score flow files as they arrive (availableNow with --once), by the
                                       same alignment and pipeline as the batch command
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def _session():
    from flowlens.session import ensure_checkpoint_dir, ensure_python_package, get_session

    spark = get_session()
    ensure_checkpoint_dir(spark)
    ensure_python_package(spark)
    return spark


def cmd_queries(_args) -> int:
    from flowlens.plans import registry

    registry.load_all()
    for name in registry.QUERIES:
        print(("* " if name in registry.ORACLE else "  ") + name)
    return 0


def cmd_run(args) -> int:
    from flowlens.plans import registry
    from flowlens.sources.sinks import write_table

    registry.load_all()
    spark = _session()
    df = registry.QUERIES[args.name](spark, args.data)
    if args.out:
        write_table(df, args.out, fmt=args.format)
        print(json.dumps({"query": args.name, "out": args.out}))
    else:
        df.show(args.show, truncate=False)
    return 0


def _list(text: str | None) -> list[str]:
    return [x for x in (text or "").split(",") if x]


def _training_rows(spark, args):
    """(train, test, features, categorical, label, key) of the user's source or of the test view."""
    from flowlens import config as C
    from flowlens.functions.exprs import numeric_columns
    from flowlens.operators import models as M
    from flowlens.operators import split as SP
    from flowlens.operators.common import stored
    from flowlens.plans import q_models as QM
    from flowlens.sources import readers

    if not args.input:
        train, test = QM.split(spark, args.data)
        return train, test, QM.FEATURES, QM.CATEGORICAL, QM.LABEL, "flow_id"
    label = "__target"  # so that a label column of any name fits
    df = readers.read_any(spark, args.input, args.input_format).where(F.col(args.label).isNotNull())
    df = df.withColumn(label, F.trim(F.col(args.label).cast("string"))).drop(args.label, *M.RESERVED)
    key = args.key or "__row_key"
    if not args.key:  # equal rows share a key and land on the same side
        df = df.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    categorical = _list(args.categorical)
    features = _list(args.features) or numeric_columns(df, [label, key, *categorical])
    df = stored(df, "training-rows")
    train, test = SP.stratified_split(df, label, key, C.TEST_FRACTION)
    both = stored(train.withColumn("__test", F.lit(False)).unionByName(test.withColumn("__test", F.lit(True))), "split")
    return (both.where(~F.col("__test")).drop("__test"), both.where("__test").drop("__test"), features, categorical,
            label, key)


def cmd_train(args) -> int:
    from flowlens.operators import models as M
    from flowlens.sources.sinks import write_report

    spark = _session()
    train, test, features, categorical, label, key = _training_rows(spark, args)
    model = M.fit_pipeline(M.class_weights(train, label), features, M.random_forest(args.preset, weight="weight"), label,
                           categorical=categorical)
    labels = M.labels_of(model)
    scored = M.score(model, test, keep=[key, label])
    metrics = M.evaluate_scored(scored, label, f"random_forest_{args.preset}", labels).first().asDict()
    M.save_model(model, args.model_out)
    info = {"features": features + [f"{c}_idx" for c in categorical], "classes": labels, "label": args.label or label,
            "preset": args.preset, "train_rows": train.count(), "test_rows": test.count(), "metrics": metrics,
            "importances": M.feature_importances(model, top=10)}
    write_report(spark, info, args.model_out.rstrip("/") + "_info")
    print(json.dumps(info, default=str))
    return 0


def cmd_score(args) -> int:
    from flowlens.operators import models as M
    from flowlens.plans import q_models as QM
    from flowlens.sources import readers
    from flowlens.sources.sinks import write_table

    spark = _session()
    model = M.load_model(args.model)
    if args.input:
        rows, keep = readers.read_any(spark, args.input, args.input_format), _list(args.keep)
    else:
        rows, keep = QM.raw_frame(spark, args.data), ["flow_id"]
    scored = M.score(model, M.aligned(model, rows), keep=keep)
    write_table(scored, args.out, fmt=args.format)
    summary = scored.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n")).orderBy("predicted_class")
    summary.show(truncate=False)
    return 0


def cmd_stream(args) -> int:
    from flowlens.operators import models as M
    from flowlens.streaming import stream as ST

    spark = _session()
    model = M.load_model(args.model)
    schema = spark.read.parquet(args.source).schema
    src = ST.read_stream(spark, args.source, schema, max_files=args.max_files)
    scored = M.score(model, M.aligned(model, src), keep=[c for c in ("flow_id", "ts") if c in schema.fieldNames()])
    if args.once:
        q = ST.run_available_now(scored, args.checkpoint, args.out)
        print(json.dumps(ST.progress_rates(q)))
    else:
        w = scored.writeStream.outputMode("append").option("checkpointLocation", args.checkpoint)
        w.trigger(processingTime=args.trigger).format("parquet").start(args.out).awaitTermination()
    return 0


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="flowlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("queries").set_defaults(fn=cmd_queries)
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("--data", required=True)
    r.add_argument("--out")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    r.add_argument("--show", type=int, default=20)
    r.set_defaults(fn=cmd_run)
    t = sub.add_parser("train")
    t.add_argument("--data")
    t.add_argument("--input")
    t.add_argument("--input-format", choices=["parquet", "csv", "json"])
    t.add_argument("--label")
    t.add_argument("--features")
    t.add_argument("--categorical")
    t.add_argument("--key")
    t.add_argument("--model-out", required=True)
    t.add_argument("--preset", default="advanced", choices=["binary", "advanced", "complete", "training"])
    t.set_defaults(fn=cmd_train)
    s = sub.add_parser("score")
    s.add_argument("--data")
    s.add_argument("--input")
    s.add_argument("--input-format", choices=["parquet", "csv", "json"])
    s.add_argument("--keep", default="")
    s.add_argument("--model", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    s.set_defaults(fn=cmd_score)
    st = sub.add_parser("stream")
    st.add_argument("--source", required=True)
    st.add_argument("--model", required=True)
    st.add_argument("--out", required=True)
    st.add_argument("--checkpoint", required=True)
    st.add_argument("--max-files", type=int, default=1)
    st.add_argument("--trigger", default="10 seconds")
    st.add_argument("--once", action="store_true")
    st.set_defaults(fn=cmd_stream)
    args = p.parse_args(argv)
    if args.cmd in ("train", "score") and bool(args.data) == bool(args.input):
        p.error("give either --input or --data")
    if args.cmd == "train" and args.input and not args.label:
        p.error("--input needs --label")
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())

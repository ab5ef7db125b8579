"""Queries for sources, labels, projections, unions and splits (IO, LB, PR, UN, SP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.config import DatasetSpec
from flowlens.functions import labels as L
from flowlens.operators import labelling as LB
from flowlens.operators import projection as PR
from flowlens.operators import split as SP
from flowlens.operators import union as UN
from flowlens.plans.registry import query
from flowlens.session import scratch_path
from flowlens.sources import readers, tables
from flowlens.sources.sinks import write_table

SPECS = C.default_datasets("/")
KDD, UNSW, CIC = SPECS["nsl_kdd_train"], SPECS["unsw_train"], SPECS["cicids2017"]

LB1_SQL = "CASE WHEN contains(lower(trim(cast(target AS varchar))), 'normal') THEN 0 ELSE 1 END"
EST_SQL = "CASE WHEN regexp_matches(lower(trim(cast({c} AS varchar))), 'normal|benign|legitimate|0|false') THEN 0 ELSE 1 END"
KDD_TYPE_SQL = """CASE
  WHEN contains(lower(target), 'normal') THEN 'Normal'
  WHEN regexp_matches(lower(target), 'neptune|smurf|back|teardrop|pod|land|apache2|udpstorm|processtable|worm') THEN 'DoS'
  WHEN regexp_matches(lower(target), 'satan|ipsweep|nmap|portsweep|mscan|saint') THEN 'Probe'
  WHEN regexp_matches(lower(target), 'guess_passwd|ftp_write|imap|phf|multihop|warezmaster|warezclient|spy|named|snmpguess') THEN 'R2L'
  WHEN regexp_matches(lower(target), 'buffer_overflow|loadmodule|rootkit|perl|sqlattack|xterm|ps|httptunnel') THEN 'U2R'
  ELSE 'Other' END"""
CIC_TYPE_SQL = """CASE
  WHEN contains(lower(Label), 'benign') THEN 'Normal'
  WHEN regexp_matches(lower(Label), 'dos|ddos|hulk|slowloris|goldeneye') THEN 'DoS'
  WHEN regexp_matches(lower(Label), 'portscan|scan') THEN 'Probe'
  WHEN regexp_matches(lower(Label), 'patator|brute') THEN 'BruteForce'
  WHEN regexp_matches(lower(Label), 'xss|sql|web') THEN 'WebAttack'
  WHEN contains(lower(Label), 'bot') THEN 'Botnet'
  WHEN contains(lower(Label), 'infiltration') THEN 'Infiltration'
  ELSE 'Other' END"""
UNSW_TYPE_SQL = """CASE attack_cat
  WHEN 'Normal' THEN 'Normal' WHEN 'Reconnaissance' THEN 'Probe' WHEN 'Exploits' THEN 'Exploit'
  WHEN 'Generic' THEN 'Malware' WHEN 'Shellcode' THEN 'Malware' WHEN 'Worms' THEN 'Malware'
  WHEN 'Backdoor' THEN 'Backdoor' WHEN 'Analysis' THEN 'Analysis' WHEN 'Fuzzers' THEN 'Fuzzer'
  {extra} ELSE 'Other' END"""
UNSW_DOS_SQL = "WHEN 'DoS' THEN 'DoS'"
HASH_SQL = "md5(concat('42:', cast(flow_id AS varchar)))"


def _taxonomy_values(tax: dict) -> str:
    rows = [f"('{L.normalise_dash_text(raw).strip().lower()}', '{fam}')" for fam, raws in tax.items() for raw in raws]
    return "(VALUES " + ", ".join(rows) + ") AS t(raw_label, family)"


DASH_SQL = "lower(trim(regexp_replace({c}, '(?i)^web attack\\s*[^A-Za-z0-9\\s]+\\s*', 'Web Attack - ')))"


# --- sources --------------------------------------------------------------------------------


@query("IO1_parquet_dataset", """
SELECT event_id, CASE WHEN contains(lower(trim(event_type)), 'view') THEN 0 ELSE 1 END AS unified_label,
       'events' AS source_dataset FROM events""")
def io1_parquet(spark, sf_dir):
    spec = DatasetSpec("events", tables.table_path(sf_dir, "events"), "event_type", "view")
    df = readers.load_dataset(spark, spec)
    return LB.prepare_labels(df, spec, "events").select("event_id", "unified_label", "source_dataset")


@query("IO2_csv_dataset", """
SELECT flow_no, flow_duration, packet_count, Label,
       CASE WHEN contains(lower(trim(Label)), 'benign') THEN 0 ELSE 1 END AS unified_label FROM flows_cic""")
def io2_csv(spark, sf_dir):
    """Write the CIC view as CSV into the shared folder, read it back by descriptor (schema pinned)."""
    src = tables.flows_cic(spark, sf_dir)
    path = write_table(src, scratch_path(spark, "cic-csv"), fmt="csv")
    spec = DatasetSpec("CIC-IDS2017", path, "Label", "BENIGN", fmt="csv")
    df = readers.load_dataset(spark, spec, schema=src.schema)
    return LB.prepare_labels(df, spec, "cicids2017").drop("source_dataset")


@query("IO4_skip_missing", "SELECT 'events' AS dataset, count(*) AS n_rows FROM events")
def io4_skip_missing(spark, sf_dir):
    specs = {"events": DatasetSpec("events", tables.table_path(sf_dir, "events"), "event_type", "view"),
             "absent": DatasetSpec("absent", tables.table_path(sf_dir, "no_such_table"), "label", "normal")}
    loaded = readers.load_datasets(spark, specs, on_missing="skip")
    frames = [df.select(F.lit(name).alias("dataset")) for name, df in loaded.items()]
    return UN.union_by_name(frames).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))


@query("IO5_format_dispatch", "SELECT flow_no, flow_duration, packet_count, Label FROM flows_cic")
def io5_dispatch(spark, sf_dir):
    """A '.json' path is read as JSON by suffix."""
    src = tables.flows_cic(spark, sf_dir)
    path = scratch_path(spark, "cic") + ".json"
    write_table(src, path, fmt="json")
    return readers.read_any(spark, path, schema=src.schema)


# --- labels ---------------------------------------------------------------------------------


@query("LB1_binary_label", f"SELECT flow_id, target, {LB1_SQL} AS unified_label, 'nsl_kdd_train' AS source_dataset FROM flows")
def lb1(spark, sf_dir):
    return LB.prepare_labels(tables.flows(spark, sf_dir), KDD, "nsl_kdd_train").select(
        "flow_id", "target", "unified_label", "source_dataset")


@query("LB2_alt_label_discovery", f"SELECT id, label, {EST_SQL.format(c='label')} AS unified_label FROM flows_unsw")
def lb2(spark, sf_dir):
    """Configured label absent; the first name containing label/attack/target is used."""
    df = tables.flows_unsw(spark, sf_dir).drop("attack_cat")
    spec = DatasetSpec("UNSW renamed", "", "category", "Normal")
    assert LB.label_column_used(df, spec) == "label"
    return LB.prepare_labels(df, spec, "unsw").select("id", "label", "unified_label")


@query("LB3_estimated_label", f"SELECT flow_no, Label, {EST_SQL.format(c='Label')} AS unified_label FROM flows_cic")
def lb3(spark, sf_dir):
    spec = DatasetSpec("CIC renamed", "", "class_name", "BENIGN")
    return LB.prepare_labels(tables.flows_cic(spark, sf_dir), spec, "cic").select("flow_no", "Label", "unified_label")


@query("LB4_no_label_all_attack", "SELECT flow_id, 1 AS unified_label FROM flows")
def lb4(spark, sf_dir):
    df = tables.flows(spark, sf_dir).drop("target")
    return LB.prepare_labels(df, KDD, "kdd").select("flow_id", "unified_label")


@query("LB6_is_attack", "SELECT flow_id, NOT contains(lower(target), 'normal') AS is_attack FROM flows")
def lb6(spark, sf_dir):
    """LB5 finds `target` by exact name; LB6 flags attacks."""
    return LB.add_is_attack(tables.flows(spark, sf_dir)).select("flow_id", "is_attack")


@query("LB7_numeric_label", """
SELECT dur, sbytes, dbytes, rate, spkts, cast(label AS int) AS unified_label FROM flows_unsw""")
def lb7(spark, sf_dir):
    df = tables.flows_unsw(spark, sf_dir).withColumn("unified_label", L.numeric_label("label"))
    return PR.select_features(df, cap=C.FEATURE_CAP, keep=["unified_label"], exclude=list(UNSW.drop_columns))


@query("LB8_kdd_category", f"SELECT flow_id, target, {KDD_TYPE_SQL} AS attack_type FROM flows")
def lb8(spark, sf_dir):
    return LB.add_attack_type(tables.flows(spark, sf_dir), "kdd", "target").select("flow_id", "target", "attack_type")


@query("LB9_unsw_category", f"SELECT id, attack_cat, {UNSW_TYPE_SQL.format(extra=UNSW_DOS_SQL)} AS attack_type FROM flows_unsw")
def lb9(spark, sf_dir):
    return LB.add_attack_type(tables.flows_unsw(spark, sf_dir), "unsw", "attack_cat").select("id", "attack_cat", "attack_type")


@query("LB9_unsw_category_strict", f"SELECT id, attack_cat, {UNSW_TYPE_SQL.format(extra='')} AS attack_type FROM flows_unsw")
def lb9_strict(spark, sf_dir):
    return LB.add_attack_type(tables.flows_unsw(spark, sf_dir), "unsw", "attack_cat", strict=True).select(
        "id", "attack_cat", "attack_type")


@query("LB10_cic_category", f"SELECT flow_no, Label, {CIC_TYPE_SQL} AS attack_type FROM flows_cic")
def lb10(spark, sf_dir):
    return LB.add_attack_type(tables.flows_cic(spark, sf_dir), "cic", "Label").select("flow_no", "Label", "attack_type")


@query("LB11_taxonomy_family", f"""
SELECT flow_id, target,
  CASE WHEN contains(lower(trim(target)), 'normal') THEN 'Normal' ELSE coalesce(t.family, 'Other') END AS family
FROM flows LEFT JOIN {_taxonomy_values(C.KDD_TEST_TAXONOMY)} ON {DASH_SQL.format(c="target")} = t.raw_label""")
def lb11(spark, sf_dir):
    tax = LB.taxonomy_table(spark, {"nsl_kdd_test": C.KDD_TEST_TAXONOMY})
    out = LB.apply_taxonomy(tables.flows(spark, sf_dir), "target", "nsl_kdd_test", tax, "normal")
    return out.select("flow_id", "target", "family")


@query("LB11_taxonomy_family_cic", f"""
SELECT flow_no, Label,
  CASE WHEN contains(lower(trim(Label)), 'benign') THEN 'Normal' ELSE coalesce(t.family, 'Other') END AS family
FROM flows_cic LEFT JOIN {_taxonomy_values(C.CIC_TAXONOMY)} ON {DASH_SQL.format(c="Label")} = t.raw_label""")
def lb11_cic(spark, sf_dir):
    """CIC labels use a plain hyphen, the configuration a different dash: both are normalised."""
    tax = LB.taxonomy_table(spark, {"cicids2017": C.CIC_TAXONOMY})
    out = LB.apply_taxonomy(tables.flows_cic(spark, sf_dir), "Label", "cicids2017", tax, "benign")
    return out.select("flow_no", "Label", "family")


@query("LB12_display_name", """
SELECT flow_id, cast(flow_id % 7 AS int) AS class_id,
  CASE flow_id % 7 WHEN 0 THEN 'Normal' WHEN 1 THEN 'DoS/DDoS' WHEN 2 THEN 'Probe/Scanning'
       WHEN 3 THEN 'Privilege Escalation' WHEN 4 THEN 'Malware/Exploit' ELSE 'Unknown' END AS class_name
FROM scores""")
def lb12(spark, sf_dir):
    df = tables.scores(spark, sf_dir).withColumn("class_id", (F.col("flow_id") % 7).cast("int"))
    return df.select("flow_id", "class_id", L.display_name("class_id").alias("class_name"))


@query("LB13_label_encoding", f"""
WITH t AS (SELECT flow_id, {KDD_TYPE_SQL} AS attack_type FROM flows),
m AS (SELECT attack_type, dense_rank() OVER (ORDER BY attack_type) - 1 AS label_index FROM (SELECT DISTINCT attack_type FROM t) d)
SELECT t.flow_id, t.attack_type, cast(m.label_index AS int) AS label_index FROM t JOIN m USING (attack_type)""")
def lb13(spark, sf_dir):
    df = LB.add_attack_type(tables.flows(spark, sf_dir), "kdd", "target").select("flow_id", "attack_type")
    idx = LB.LabelIndex.fit(df, "attack_type")
    return idx.transform(df).select("flow_id", "attack_type", F.col("label_index").cast("int").alias("label_index"))


@query("LB14_provenance", """
SELECT 'nsl_kdd_train' AS source_dataset, count(*) AS n FROM flows
UNION ALL SELECT 'unsw_train', count(*) FROM flows_unsw
UNION ALL SELECT 'cicids2017', count(*) FROM flows_cic""")
def lb14(spark, sf_dir):
    frames = [LB.prepare_labels(tables.flows(spark, sf_dir), KDD, "nsl_kdd_train").select("source_dataset"),
              LB.prepare_labels(tables.flows_unsw(spark, sf_dir), UNSW, "unsw_train").select("source_dataset"),
              LB.prepare_labels(tables.flows_cic(spark, sf_dir), CIC, "cicids2017").select("source_dataset")]
    return UN.union_by_name(frames).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"))


# --- projections ----------------------------------------------------------------------------


@query("PR1_first_numeric_columns", f"""
SELECT dst_port, duration, src_bytes, dst_bytes, conn_count, srv_count, serror_rate, srv_serror_rate,
       same_srv_rate, diff_srv_rate, ttl, flow_rate, {LB1_SQL} AS unified_label FROM flows""")
def pr1(spark, sf_dir):
    df = LB.prepare_labels(tables.flows(spark, sf_dir), KDD, "kdd")
    return PR.select_features(df, cap=C.FEATURE_CAP, keep=["unified_label"], exclude=["flow_id"])


@query("PR2_drop_id_label", "SELECT dur, sbytes, dbytes, rate, spkts FROM flows_unsw")
def pr2(spark, sf_dir):
    return PR.select_features(tables.flows_unsw(spark, sf_dir), cap=None, exclude=["id", "label"])


@query("PR3_fill_zero", """
SELECT flow_id, flag, coalesce(diff_srv_rate, 0) AS diff_srv_rate, coalesce(ttl, 0) AS ttl,
       CASE WHEN isnan(flow_rate) THEN 0 ELSE coalesce(flow_rate, 0) END AS flow_rate FROM flows""")
def pr3(spark, sf_dir):
    df = tables.flows(spark, sf_dir).select("flow_id", "flag", "diff_srv_rate", "ttl", "flow_rate")
    return PR.fill_zero(df)


@query("PR4_inf_to_null", """
SELECT flow_id, CASE WHEN isnan(flow_rate) OR isinf(flow_rate) THEN NULL ELSE flow_rate END AS flow_rate,
       duration FROM flows""")
def pr4(spark, sf_dir):
    return PR.nonfinite_to_null(tables.flows(spark, sf_dir).select("flow_id", "flow_rate", "duration"))


@query("PR5_normal_rows", f"SELECT flow_id, src_bytes FROM flows WHERE {LB1_SQL} = 0")
def pr5(spark, sf_dir):
    df = LB.prepare_labels(tables.flows(spark, sf_dir), KDD, "kdd")
    return PR.filter_label(df, "unified_label", 0).select("flow_id", "src_bytes")


PACKET_ORDER = ["src_bytes", "dst_bytes", "duration", "count", "srv_count", "feat_0"]


@query("PR6_packet_features", """
SELECT flow_id,
  cast(src_bytes AS double) AS src_bytes,
  CASE WHEN flow_id % 5 = 0 THEN 0.0::DOUBLE ELSE cast(dst_bytes AS double) END AS dst_bytes,
  CASE WHEN flow_id % 7 = 0 THEN 0.0::DOUBLE ELSE duration END AS duration,
  cast(conn_count AS double) AS count,
  cast(srv_count AS double) AS srv_count,
  0.0::DOUBLE AS feat_0
FROM flows""")
def pr6(spark, sf_dir):
    """Loose packets as string maps: padded numbers, junk text, absent keys."""
    f = tables.flows(spark, sf_dir)
    m = F.map_filter(F.create_map(
        F.lit("src_bytes"), F.col("src_bytes").cast("string"),
        F.lit("dst_bytes"), F.when(F.col("flow_id") % 5 != 0, F.col("dst_bytes").cast("string")),
        F.lit("duration"), F.when(F.col("flow_id") % 7 == 0, F.lit("abc")).otherwise(F.col("duration").cast("string")),
        F.lit("count"), F.concat(F.lit(" "), F.col("conn_count").cast("string"), F.lit(" ")),
        F.lit("srv_count"), F.col("srv_count").cast("string"),
    ), lambda k, v: v.isNotNull())
    return PR.packet_features(f.select("flow_id", m.alias("packet")), "packet", PACKET_ORDER, keep=["flow_id"])


@query("PR7_decoded_packet", """
SELECT flow_id, cast(src_bytes + dst_bytes AS int) AS packet_length,
  CASE protocol_type WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 ELSE 1 END AS protocol_no,
  CASE WHEN protocol_type = 'tcp' THEN cast(dst_port % 64 AS int) ELSE 0 END AS tcp_flags,
  CASE WHEN protocol_type = 'tcp' THEN cast(src_bytes % 65536 AS int) ELSE 0 END AS window_size,
  coalesce(ttl, 0) AS ip_ttl, CASE WHEN ttl IS NULL THEN 0 ELSE cast(flow_id % 8 AS int) END AS ip_tos
FROM flows""")
def pr7(spark, sf_dir):
    f = tables.flows(spark, sf_dir)
    tcp = F.when(F.col("protocol_type") == "tcp", F.struct(
        (F.col("dst_port") % 64).cast("int").alias("flags"), (F.col("src_bytes") % 65536).cast("int").alias("window_size")))
    ip = F.when(F.col("ttl").isNotNull(), F.struct(F.col("ttl").alias("ttl"), (F.col("flow_id") % 8).cast("int").alias("tos")))
    proto = F.when(F.col("protocol_type") == "tcp", 6).when(F.col("protocol_type") == "udp", 17).otherwise(1)
    packets = f.select("flow_id", (F.col("src_bytes") + F.col("dst_bytes")).alias("length"), proto.alias("protocol"),
                       tcp.alias("tcp"), ip.alias("ip"))
    return PR.decoded_packet_fields(packets).select("flow_id", "packet_length", "protocol_no", "tcp_flags",
                                                   "window_size", "ip_ttl", "ip_tos")


# --- unions ---------------------------------------------------------------------------------


@query("UN1_union_by_name", """
SELECT flow_id, duration, src_bytes, NULL::BIGINT AS id, NULL::DOUBLE AS dur, NULL::BIGINT AS sbytes FROM flows
UNION ALL
SELECT NULL, NULL, NULL, id, dur, sbytes FROM flows_unsw""")
def un1(spark, sf_dir):
    a = tables.flows(spark, sf_dir).select("flow_id", "duration", "src_bytes")
    b = tables.flows_unsw(spark, sf_dir).select("id", "dur", "sbytes")
    return UN.union_by_name([a, b])


@query("UN2_union_zero_filled", f"""
SELECT duration, src_bytes, 0::BIGINT AS sbytes, 0::DOUBLE AS flow_duration, {KDD_TYPE_SQL} AS attack_type,
       'nsl_kdd' AS source FROM flows
UNION ALL
SELECT 0, 0, sbytes, 0, {UNSW_TYPE_SQL.format(extra=UNSW_DOS_SQL)}, 'unsw' FROM flows_unsw
UNION ALL
SELECT 0, 0, 0, flow_duration, {CIC_TYPE_SQL}, 'cic' FROM flows_cic""")
def un2(spark, sf_dir):
    a = LB.add_attack_type(tables.flows(spark, sf_dir), "kdd", "target").select(
        "duration", "src_bytes", "attack_type", F.lit("nsl_kdd").alias("source"))
    b = LB.add_attack_type(tables.flows_unsw(spark, sf_dir), "unsw", "attack_cat").select(
        "sbytes", "attack_type", F.lit("unsw").alias("source"))
    c = LB.add_attack_type(tables.flows_cic(spark, sf_dir), "cic", "Label").select(
        "flow_duration", "attack_type", F.lit("cic").alias("source"))
    return UN.union_zero_filled([a, b, c])


@query("UN3_align_features", """
SELECT flow_no, flow_duration, cast(packet_count AS double) AS packet_count, 0.0::DOUBLE AS src_bytes, 0.0::DOUBLE AS duration FROM flows_cic""")
def un3(spark, sf_dir):
    return UN.align_features(tables.flows_cic(spark, sf_dir), ["flow_duration", "packet_count", "src_bytes", "duration"],
                             keep=["flow_no"])


# --- splits ---------------------------------------------------------------------------------


@query("SP1_stratified_split", f"""
SELECT flow_id, y FROM (
  SELECT flow_id, y, row_number() OVER (PARTITION BY y ORDER BY {HASH_SQL}, flow_id) AS rn,
         count(*) OVER (PARTITION BY y) AS n FROM scores) t
WHERE rn <= round(0.2 * n)""")
def sp1(spark, sf_dir):
    _, test = SP.stratified_split(tables.scores(spark, sf_dir).select("flow_id", "y"), "y", "flow_id", 0.2)
    return test


@query("SP2_hash_split", f"""
SELECT flow_id, y FROM scores
WHERE cast(cast('0x' || substr({HASH_SQL}, 1, 8) AS bigint) AS double) / 4294967296.0 < 0.2""")
def sp2(spark, sf_dir):
    _, test = SP.hash_split(tables.scores(spark, sf_dir).select("flow_id", "y"), "flow_id", 0.2)
    return test


@query("SP3_fold_sizes", f"""
SELECT y, cast((rn - 1) % 5 AS int) AS fold, count(*) AS n FROM (
  SELECT y, row_number() OVER (PARTITION BY y ORDER BY {HASH_SQL}, flow_id) AS rn FROM scores) t
GROUP BY 1, 2""")
def sp3(spark, sf_dir):
    folds = SP.assign_folds(tables.scores(spark, sf_dir).select("flow_id", "y"), "y", "flow_id", 5)
    return folds.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


# --- sinks and the packet source -------------------------------------------------------------


@query("IO6_csv_export", f"""
SELECT flow_id, y AS true_label, CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END AS predicted_label
FROM scores WHERE y = 0 AND p_c > 0.55""")
def io6(spark, sf_dir):
    """False-positive rows exported as CSV to the shared folder and read back."""
    from flowlens.operators import evaluate as EV

    s = tables.scores(spark, sf_dir).withColumn("pred", (F.col("p_c") > C.ATTACK_THRESHOLD).cast("int"))
    fp, _ = EV.false_predictions(s, "y", "pred")
    out = fp.select("flow_id", "true_label", "predicted_label")
    path = write_table(out, scratch_path(spark, "fp-export"), fmt="csv")
    return spark.read.option("header", True).schema(out.schema).csv(path)


@query("IO7_json_report", """
SELECT count(*) AS total, cast(sum(CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END) AS bigint) AS attack FROM scores""")
def io7(spark, sf_dir):
    """Counters written as a one-line JSON report by Spark, then read back."""
    from flowlens.operators import alerts as A
    from flowlens.sources.sinks import read_report, write_report

    s = tables.scores(spark, sf_dir).withColumn("is_attack", F.col("p_c") > C.ATTACK_THRESHOLD)
    c = A.counters(s).first()
    path = write_report(spark, {"total": c["total"], "attack": c["attack"]}, scratch_path(spark, "report"))
    rep = read_report(spark, path)
    return spark.createDataFrame([(rep["total"], rep["attack"])], "total bigint, attack bigint")


@query("IO9_packet_stream", """
SELECT flow_id, cast(src_bytes AS double) AS src_bytes,
  CASE WHEN flow_id % 5 = 0 THEN 0.0::DOUBLE ELSE cast(dst_bytes AS double) END AS dst_bytes,
  CASE WHEN flow_id % 7 = 0 THEN 0.0::DOUBLE ELSE duration END AS duration,
  cast(conn_count AS double) AS count, cast(srv_count AS double) AS srv_count, 0.0::DOUBLE AS feat_0
FROM flows""")
def io9(spark, sf_dir):
    """Loose JSON packets arrive as files; the stream orders their features for scoring."""
    from pyspark.sql import types as T

    from flowlens.streaming import stream as ST

    f = tables.flows(spark, sf_dir)
    m = F.map_filter(F.create_map(
        F.lit("src_bytes"), F.col("src_bytes").cast("string"),
        F.lit("dst_bytes"), F.when(F.col("flow_id") % 5 != 0, F.col("dst_bytes").cast("string")),
        F.lit("duration"), F.when(F.col("flow_id") % 7 == 0, F.lit("abc")).otherwise(F.col("duration").cast("string")),
        F.lit("count"), F.concat(F.lit(" "), F.col("conn_count").cast("string"), F.lit(" ")),
        F.lit("srv_count"), F.col("srv_count").cast("string"),
    ), lambda k, v: v.isNotNull())
    src, out, ck = scratch_path(spark, "packets"), scratch_path(spark, "packets-out"), scratch_path(spark, "packets-ck")
    f.select("flow_id", "ts", m.alias("packet")).write.mode("overwrite").json(src)
    schema = T.StructType([T.StructField("flow_id", T.LongType()), T.StructField("ts", T.StringType()),
                           T.StructField("packet", T.MapType(T.StringType(), T.StringType()))])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(src)
    ST.run_available_now(PR.packet_features(stream, "packet", PACKET_ORDER, keep=["flow_id"]), ck, out)
    return spark.read.parquet(out)


@query("SC5_attack_class_index", f"""
SELECT label, cast(dense_rank() OVER (ORDER BY label) - 1 AS int) AS label_index,
       label = 'Attack' AS is_attack_class FROM (
  SELECT DISTINCT CASE WHEN {LB1_SQL} = 0 THEN 'Normal' ELSE 'Attack' END AS label FROM flows) d""")
def sc5(spark, sf_dir):
    """The attack class is found by name among the fitted labels (not assumed at index 0 or 1)."""
    from flowlens.operators.scoring import attack_index

    df = tables.flows(spark, sf_dir).select(
        F.when(L.binary_label("target", "normal") == 0, "Normal").otherwise("Attack").alias("label"))
    idx = LB.LabelIndex.fit(df, "label")
    pos = attack_index(idx.labels(), "Attack")
    return idx.mapping.select(F.col("__label").alias("label"), F.col("label_index").cast("int").alias("label_index"),
                              (F.col("label_index") == pos).alias("is_attack_class"))

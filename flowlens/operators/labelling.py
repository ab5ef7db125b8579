"""Label preparation (LB1-LB14): schema decisions on the driver, row work as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.config import DatasetSpec
from flowlens.functions import labels as L


def find_alt_label(df: DataFrame, fragments: list[str] = C.ALT_LABEL_FRAGMENTS) -> str | None:
    """LB2: first column whose lower-case name contains label / attack / target."""
    for name in df.columns:
        if any(f in name.lower() for f in fragments):
            return name
    return None


def find_exact_label(df: DataFrame, names: list[str] = C.EXACT_LABEL_NAMES) -> str | None:
    """LB5: first column whose lower-case name is label / target / class."""
    for name in df.columns:
        if name.lower() in names:
            return name
    return None


def prepare_labels(df: DataFrame, spec: DatasetSpec, source: str, label_out: str = "unified_label",
                   source_out: str = "source_dataset") -> DataFrame:
    """LB1-LB4 + LB14: add the 0/1 label and the provenance tag.

    Configured label column present -> contains(normal label) rule; else an alternative
    column by name -> regex of normal indicators; else every row is an attack.  The
    descriptor is never mutated.
    """
    if spec.label_column in df.columns:
        label = L.binary_label(spec.label_column, spec.normal_label)
    else:
        alt = find_alt_label(df)
        label = L.estimated_label(alt) if alt is not None else L.attack_everywhere()
    return df.withColumn(label_out, label.cast("int")).withColumn(source_out, F.lit(source))


def label_column_used(df: DataFrame, spec: DatasetSpec) -> str | None:
    if spec.label_column in df.columns:
        return spec.label_column
    return find_alt_label(df)


def add_is_attack(df: DataFrame, label_col: str | None = None, marker: str = "normal",
                  out: str = "is_attack") -> DataFrame:
    """LB5 + LB6: find the label by exact name, flag attack = not contains(marker)."""
    label_col = label_col or find_exact_label(df)
    if label_col is None:
        raise ValueError("no label column named label/target/class")
    return df.withColumn(out, L.is_attack(label_col, marker))


def taxonomy_table(spark: SparkSession, taxonomies: dict[str, dict[str, list[str]]]) -> DataFrame:
    """LB11: exploded (dataset, raw_label, family) lookup table from the descriptors."""
    rows = [(ds, L.normalise_dash_text(raw).strip().lower(), fam)
            for ds, tax in taxonomies.items() for fam, raws in tax.items() for raw in raws]
    return spark.createDataFrame(rows, "dataset string, raw_label string, family string")


def apply_taxonomy(df: DataFrame, label_col: str, dataset: str, taxonomy: DataFrame, normal_label: str,
                   out: str = "family") -> DataFrame:
    """LB11: raw label -> family via an equi join on the normalised label.

    The lookup table is built from the configuration (tens of rows), so it is broadcast;
    normal rows become 'Normal' and unknown attack labels 'Other'.
    """
    lookup = (taxonomy.where(F.col("dataset") == dataset)
              .select(F.col("raw_label").alias("__raw"), F.col("family").alias("__family")))
    key = F.lower(F.trim(L.normalise_dash(F.col(label_col))))
    joined = df.withColumn("__raw", key).join(F.broadcast(lookup), "__raw", "left")
    fam = (F.when(F.col("__raw").contains(normal_label.lower()), F.lit("Normal"))
           .otherwise(F.coalesce(F.col("__family"), F.lit(C.OTHER_CATEGORY))))
    return joined.withColumn(out, fam).drop("__raw", "__family")


def add_attack_type(df: DataFrame, family: str, label_col: str, out: str = "attack_type",
                    strict: bool = False) -> DataFrame:
    """LB8 (kdd) / LB9 (unsw) / LB10 (cic): multi-class attack type."""
    if family == "kdd":
        expr = L.kdd_category(label_col)
    elif family == "unsw":
        expr = L.unsw_category(label_col, strict=strict)
    elif family == "cic":
        expr = L.cic_category(label_col)
    else:
        raise ValueError(family)
    return df.withColumn(out, expr)


class LabelIndex:
    """LB13: lexicographic label encoding fitted as a small (label, index) table."""

    def __init__(self, mapping: DataFrame, input_col: str, output_col: str):
        self.mapping, self.input_col, self.output_col = mapping, input_col, output_col

    MAX_LABELS = 100_000

    @classmethod
    def fit(cls, df: DataFrame, input_col: str, output_col: str = "label_index") -> "LabelIndex":
        distinct = df.select(F.col(input_col).cast("string").alias("__label")).where(
            F.col("__label").isNotNull()).distinct()
        # One job, at most MAX_LABELS + 1 rows: classes, never raw rows.
        labels = sorted((r[0] for r in distinct.limit(cls.MAX_LABELS + 1).collect()), key=str.encode)
        if len(labels) > cls.MAX_LABELS:
            raise ValueError(f"{input_col}: more than {cls.MAX_LABELS} distinct labels; not a class column")
        mapping = df.sparkSession.createDataFrame(list(zip(labels, range(len(labels)))),
                                                  f"__label string, `{output_col}` int")
        return cls(mapping, input_col, output_col)

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.mapping
        return (df.withColumn("__label", F.col(self.input_col).cast("string"))
                .join(m, "__label", "left").drop("__label"))

    def inverse(self, df: DataFrame, index_col: str, out: str) -> DataFrame:
        m = self.mapping.select(F.col("__label").alias(out), F.col(self.output_col).alias("__idx"))
        return df.join(m, df[index_col] == m["__idx"], "left").drop("__idx")

    def labels(self) -> list[str]:
        return [r[0] for r in self.mapping.orderBy(self.output_col).collect()]

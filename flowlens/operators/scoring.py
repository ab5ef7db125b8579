"""Decision rules over model outputs (SC1-SC7), all as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.functions.labels import display_name


def argmax_rule(df: DataFrame, probs_col: str, names: dict[int, str] = C.UNIFIED_LABELS) -> DataFrame:
    """SC2: predicted class = first index of the largest probability; confidence = its probability."""
    probs = F.col(probs_col)
    idx = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    return (df.withColumn("predicted_class", idx)
            .withColumn("class_name", display_name(F.col("predicted_class"), names))
            .withColumn("probability", F.array_max(probs))
            .withColumn("is_attack", F.col("predicted_class") != 0))


def threshold_rule(df: DataFrame, p_attack: str, threshold: float = C.ATTACK_THRESHOLD) -> DataFrame:
    """SC3: attack iff p_attack > threshold (strict); confidence = probability of the chosen label."""
    p = F.col(p_attack)
    attack = p > F.lit(threshold)
    return (df.withColumn("is_attack", attack)
            .withColumn("label", F.when(attack, F.lit("Attack")).otherwise(F.lit("Normal")))
            .withColumn("confidence", F.when(attack, p).otherwise(1 - p)))


def guarded_threshold_rule(df: DataFrame, raw_col: str, threshold: float = C.ATTACK_THRESHOLD) -> DataFrame:
    """SC6: a row whose score does not parse becomes label 'Error', confidence 0 and valid=false;
    the batch carries on.  Route ``valid = false`` rows to a quarantine sink if wanted."""
    p = F.expr(f"try_cast(`{raw_col}` AS double)")
    ok = p.isNotNull()
    attack = p > F.lit(threshold)
    return (df.withColumn("valid", ok)
            .withColumn("label", F.when(~ok, F.lit("Error")).when(attack, F.lit("Attack")).otherwise(F.lit("Normal")))
            .withColumn("confidence", F.when(~ok, F.lit(0.0)).when(attack, p).otherwise(1 - p)))


def alert_gate(df: DataFrame, pred_col: str, p_col: str, min_confidence: float = C.ALERT_CONFIDENCE) -> DataFrame:
    """SC4: keep rows predicted as attack with probability strictly above the gate."""
    return df.where(F.col(pred_col).cast("boolean") & (F.col(p_col) > F.lit(min_confidence)))


def attack_index(labels: list[str], name: str = "Attack") -> int:
    """SC5: position of the attack class among the fitted labels, else 0 (driver side)."""
    for i, lab in enumerate(labels):
        if str(lab).lower() == name.lower():
            return i
    return 0


def correctness_mark(df: DataFrame, expected: str, predicted: str, out: str = "correct") -> DataFrame:
    """SC7: expected == predicted."""
    return df.withColumn(out, F.col(expected) == F.col(predicted))


def split_quarantine(df: DataFrame, valid_col: str = "valid") -> tuple[DataFrame, DataFrame]:
    """SC6: (scored rows, quarantined rows) so that bad input can go to its own sink."""
    return df.where(F.col(valid_col)), df.where(~F.col(valid_col))

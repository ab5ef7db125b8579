"""Label expressions (LB1-LB12): plain Column builders, no Python per row."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.functions.exprs import col


def _text(c) -> Column:
    """Label as lower-case trimmed text (pandas: astype(str).str.strip().str.lower())."""
    return F.lower(F.trim(col(c).cast("string")))


def binary_label(c, normal_label: str) -> Column:
    """LB1: 0 when the text *contains* the normal label, else 1; NULL counts as attack."""
    return F.when(_text(c).contains(normal_label.lower()), F.lit(0)).otherwise(F.lit(1))


def estimated_label(c, indicators: list[str] = C.NORMAL_INDICATORS) -> Column:
    """LB3: 0 when the text matches any normal indicator (regex alternation), else 1."""
    return F.when(_text(c).rlike("|".join(indicators)), F.lit(0)).otherwise(F.lit(1))


def attack_everywhere() -> Column:
    """LB4: no label column at all -> every row is an attack."""
    return F.lit(1)


def is_attack(c, marker: str = "normal") -> Column:
    """LB6: NOT contains(marker), case-insensitive; NULL text ('nan' in pandas) is an attack."""
    return F.coalesce(~F.lower(col(c).cast("string")).contains(marker.lower()), F.lit(True))


def numeric_label(c) -> Column:
    """LB7: numeric 0/1 label passes through as int."""
    return col(c).cast("int")


def ordered_category(c, rules: list[tuple[str, list[str]]], default: str = C.OTHER_CATEGORY) -> Column:
    """LB8 / LB10: first rule whose any fragment is a substring of the lower-case label."""
    text = F.lower(col(c).cast("string"))
    out = None
    for name, fragments in rules:
        cond = None
        for frag in fragments:
            hit = text.contains(frag)
            cond = hit if cond is None else (cond | hit)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default))


def kdd_category(c) -> Column:
    return ordered_category(c, C.KDD_CATEGORY_RULES)


def cic_category(c) -> Column:
    return ordered_category(c, C.CIC_CATEGORY_RULES)


def mapped_category(c, mapping: dict[str, str], default: str = C.OTHER_CATEGORY) -> Column:
    """LB9: exact lookup in a literal map (no join), unmapped -> default."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.element_at(m, col(c).cast("string")), F.lit(default)) if mapping else F.lit(default)


def unsw_category(c, strict: bool = False) -> Column:
    mapping = dict(C.UNSW_CATEGORY_MAP)
    if not strict:
        mapping.update(C.UNSW_CATEGORY_EXTRA)
    return mapped_category(c, mapping)


def display_name(c, names: dict[int, str] = C.UNIFIED_LABELS, default: str = C.UNKNOWN_LABEL) -> Column:
    """LB12: label id -> display name, unknown ids -> 'Unknown'."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.element_at(m, col(c).cast("int")), F.lit(default))


# Any run of non-alphanumeric characters after "Web Attack" (plain, en or damaged dash).
WEB_ATTACK_DASH = r"(?i)^web attack\s*[^A-Za-z0-9\s]+\s*"


def normalise_dash(c) -> Column:
    """Fold the separator between 'Web Attack' and the suffix to ' - ' (damaged dashes, §8.9)."""
    return F.regexp_replace(col(c).cast("string"), WEB_ATTACK_DASH, "Web Attack - ")


def normalise_dash_text(text: str) -> str:
    """Driver-side twin of ``normalise_dash`` for configuration values."""
    import re

    return re.sub(WEB_ATTACK_DASH, "Web Attack - ", text)

"""Train/test splits and folds (SP1-SP3).

SP1 is an exact stratified split: within each label the rows are ordered by
``md5('<seed>:<key>')`` (ties by key) and the first ``round(fraction * n_label)`` go to
the test set.  No row is shuffled or sorted for it: the last test row of each label is found
by selection (counts by the leading hex digits give the bucket in which the share ends, a
narrower count or a look into that small bucket gives the row), and both sides of the split
are plain comparisons with it.

SP3 needs every row's position: the leading hex digits of the hash form buckets (uniform by
construction, whatever the key or label skew), per-(label, bucket) counts are prefix-summed,
and the row number is finished inside each (label, bucket) window partition; the number of
digits follows from the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import config as C


def hash_key(key: str, seed: int = C.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


BUCKET_ROWS = 10_000  # a look into a bucket orders about as many rows
MAX_LABELS = 1_000    # a stratum is a class: more are an error


def _digits(rows: int) -> int:
    """Leading hex digits that cut ``rows`` into buckets of some ``BUCKET_ROWS``."""
    digits = 3
    while rows > BUCKET_ROWS * 16 ** digits:
        digits += 1
    return digits


def stratified_rank(df: DataFrame, label: str, key: str, seed: int = C.SEED, digits: int | None = None) -> DataFrame:
    """Add ``__rn`` (1-based position within the label in hash order) and ``__n`` (label size)."""
    h = hash_key(key, seed)
    digits = digits or _digits(df.count())
    base = df.withColumn("__h", h).withColumn("__bk", F.substring("__h", 1, digits))
    counts = base.groupBy(label, "__bk").agg(F.count(F.lit(1)).alias("__c"))
    # Prefix sums in two levels, so no task orders more than 16**3 buckets of a label.
    head = counts.groupBy(label, F.substring("__bk", 1, 3).alias("__hd")).agg(F.sum("__c").alias("__hc"))
    over = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    head = head.select(F.col(label).alias("__hl"), "__hd",
                       F.coalesce(F.sum("__hc").over(over(label).orderBy("__hd")), F.lit(0)).alias("__hoff"),
                       F.sum("__hc").over(Window.partitionBy(label)).alias("__n"))
    inner = counts.withColumn("__hd", F.substring("__bk", 1, 3))
    inner = inner.select(F.col(label).alias("__l"), F.col("__bk").alias("__b"), F.col("__hd").alias("__hd2"),
                         F.coalesce(F.sum("__c").over(over(label, "__hd").orderBy("__bk")), F.lit(0)).alias("__in"))
    offsets = inner.join(head, (F.col("__hd2") == F.col("__hd")) & F.col("__l").eqNullSafe(F.col("__hl"))).select(
        "__l", "__b", (F.col("__hoff") + F.col("__in")).alias("__off"), "__n")
    joined = base.join(offsets, (F.col("__bk") == F.col("__b")) & F.col(label).eqNullSafe(F.col("__l")))
    local = Window.partitionBy(label, "__bk").orderBy("__h", key)
    return joined.withColumn("__rn", F.col("__off") + F.row_number().over(local)).drop("__off", "__bk", "__h", "__l", "__b")


def _by_label(label: str, values: dict, otherwise=None) -> Column:
    """The value of each row's label, null labels included."""
    out = F.lit(values.get(None, otherwise))
    known = {k: v for k, v in values.items() if k is not None}
    if not known:
        return out
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)])
    return F.when(F.col(label).isNull(), out).otherwise(F.try_element_at(table, F.col(label)))


def stratified_cuts(df: DataFrame, label: str, key: str, test_fraction: float = C.TEST_FRACTION,
                    seed: int = C.SEED) -> dict:
    """{label: (hash, key)} of each label's last test row; labels without test rows are left out."""
    rows = df.select(F.col(label).alias("l"), F.coalesce(hash_key(key, seed), F.lit("")).alias("h"), F.col(key).alias("k"))
    prefixes: dict | None = None   # {label: leading digits of the bucket that holds the cut}
    wanted: dict = {}              # {label: position of the cut inside that bucket}
    small: dict = {}
    digits = 3
    while prefixes is None or prefixes:
        open_rows = rows if prefixes is None else rows.where(F.substring("h", 1, digits - 3) == _by_label("l", prefixes))
        counts = open_rows.groupBy("l", F.substring("h", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("l")  # 4,096 buckets of each label
        placed = counts.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
        if prefixes is None:
            goal = F.round(F.lit(test_fraction) * F.col("all")).cast("long")
        else:
            goal = _by_label("l", wanted)
        cut = placed.withColumn("goal", goal).where((F.col("goal") > F.col("upto") - F.col("n")) & (F.col("goal") <= F.col("upto")))
        found = cut.select("l", "b", "n", (F.col("goal") - F.col("upto") + F.col("n")).alias("place")).limit(MAX_LABELS + 1).collect()
        if len(found) > MAX_LABELS:
            raise ValueError(f"{label} has more than {MAX_LABELS} values: not a class column")
        wanted = {r["l"]: r["place"] for r in found}
        small.update({r["l"]: r["b"] for r in found if r["n"] <= BUCKET_ROWS or digits >= 30})
        goals = {**(goals if prefixes is not None else {}), **wanted}
        prefixes = {r["l"]: r["b"] for r in found if r["l"] not in small}
        digits += 3
    if not small:
        return {}
    # The buckets of the cuts, some 10,000 rows of each label.
    inside = rows.where(F.col("h").startswith(_by_label("l", small)))
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))
    last = inside.withColumn("nth", nth).where(F.col("nth") == _by_label("l", goals)).collect()
    return {r["l"]: (r["h"], r["k"]) for r in last}


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = C.TEST_FRACTION,
                     seed: int = C.SEED) -> tuple[DataFrame, DataFrame]:
    """SP1: exact per-label test share ``round(fraction * n_label)``; deterministic for a seed.

    ``key`` must be unique.  Both sides are filters of ``df``: they can be read again and again
    without a shuffle.  A null label is a stratum of its own.
    """
    cuts = stratified_cuts(df, label, key, test_fraction, seed)
    if not cuts:
        return df, df.limit(0)
    h = F.coalesce(hash_key(key, seed), F.lit(""))
    cut_hash = _by_label(label, {k: c[0] for k, c in cuts.items()})
    cut_key = _by_label(label, {k: c[1] for k, c in cuts.items()})
    before = (h < cut_hash) | ((h == cut_hash) & (F.col(key).isNull() | (F.col(key) <= cut_key)))
    is_test = F.coalesce(before, F.lit(False))
    return df.where(~is_test), df.where(is_test)


def hash_split(df: DataFrame, key: str, test_fraction: float = C.TEST_FRACTION,
               seed: int = C.SEED) -> tuple[DataFrame, DataFrame]:
    """SP2: stateless split: test iff the hash, read as a fraction, is below ``test_fraction``.

    No shuffle at all; the per-label share is approximate.
    """
    u = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return df.where(u >= test_fraction), df.where(u < test_fraction)


def assign_folds(df: DataFrame, label: str, key: str, k: int = C.CV_FOLDS, seed: int = C.SEED,
                 out: str = "fold") -> DataFrame:
    """SP3: fold = (position within label in hash order - 1) mod k: stratified, balanced folds."""
    ranked = stratified_rank(df, label, key, seed)
    return ranked.withColumn(out, ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__n")

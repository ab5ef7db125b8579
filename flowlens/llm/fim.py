"""Fill-in-middle transformation as a pipeline of Arrow compute kernels.

Units.  A text is cut into units (white space and the word behind it, or trailing white
space); all units of a slice of texts are flattened into one array with the index of the
text each comes from and its ordinal there.

Transformation.  Two cut points a <= b and the form follow from the SHA-256 of seed and id
(computed by Spark), so a rerun and a retried task give the same texts.  Units are filtered
by role (prefix: ordinal < a, middle: a <= ordinal < b, suffix: the rest), each role's units
are rebuilt into one list per text by the role's counts, and ``binary_join`` makes the
pieces; the sentinels join them in the order of the form.  No step loops over texts.

Bytes.  Kernels run on the UTF-8 bytes: units end at ASCII white space only, and the unit
separator is a byte that no UTF-8 text holds, so any text passes unchanged.

Memory.  A slice holds at most ``SLICE_BYTES`` of text, or one text.

Results.  Null texts count as empty; empty texts, texts that hold a sentinel and the share
``100 - rate`` of all others stay plain, with null piece lengths.  A null id is hashed as
the empty text.  Rows are independent: repeated rows give equal rows, an empty table none;
other columns are not carried.  ``restore`` gives back every text from output and form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import doc_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<P>|<S>|<M>"
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
MARK = b"\xff"  # in no UTF-8 text
RATE, SPM_SHARE, SEED = 50, 80, 42
SLICE_BYTES = 8_000_000
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``SLICE_BYTES`` of ``column``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def modulo(x: pa.Array, by: pa.Array) -> pa.Array:
    """x mod by, of numbers that are not negative."""
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def joined(units: pa.Array, role: pa.Array, counts: pa.Array) -> pa.Array:
    """One binary per text: its units of a role, ``counts`` of them."""
    offsets = pa.array(np.r_[0, pc.cumulative_sum(counts).to_numpy()], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units.filter(role)), b"")


def pieces(text: pa.Array, h1: pa.Array, h2: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(number of units, prefix, middle, suffix) of binary texts."""
    lists = pc.split_pattern(pc.replace_substring_regex(text, UNIT, b"\\1" + MARK), MARK)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    n = pc.cast(pc.subtract(pc.list_value_length(lists), 1), pa.int64())  # the last item is empty: no unit
    first = pc.subtract(pc.cumulative_sum(pc.add(n, 1)), pc.add(n, 1))
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(first, parent))
    x, y = modulo(h1, pc.add(n, 1)), modulo(h2, pc.add(n, 1))
    a, b = pc.min_element_wise(x, y), pc.max_element_wise(x, y)
    before, beyond = pc.less(ordinal, pc.take(a, parent)), pc.greater_equal(ordinal, pc.take(b, parent))
    inside = pc.invert(pc.or_(before, beyond))
    suffix_items = pc.subtract(pc.add(n, 1), b)  # with the empty one, which joins as nothing
    return n, joined(units, before, a), joined(units, inside, pc.subtract(b, a)), joined(units, beyond, suffix_items)


def transformed_batch(batch: pa.RecordBatch, rate: int, spm_share: int) -> pa.RecordBatch:
    text = batch.column("text").cast(pa.binary())
    h1, h2, h3, h4 = (batch.column(h) for h in ("h1", "h2", "h3", "h4"))
    n, prefix, middle, suffix = pieces(text, h1, h2)
    hundred = pa.array(np.full(batch.num_rows, 100))
    plain = pc.or_(pc.or_(pc.equal(n, 0), pc.match_substring_regex(text, SENTINELS)),
                   pc.greater_equal(modulo(h3, hundred), rate))
    spm = pc.less(modulo(h4, hundred), spm_share)
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    output = pc.if_else(plain, text, pc.if_else(
        spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b""),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x.cast(pa.string())), pa.int64()))
             for x in (prefix, middle)]
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, *chars, output.cast(pa.string())],
                                      ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draws(seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of 8 hex digits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``; ``rate``
    per cent of the texts are transformed, ``spm_share`` per cent of these suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield transformed_batch(part, rate, spm_share)

    return doc_text(docs).select("doc_id", "text", *draws(seed)).mapInArrow(run, TRANSFORMED)


def restored_batch(batch: pa.RecordBatch) -> pa.Array:
    """The texts behind the outputs of a batch."""
    output, form = batch.column("output").cast(pa.binary()), batch.column("form")
    plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    # Outside plain rows every sentinel occurs once: an empty item, then the three pieces.
    marked = pc.if_else(plain, b"<P><S><M>", output)
    parts = pc.split_pattern_regex(marked, SENTINELS)
    first, second, middle = (pc.list_element(parts, i) for i in (1, 2, 3))
    prefix, suffix = pc.if_else(spm, second, first), pc.if_else(spm, first, second)
    return pc.if_else(plain, output, pc.binary_join_element_wise(prefix, middle, suffix, b"")).cast(pa.string())


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` of ``transform`` with the column restored: the exact text, from output and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output"):
                yield pa.RecordBatch.from_arrays([*part.columns, restored_batch(part)], [*part.schema.names, "restored"])

    return rows.mapInArrow(run, f"{TRANSFORMED}, restored string")


def query(docs: DataFrame) -> DataFrame:
    """The contract's digests of every row."""
    return restore(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(u[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

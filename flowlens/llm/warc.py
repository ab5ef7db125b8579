"""Deterministic sharded WARC writer and its reader.

Writing.  Page ids are counted in cells of their range, heavy cells again in smaller ones;
running totals over the cells give shards of about ``shard_rows`` records in id order, the
same for every layout of the input; the rows of one id (or without any) that fill several
shards are spread over these by digest.  Rows are shuffled once, by shard, and sorted by id; a task writes its shards one
record at a time, each a gzip member of its own, and rolls to the next file when the
compressed size would pass ``roll_bytes``.  A file is written under a temporary name and
moved to its final one when whole; its name depends on shard and number only, so a task
that runs again replaces its files by equal ones.  The manifest (file, records, bytes,
SHA-256, first and last id) is committed by Spark after all tasks; readers read what the
manifest lists and nothing else.

Revisits.  Of records with equal payloads of ``min_revisit`` bytes or more the one with the
smallest page id is a response, the others are revisits: headers without payload.  Digests
with several records come from a grouped minimum over (digest, id); the rows that become
revisits reach their writer as markers that travel by shard, so pages are not shuffled
again.

Reading.  Tasks stream the manifest's files member by member, check the block digest of
every record and re-hash the payload of every response.

Results.  Null html is an empty payload, null url leaves the target out.  Rows with a null
page id are written first.  Repeated rows (equal id and payload) are records of their own;
the first is the response.  An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import shared_path, written

MIN_REVISIT = 100
SHARD_ROWS = 4096
ROLL_BYTES = 64 << 20
CELLS = 16_384              # cells of the id range that are counted first
HEAVY, SPLIT_BITS = 4, 6    # times the mean that a cell may hold; bits a cut takes off a cell
MAX_TASKS = 10_000          # that write; each takes its shards one after another
DATE = "2020-01-01T00:00:00Z"
# Names of the WARC 1.1 standard.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = ("file string, shard long, records long, bytes long, sha256 string, first_id long, last_id long")
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, file string, payload binary")


def record_id(page_id: int | None, digest: str) -> str:
    """A name-based id: the same record always gets the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                revisit: bool) -> bytes:
    """One WARC record, uncompressed; a revisit carries the HTTP header only."""
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Content-Length: %d\r\n\r\n" % len(payload)) + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                 ("X-Refers-To-Page", str(refers_to))]
    head += [("X-Page-ID", str(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roll:
    """The open archive of one shard."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.limit, self.shard, self.out = roll_bytes, None, None

    def start(self, shard: int, number: int) -> None:
        self.shard, self.number = shard, number
        self.name = f"part-{shard:08d}-{number:05d}.warc.gz"
        self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.sha, self.size, self.count, self.first, self.last = hashlib.sha256(), 0, 0, None, None

    def add(self, shard: int, page_id: int | None, data: bytes) -> Iterator[tuple]:
        if self.out is not None and (shard != self.shard or self.count and self.size + len(data) > self.limit):
            number = self.number + 1 if shard == self.shard else 0
            yield self.close()
            self.start(shard, number)
        elif self.out is None:
            self.start(shard, 0)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.first = page_id if self.count == 0 else self.first
        self.last, self.count = page_id, self.count + 1

    def close(self) -> tuple:
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).type != pafs.FileType.NotFound:
            self.fs.delete_file(final)  # an earlier attempt of this task wrote the same bytes
        self.fs.move(self.temp, final)
        self.out = None
        return self.name, self.shard, self.count, self.size, self.sha.hexdigest(), self.first, self.last


class Shards:
    """Shards of about ``shard_rows`` rows in id order, from counts: the same for every layout.

    Ids are counted in aligned cells of 2**k.  A cell with more rows than a shard and ``HEAVY``
    times the mean is cut into 2**``SPLIT_BITS`` smaller ones, and again, until it is lighter
    or holds one id; running totals over the cells number the shards.  A cell of one id (or
    of the null ids) that fills several shards is spread over them by the payloads' digests, so
    equal payloads stay together.  The tables hold some CELLS rows, and a level of cuts at most
    CELLS / HEAVY cells, whatever the rows.
    """

    def __init__(self, ids: DataFrame, shard_rows: int):
        low, high, total, nulls = ids.agg(F.min("page_id"), F.max("page_id"), F.count("page_id"),
                                          F.count_if(F.col("page_id").isNull())).first()
        bits = 0 if low is None else max(0, (high - low).bit_length() - (CELLS.bit_length() - 1))
        self.bits, self.count, self.null_span = bits, (total + nulls) // shard_rows + 1, nulls // shard_rows
        heavy = max(shard_rows, HEAVY * total // CELLS)
        self.cuts: list[tuple[int, DataFrame]] = []  # (bits of the smaller cells, cells that are cut)
        mine, leaves = ids.filter(F.col("page_id").isNotNull()), None
        while True:
            cells = written(mine.groupBy(_cell(bits).alias("start")).agg(
                F.count("*").alias("n"), (F.min("page_id") == F.max("page_id")).alias("one")), "warc-cells")
            over = (F.col("n") > heavy) & ~F.col("one")
            light = cells.filter(~over)
            leaves = light if leaves is None else leaves.unionByName(light)
            cut = cells.filter(over).select(F.col("start").alias("__cut"))
            if bits == 0 or cut.isEmpty():
                break
            mine = mine.join(F.broadcast(cut), _cell(bits) == F.col("__cut"), "left_semi")
            bits = max(0, bits - SPLIT_BITS)
            self.cuts.append((bits, cut))
        before = F.sum("n").over(W.orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
        self.table = leaves.select(F.col("start").alias("__leaf"), F.floor((before + nulls) / shard_rows).alias("__first"),
                                   F.when(F.col("one"), F.floor(F.col("n") / shard_rows)).otherwise(0).alias("__span"))

    def place(self, rows: DataFrame, digest: Column) -> DataFrame:
        """``rows`` with their shard; ``digest`` spreads the rows of one id."""
        rows = rows.withColumn("__start", _cell(self.bits))
        for bits, cut in self.cuts:
            rows = rows.join(F.broadcast(cut), F.col("__start") == F.col("__cut"), "left").withColumn(
                "__start", F.when(F.col("__cut").isNotNull(), _cell(bits)).otherwise(F.col("__start"))).drop("__cut")
        rows = rows.join(F.broadcast(self.table), F.col("__start") == F.col("__leaf"), "left")
        span = F.coalesce("__span", F.lit(self.null_span))
        number = F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long")
        spread = F.when(span > 1, F.pmod(number, F.greatest(span, F.lit(1)))).otherwise(0)
        shard = (F.coalesce("__first", F.lit(0)) + spread).cast("long")
        return rows.withColumn("shard", shard).drop("__start", "__leaf", "__first", "__span")


def _cell(bits: int) -> Column:
    """The first id of the aligned cell of 2**bits ids that the page's id lies in."""
    return F.shiftleft(F.shiftright("page_id", bits), bits)


def revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, refers_to): ids whose payload a smaller id has, or which occur again."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    seen = (pages.select("page_id", payload.alias("p")).filter(F.octet_length("p") >= min_revisit)
            .select("page_id", F.sha2("p", 256).alias("digest")))
    groups = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    return (seen.join(groups.filter("n > 1").drop("n"), "digest")
            .select("page_id", "refers_to", F.unhex("digest").alias("digest")).distinct())


def write(pages: DataFrame, folder: str, shard_rows: int = SHARD_ROWS, roll_bytes: int = ROLL_BYTES,
          min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the
    committed manifest."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    shards = Shards(pages.select("page_id"), shard_rows)
    nothing = F.lit(None)
    records = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                           nothing.cast("long").alias("refers_to"), nothing.cast("binary").alias("digest"),
                           F.lit(1).alias("kind"))
    marks = revisits(pages, min_revisit).select("page_id", nothing.cast("string").alias("url"),
                                                nothing.cast("string").alias("html"), "refers_to", "digest",
                                                F.lit(0).alias("kind"))
    rows = records.unionByName(marks)
    rows = shards.place(rows, F.coalesce("digest", F.unhex(F.sha2("html", 256))))
    # Shards in turn, not by their hash: every task gets as many.
    tasks = min(shards.count, MAX_TASKS)
    ordered = (rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
               .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "html", "url"))
    out = f"{folder.rstrip('/')}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Roll(out, roll_bytes)
        marked: dict[bytes, int | None] = {}  # digests of the current page id that some record shares
        current: Any = object()
        done: set[bytes] = set()
        for batch in batches:
            files = []
            for r in batch.to_pylist():
                page = r["page_id"]
                if page != current:
                    current, marked, done = page, {}, set()
                if r["kind"] == 0:
                    marked[r["digest"]] = r["refers_to"]
                    continue
                payload = r["html"].encode()
                sha = hashlib.sha256(payload)
                key = sha.digest()
                refers = marked.get(key)
                revisit = key in marked and (refers != page or key in done)
                done.add(key)
                data = make_record(page, r["url"], payload, sha.hexdigest(), refers, revisit)
                files += roll.add(r["shard"], page, gzip_member(data))
            if files:
                yield manifest(files)
        if roll.out is not None:
            yield manifest([roll.close()])

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def manifest(files: list[tuple]) -> pa.RecordBatch:
    names = ["file", "shard", "records", "bytes", "sha256", "first_id", "last_id"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files), types)], names)


def members(stream: Any, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(chunk):
        parts.append(z.decompress(data))
        rest = b""
        if z.eof:
            yield b"".join(parts)
            rest, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive ends inside a record")


def parse(data: bytes) -> dict[str, Any]:
    """A record's fields; raises if its lengths or digests do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    block, tail = rest[:length], rest[length:]
    if not data.startswith(VERSION) or len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest does not match")
    number = lambda s: None if s in (None, "None") else int(s)
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    return {"page_id": number(fields["X-Page-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number(fields.get("X-Refers-To-Page")), "payload": None if revisit else payload}


def read(folder: str, manifest_rows: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists (``RECORD`` columns; ``payload``
    is null for revisits, or for all if not asked for)."""
    base = f"{folder.rstrip('/')}/data"
    spark = manifest_rows.sparkSession
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("file", pa.string()), ("payload", pa.binary())])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for data in members(f):
                        r = parse(data) | {"file": name}
                        if not payload:
                            r["payload"] = None
                        rows.append(r)
                        held += len(data) if payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest_rows.select("file").repartition(parts, "file").mapInArrow(run, RECORD)


def query(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back."""
    folder = shared_path(pages.sparkSession, "warc")
    files = write(pages, folder)
    return read(folder, files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                     "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS n,
             min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CAST(CASE WHEN payload_bytes >= 100 AND n > 1 THEN first_id END AS BIGINT) AS refers_to FROM r
"""

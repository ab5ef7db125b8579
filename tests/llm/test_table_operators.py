"""Operators 1, 3, 4, 5 and 6 and the pipeline against brute force and awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward_docs, rows_of, text_of
from pyspark.sql import functions as F

from flowlens.llm import components, golay, mixing, mtree, simhash, warc
from flowlens.llm.common import shared_path
from flowlens.sources.tables import read_table

SF = "/root/testdata/sf0.001"


# ---- 1: M-tree -------------------------------------------------------------------------

def brute_top_k(rows, k):
    live = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = [], set()
    for q, v in sorted(live):
        if q % 100 or q in asked:
            continue
        asked.add(q)
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in live if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "GROUP_ROWS", 60)
    monkeypatch.setattr(mtree, "PAGE_ROWS", 8)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 2)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.gauss(0, 1)]) for _ in range(6)]) for i in range(420)]
    rows += [(500 + i, [0.5] * 6) for i in range(150)]  # a hot vector: ties everywhere
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (904, [1.0, 2.0]), (905, []),
             (None, [1.0]), (1000, [3.0] * 6), (1000, [3.0] * 6), (906, [-7.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumn("v", F.lit("x"))
    got = sorted(map(tuple, mtree.top_k(df).collect()))
    assert got == brute_top_k(rows, 10)
    assert mtree.top_k(df.limit(0)).count() == 0
    few = mtree.top_k(df.filter("vec_id IN (100, 101, 102)")).collect()
    assert len(few) == 2  # all there are


def test_search_skips_distances():
    """The stored bounds save work on clustered data and change nothing."""
    rnd = np.random.default_rng(0)
    v = np.floor((rnd.normal(size=(40, 1, 8)) * 2000 + rnd.normal(size=(40, 300, 8)) * 20).reshape(-1, 8))
    top = float((v * v).sum(axis=1).max())
    tree = mtree.Subtree.load(mtree.Subtree(np.arange(len(v)), v, top).seal())
    seen = []
    plain = mtree.exact_scores
    mtree.exact_scores = lambda x, q, peak: seen.append(len(x)) or plain(x, q, peak)
    try:
        best = sorted(mtree.search([tree], -1, v[7], top, 5, np.inf), key=lambda x: (-x[0], x[1]))
    finally:
        mtree.exact_scores = plain
    want = sorted(zip((v @ v[7]).astype(int).tolist(), range(len(v))), key=lambda x: (-x[0], x[1]))[:5]
    assert best == want and sum(seen) < len(v)


# ---- 3: near-duplicates ----------------------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text_of(text)))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)][:len(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, near):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_near_duplicates_match_brute_force(spark):
    for table in (read_table(spark, SF, "documents"), awkward_docs(spark, extra=True)):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in table.select("doc_id", "text").collect()]
        groups = classes([f for _, f in rows], lambda a, b: (a ^ b).bit_count() <= 4)
        least = collections.defaultdict(list)
        for (i, _), g in zip(rows, groups):
            least[g] += [] if i is None else [i]
        want = sorted(((i, f"{f:016x}", min(least[g], default=None)) for (i, f), g in zip(rows, groups)), key=repr)
        assert rows_of(golay.query(table), "doc_id", "fingerprint", "component_id") == want
    assert golay.query(read_table(spark, SF, "documents").limit(0)).count() == 0


def test_golay_keys_miss_no_pair():
    rnd = np.random.default_rng(0)
    a = rnd.integers(-2 ** 63, 2 ** 63 - 1, 20_000)
    flips = np.zeros_like(a)
    for _ in range(4):
        flips |= np.int64(1) << rnd.integers(0, 64, a.size)
    (ra, ka), (rb, kb) = golay.fingerprint_keys(a), golay.fingerprint_keys(a ^ flips)
    held = set(zip(ra.tolist(), ka.tolist()))
    assert {r for r, k in zip(rb.tolist(), kb.tolist()) if (r, k) in held} == set(range(a.size))
    table = golay.centres()  # a perfect code: 4096 codewords own 2048 words each
    assert (np.bincount(table) == 2048).all()


def test_hot_keys_are_cut_into_blocks(spark):
    """Dense and sparse groups of fingerprints, with blocks far smaller than the groups."""
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    near = {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(400)}
    chain = [rnd.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ (0b111 << rnd.randrange(61)))
    values = sorted(near | set(chain) | {rnd.getrandbits(64) for _ in range(200)} | {0})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    for block in (16, 4096):
        root = {r["node"]: r["root"] for r in components.components(golay.links(df, block=block)).collect()}
        got = [root.get(v, v) for v in signed]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 3), (300, 301)]
    df = spark.createDataFrame(links, "a long, b long")
    root = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert root == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(1, 60), 1), 300: 300, 301: 300}
    assert components.components(df.limit(0)).count() == 0


# ---- 4: mixing -------------------------------------------------------------------------

def fill(sizes, weights, cap):
    """Shares by weight; excess over cap x size is shared again until none is above."""
    target, stopped, total = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in stopped]
        if not free:
            return target
        rest = total - sum(target[s] for s in stopped)
        for s in free:
            target[s] = rest * weights[s] / sum(weights[x] for x in free)
        above = [s for s in free if target[s] > cap * sizes[s] + 1e-9]
        if not above:
            return target
        for s in above:
            target[s] = float(cap * sizes[s])
            stopped.add(s)


def test_targets_match_refilling(spark):
    rnd = random.Random(6)
    for n in (1, 2, 7, 23):
        sizes = {f"s{i:02}": rnd.choice([0, 1, 10, 1000, 50_000]) for i in range(n)} | {None: 40}
        weights = {s: 1 + i % 3 for i, s in enumerate([*sorted(s for s in sizes if s), None])}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = fill(sizes, weights, 3)
        assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_mixing_hits_targets_and_reruns_agree(spark):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    rows = mixing.query(docs).collect()
    again = mixing.query(docs.repartition(13)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == docs.count()
    by = collections.defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        by[source[r["doc_id"]]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for part in by.values():
        miss = abs(sum(r["taken"] for r in part) - part[0]["target"])
        assert miss <= max(r["size"] for r in part) / 2 + 1
        assert sum(r["size"] for r in part) == part[0]["source_size"]


def test_mixing_spreads_rows_without_id(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").withColumn("doc_id", F.lit(None).cast("long"))
    u = docs.select(F.shiftright(mixing.uniform(), 52 - mixing.BUCKET_BITS).alias("b"), "text").distinct()
    assert u.groupBy("b").count().agg(F.max("count")).first()[0] <= 4
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["g"]) <= r["m"] / 2 + 1 for r in rows)


def test_mixing_awkward(spark):
    df = awkward_docs(spark, extra=True)
    got = mixing.mix(df)
    assert set(got.columns) >= {"size", "target", "taken", "copies", "text"} and got.count() == df.count()
    assert {r["size"] for r in got.filter("text IS NULL").collect()} == {0}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert mixed.count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.query(df.limit(0)).count() == 0


# ---- 5: SimHash ------------------------------------------------------------------------

def signed(x):
    return x - (1 << 64) if x >> 63 else x


def term_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if len(words) > 1:  # a hash of two longs is the hash of the second seeded by that of the first
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        h = [pair(a, b) for a, b in zip(h, h[1:])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("per_bucket", [7, 512])
def test_simhash_query_matches_brute_force(spark, per_bucket):
    for table in (read_table(spark, SF, "documents"), awkward_docs(spark, extra=True).filter("doc_id IS NULL OR doc_id <> 6")):
        rows = sorted(((r["doc_id"], text_of(r["text"])) for r in table.select("doc_id", "text").collect()),
                      key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
        want = []
        for k, (i, t) in enumerate(rows):
            nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
            edited = t[:len(t) - half] + nxt[:half]
            fp, efp, nfp = map(term_fingerprint, (t, edited, nxt))
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), signed(fp), signed(efp), signed(nfp)))
        got = rows_of(simhash.compare_with_edits(table, per_bucket), "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
                      "next_fp")
        assert got == sorted(want, key=repr)
    assert simhash.query(awkward_docs(spark).limit(0)).count() == 0
    one = simhash.query(awkward_docs(spark).filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_permuted_tables_find_all_near_pairs(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(60)]
    values = {0, *base}
    for b in base:
        for n in range(1, 7):
            values.add(b ^ sum(1 << x for x in rnd.sample(range(64), n)))
    values = sorted(values)
    df = spark.createDataFrame([(signed(v),) for v in values] + [(signed(values[0]),), (None,)], "fp long")
    for radius in (0, 3, 4):
        want = sorted((*sorted((signed(a), signed(b))), (a ^ b).bit_count()) for i, a in enumerate(values)
                      for b in values[:i] if (a ^ b).bit_count() <= radius)
        assert rows_of(simhash.near_pairs(df, radius), "a", "b", "distance") == sorted(want, key=repr)


def test_simhash_plan_has_no_python(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        simhash.query(awkward_docs(spark)).explain()
        mixing.query(awkward_docs(spark)).explain()
    assert not re.search("Python|Pandas|Arrow|Cartesian", out.getvalue())


# ---- 6: WARC ---------------------------------------------------------------------------

def awkward_pages(spark):
    big = "<p>" + "x" * 200_000 + "</p>"
    same = "<html>" + "same text " * 20 + "</html>"
    rows = [(5, "http://a/5", same), (3, "http://a/3 b\r\nEvil: 1", same), (9, None, same), (7, "u", None), (8, "u", ""),
            (10, "u", "short"), (11, "u", "short"), (12, "ü", big), (2, "v", big), (3, "again", same), (20, "z", "é" * 99),
            (21, "z", "é" * 49 + "ab"), (22, "z", "é" * 49 + "ab"), (None, "n", "no id"), (10 ** 12, "far", "away"), (40, "a\r\n\r\nb", "WARC/1.1\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))


def test_warc_awkward_pages_and_rolling(spark):
    pages = awkward_pages(spark)
    folder = shared_path(spark, "warc-test")
    files = warc.write(pages, folder, shard_rows=6, roll_bytes=300)
    rows = warc.read(folder, files).collect()
    assert files.count() > 6 and all(r["records"] >= 1 for r in files.collect())
    assert sorted((r["page_id"] for r in rows), key=repr) == sorted((r["page_id"] for r in pages.collect()), key=repr)
    html = collections.defaultdict(set)
    for r in pages.collect():
        html[r["page_id"]].add(hashlib.sha256(text_of(r["html"]).encode()).hexdigest())
    for r in rows:
        assert r["payload_digest"] in html[r["page_id"]]
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and r["refers_to"] is None
            assert len(r["payload"]) == r["payload_bytes"]
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in rows if r["page_id"] in (2, 3, 5, 9, 12, 21, 22)),
                   key=repr)
    assert kinds == sorted([(2, "response", None), (12, "revisit", 2), (3, "response", None), (3, "revisit", 3), (5, "revisit", 3),
                            (9, "revisit", 3), (21, "response", None), (22, "revisit", 21)], key=repr)
    assert warc.query(pages.limit(0)).count() == 0


def test_warc_shards_hold_skewed_ids(spark, monkeypatch):
    """A far id, ids of the whole range, a third of rows without id and a repeated id: no shard takes them all."""
    monkeypatch.setattr(warc, "CELLS", 16)
    monkeypatch.setattr(warc, "SPLIT_BITS", 2)
    rows = [(i, "u", f"page {i} " * 20) for i in range(-300, 300)]
    rows += [(None, "u", f"none {i % 250} " * 20) for i in range(400)] + [(7, "u", f"seven {i} " * 20) for i in range(300)]
    rows += [(2 ** 63 - 1, "far", None), (-2 ** 63, "far", "x" * 200), (10 ** 15, "far", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    files = warc.write(pages, shared_path(spark, "warc-test"), shard_rows=50)
    assert files.groupBy("shard").agg(F.sum("records").alias("n")).agg(F.max("n")).first()[0] <= 200
    got = warc.read(files.inputFiles()[0].split("/manifest")[0].removeprefix("file://").removeprefix("file:"), files).collect()
    assert collections.Counter(r["page_id"] for r in got) == collections.Counter(r[0] for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append(r)
    for same in by.values():  # one response of least id for each payload that counts
        if same[0]["payload_bytes"] >= 100:
            assert sum(r["record_type"] == "response" for r in same) == 1
            ids = [r["page_id"] for r in same if r["page_id"] is not None]
            assert all(r["refers_to"] == (min(ids) if ids else None) for r in same if r["record_type"] == "revisit")


def test_warc_files_do_not_depend_on_layout(spark):
    pages = read_table(spark, SF, "pages")
    names = []
    for table in (pages.repartition(1), pages.repartition(9)):
        files = warc.write(table, shared_path(spark, "warc-test"), shard_rows=20, roll_bytes=20_000)
        names.append(rows_of(files, "file", "records", "bytes", "sha256", "first_id", "last_id"))
    assert names[0] == names[1]


# ---- pipeline --------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = read_table(spark, "/root/testdata/sf0.01", "documents").withColumn("size", F.lit(7))
    out = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.01")
        path = shared_path(spark, f"test-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
        if name != "bpe":
            assert docs.columns == before.columns, name
    source = read_table(spark, "/root/testdata/sf0.01", "documents")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    kept = out["toxicity"]
    lost = labels.filter("toxic = 0").join(source, "doc_id").join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.02 * labels.count() and kept.join(labels.filter("toxic = 1"), "doc_id").count() < 20
    # One document of each class of the toxicity stage's survivors stays.
    found = golay.near_duplicates(kept)
    assert rows_of(out["near_dedup"], "doc_id") == rows_of(found.select("component_id").distinct(), "component_id")
    texts = [r["text"] for r in out["pii"].select("text").collect()]
    from flowlens.llm import pii

    assert not any(pii.base_spans(t) for t in texts) and any("<phone>" in t for t in texts)
    assert all(r["n_chars"] == len(r["text"]) for r in out["pii"].collect())
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(out["pii"]).collect()}
    copies = collections.Counter(r["doc_id"] for r in out["mixing"].select("doc_id").collect())
    assert copies == {i: n for i, n in plan.items() if n}
    assert out["bpe"].count() == out["mixing"].count()
    for r in out["bpe"].limit(20).collect():
        assert r["n_tokens"] == len(r["ids"])


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline as cp

    for docs in (awkward_docs(spark, extra=True), awkward_docs(spark).limit(0)):
        for name, stage in cp.STAGES:
            columns, docs = docs.columns, stage(spark, docs, SF)
            path = shared_path(spark, f"test-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "bpe" or docs.columns == columns


def test_near_dedup_tells_rows_apart_without_ids(spark):
    """Null ids and an id with two texts: only copies go, and the survivor is a row of its own group."""
    from flowlens.llm import stages

    texts = [" ".join(f"{name}{k}" for k in range(40)) for name in ("one", "two", "six", "sun", "tea")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]),
            (3, texts[3]), (5, texts[4]), (5, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(stages.drop_near_copies(spark, docs, ""), "doc_id", "text")
    assert got == sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (5, texts[4])], key=repr)

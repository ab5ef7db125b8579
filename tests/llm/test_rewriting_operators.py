"""Fill-in-middle, FM-index decontamination and Orchard vector codes against brute force and SQL twins."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from helpers import awkward_docs, rows_of, text_of
from pyspark.sql import functions as F

from flowlens.llm import fim, fmindex, orchard, queries
from flowlens.sources.tables import table_path

SF = "/root/testdata/sf0.001"
SPACE = "\x20\t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_fm_decontamination", "op13_orchard_codes"])
def test_query_matches_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=repr) == rows_of(df, *df.columns)


# Fill-in-middle


def fim_by_hand(doc_id, text):
    units = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text)
    h = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_docs(spark):
    more = [(i, t, None, None, None) for i, t in enumerate(
        [" ", "\n a", "<P", "<", "a<S>b", "<M>", "x <P", "< S>", "\x00 \x01", "é　ü \U0001f600", "tail \n\t", "a", "<<", "P>"] * 12, 200)]
    schema = awkward_docs(spark).schema
    return awkward_docs(spark).unionByName(spark.createDataFrame(more, schema))


def test_fim_is_the_definition_and_restores_exactly(spark, monkeypatch):
    docs = fim_docs(spark)
    want = sorted((fim_by_hand(r["doc_id"], text_of(r["text"])) for r in docs.collect()), key=repr)
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    for size in (fim.SLICE_BYTES, 40):  # also when every slice is one text
        monkeypatch.setattr(fim, "SLICE_BYTES", size)
        got = fim.transform(docs)
        assert rows_of(got, *got.columns) == want
    restored = fim.restore(fim.transform(docs)).select("doc_id", "restored")
    assert rows_of(restored, "doc_id", "restored") == sorted(((r["doc_id"], text_of(r["text"])) for r in docs.collect()), key=repr)
    every = fim.restore(fim.transform(docs, rate=100, spm_share=0))
    assert every.filter("form = 'spm'").count() == 0 and every.filter("form = 'psm'").count() > 100
    assert rows_of(every, "doc_id", "restored") == rows_of(restored, "doc_id", "restored")


def test_fim_query_of_awkward_extra_and_empty_tables(spark):
    got = fim.query(awkward_docs(spark, extra=True))
    want = [(*r[:5], sha(r[5]), sha(text_of(d["text"]))) for d in awkward_docs(spark).collect()
            for r in [fim_by_hand(d["doc_id"], text_of(d["text"]))]]
    assert rows_of(got, *got.columns) == sorted(want, key=repr)
    assert fim.query(awkward_docs(spark).limit(0)).collect() == []


# FM-index


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_by_hand(docs, items, size=10):
    """(doc_id, n_words, hit words, items) by looking at every place of every text."""
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in wins}:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def leak_case(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ärger", "naïve", "X1"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, text(25)), (10, text(10)), (2, "w1 w2"), (3, "only"), (4, ""), (None, text(12)), (5, None), (6, " .,; "),
             (1, text(11)), (7, "a a a a a a a a a a a a a")]
    long_item = words(items[0][1])
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(150)]
    docs += [(200, text(5) + " " + items[0][1].upper() + " " + text(5)), (201, items[1][1].replace(" ", ",\n")),
             (202, " ".join(long_item[3:14])), (203, " ".join(long_item[3:12])), (204, None), (204, ""), (None, items[5][1]),
             (205, "a " * 40), (206, "w1-W2 . w1 w2"), (207, text(3000) + " " + items[0][1]), (208, "x" * 5000), (209, "w1w2 onlyx")]
    docs += [(300 + i, "prefix " + items[0][1]) for i in range(40)]  # copies
    schema = "doc_id long, text string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("shard_words", [fmindex.SHARD_WORDS, 150, 7])
def test_decontamination_is_brute_force_for_any_shard_and_block_size(spark, shard_words):
    docs, benchmark, rows, items = leak_case(spark)
    index = fmindex.build_index(docs.coalesce(2), shard_words)
    found = fmindex.search(index, fmindex.windows(benchmark), block=1000 if shard_words > 100 else 9)
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]),
            sha(",".join(r["items"])), bool(r["spans"])) for r in found.collect()]
    assert sorted(got, key=repr) == hits_by_hand(rows, items)
    assert all(a["end"] < b["start"] for r in found.collect() for a, b in zip(r["spans"], r["spans"][1:]))


def test_decontamination_query_of_awkward_extra_and_empty_tables(spark):
    docs, benchmark = awkward_docs(spark, extra=True), leak_case(spark)[1]
    got = fmindex.query(docs, benchmark.withColumn("phrase", F.lit("clash")))
    want = hits_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], leak_case(spark)[3])
    assert rows_of(got, *got.columns) == want
    assert fmindex.query(docs.limit(0), benchmark).collect() == []
    none = fmindex.query(docs, benchmark.limit(0))
    assert none.filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and none.count() == docs.count()


def test_removal_spans_are_cut_out_of_the_texts(spark):
    docs, benchmark, _, items = leak_case(spark)
    docs = docs.withColumn("h1", F.lit("kept")).withColumn("spans", F.lit(1))
    clean = fmindex.decontaminated(docs, fmindex.hits(docs, benchmark))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.filter("doc_id >= 200").collect()}
    assert texts[201] == "" and texts[202] == "" and texts[208] == "x" * 5000 and texts[209] == "w1w2 onlyx"
    assert texts[300] == "prefix " and texts[206] == ""  # touching spans are one
    assert rows_of(clean.filter("doc_id = 203"), "text") == rows_of(docs.filter("doc_id = 203"), "text")
    assert clean.filter("h1 = 'kept' AND spans = 1").count() == docs.count()


def test_fm_index_finds_every_occurrence(spark):
    rnd = random.Random(8)
    texts = [[b"%d" % rnd.randrange(4) for _ in range(rnd.randrange(0, 90))] for _ in range(60)] + [[b"1"] * 300] * 2
    shard = fmindex.Shard.load(fmindex.Shard.build(texts))
    phrases = [[b"%d" % rnd.randrange(4) for _ in range(rnd.choice((1, 2, 3, 5)))] for _ in range(80)] + [[b"1"] * 10]
    sizes = np.array([len(p) for p in phrases])
    table = np.zeros((len(phrases), 10), np.int64)
    for row, p in zip(table, phrases):
        row[10 - len(p):] = [shard.symbol[w] for w in p]
    at, low, high = shard.ranges(table, sizes)
    found = {int(p): sorted(shard.locate(np.arange(a, b)).tolist()) for p, a, b in zip(at, low, high)}
    for i, p in enumerate(phrases):
        want = [s + k for s, t in zip(shard.starts.tolist(), texts) for k in range(len(t) - len(p) + 1) if t[k:k + len(p)] == p]
        assert found.get(i, []) == sorted(want)


# Orchard codes


def codes_by_hand(rows, entries=64):
    """Definition of the contract with Python integers: {vec_id: (code, error)}, digest."""
    kept = sorted((i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows)
    width = len(kept[0][1]) // 16
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v in kept[:entries]] for p in range(16)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            groups = {}
            for _, v in kept:
                groups.setdefault(best(part(v, p), books[p])[1], []).append(part(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = {}
    for i, v in kept:
        found = [best(part(v, p), books[p]) for p in range(16)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n,spread", [(300, 2), (300, 300), (40, 2), (1, 1)])
def test_codes_are_brute_force(spark, n, spread):
    rng = np.random.default_rng(n + spread)
    # A small spread makes ties and equal entries common.
    data = [(int(i), (rng.integers(-spread, spread, 32) / 256 + 0.001).astype(np.float32).tolist(), int(i) % 3 or None)
            for i in rng.permutation(n * 2)[:n]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5)
    codes, digest = codes_by_hand([(i, v) for i, v, _ in data])
    errors = {}
    for i, _, g in data:
        errors[g] = errors.get(g, 0) + codes[i][1]
    got = orchard.query(df.withColumn("code", F.lit("clash")).withColumn("v", F.lit(0)))
    assert rows_of(got, *got.columns) == sorted(((i, *codes[i], errors[g], digest) for i, _, g in data), key=repr)


def test_search_skips_most_distances_and_is_exact():
    rng = np.random.default_rng(4)
    book, x = rng.integers(-500, 500, (64, 4)), rng.integers(-500, 500, (5000, 4))
    x[:1000] = book[rng.integers(0, 64, 1000)] + rng.integers(-20, 20, (1000, 4))
    entry, square, computed = orchard.Codebook(book).nearest(x)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()
    assert computed < 0.8 * every.size
    assert orchard.Codebook(book).nearest(x[:1000])[2] < 0.3 * 64 * 1000


def test_codes_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (2, None, 1), (3, [nan] + [0.0] * 15, 1), (4, [inf] * 16, None), (5, [None] * 16, 1),
            (None, [0.25] * 16, None), (6, [1e30] * 16, None), (7, [0.1] * 5, 2), (8, [], 2), (9, [-1e30] * 20, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = orchard.query(df).collect()
    assert sorted((r["vec_id"] for r in got), key=repr) == sorted([1, 1, None, 6, 7, 8, 9], key=repr)
    assert all(len(r["code"]) == 32 and r["error"] >= 0 for r in got)
    assert len({r["label_error"] for r in got if r["vec_id"] in (None, 6)}) == 1
    assert orchard.query(df.limit(0)).collect() == []
    assert orchard.query(df.filter("vec_id = 2")).collect() == []
    assert {r["code"] for r in orchard.query(df.filter("vec_id = 8")).collect()} == {"00" * 16}

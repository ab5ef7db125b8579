"""Operators 2, 7, 8, 9 and 10 against brute force, held-out accuracy and awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward_docs, rows_of, text_of

from flowlens.llm import bpe, langid, ngram_lm, pii, queries, toxicity
from flowlens.llm.common import doc_text, map_arrow, takes_worker
from flowlens.sources.tables import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


# ---- 2: BPE ----------------------------------------------------------------------------

def test_bpe_query_matches_the_library(spark, docs, tokenizer):
    for table in (docs, awkward_docs(spark, extra=True)):
        got = rows_of(bpe.query(table, queries.tokenizer_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = tokenizer.encode(text_of(r["text"]), add_special_tokens=False).ids
            text = tokenizer.decode(ids, skip_special_tokens=False)
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want, key=repr)


def test_bpe_fuzz_and_long_words(tokenizer):
    codec = bpe.BpeCodec(bpe.read_spec(queries.tokenizer_path()))
    rnd = random.Random(3)
    pool = "aà é'slt  \n\t\x1c\x85\xa0 中文😀́<|endoftext|>09.,!#"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += ["ab1" * 700, "é" * 900, " " * 900, "<|endoftext|>" * 2, "".join(map(chr, range(0x250)))]
    for t in texts:
        ids = np.frombuffer(codec.encode_bytes(t), "<u4").tolist()
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids
        assert codec.decode_ids(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    for w in (b"hello", b"x" * 50, "straße".encode() * 5):  # both ways of merging agree
        assert codec._by_scan(w) == codec._by_heap(w)


def test_bpe_holds_every_text_once(tokenizer, monkeypatch):
    codec = bpe.BpeCodec(bpe.read_spec(queries.tokenizer_path()))
    text = "word word word, it's 12 12, word"
    codec.encode_bytes(text)
    held = [k for v in vars(codec).values() if isinstance(v, dict) for k in v if isinstance(k, str) and "word" in k]
    assert sorted(held) == [" word", " word,", "word"]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 4)  # given up and filled again in the middle of a text
    ids = np.frombuffer(codec.encode_bytes(text * 3), "<u4").tolist()
    assert ids == tokenizer.encode(text * 3, add_special_tokens=False).ids
    assert len(codec.known) <= 4


def test_a_worker_lets_go_of_what_the_operator_before_kept(spark, docs):
    """One worker runs BPE and then toxicity: the codec and its words are gone when the second begins."""
    def seen(batch):
        held = bpe.codec.cache_info().currsize
        return pa.RecordBatch.from_arrays([pa.array([held] * batch.num_rows, pa.int64())], ["held"])

    seen.__module__ = toxicity.__name__
    one = doc_text(docs.limit(20)).coalesce(1)
    bpe.query(one, queries.tokenizer_path()).collect()
    spec = bpe.read_spec(queries.tokenizer_path())
    bpe.codec(spec)  # as in a worker, here in this process
    takes_worker(bpe.__name__)
    assert bpe.codec.cache_info().currsize == 1
    takes_worker(toxicity.__name__)
    assert bpe.codec.cache_info().currsize == 0
    assert {r[0] for r in map_arrow(one, seen, "held long").collect()} == {0}


def test_bpe_round_trip_keeps_columns(spark):
    df = awkward_docs(spark, extra=True)
    coded = bpe.with_ids(df, queries.tokenizer_path())
    assert set(coded.columns) == set(df.columns)  # the clashing ids column is replaced
    back = bpe.decode(coded.drop("text"), queries.tokenizer_path())
    assert rows_of(back, "doc_id", "text") == sorted(((r["doc_id"], text_of(r["text"])) for r in df.collect()), key=repr)
    assert bpe.query(df.limit(0), queries.tokenizer_path()).count() == 0


# ---- 7: toxicity -----------------------------------------------------------------------

def test_toxicity_held_out_and_located(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    rows = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = [(truth[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in truth]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.01
    model = toxicity.Model({"loser": 12.0}, -10.0, 0.0)
    found = toxicity.locate(spark.createDataFrame([(1, "Fine words. You Loser, you!\nMore.")], "doc_id long, text string"),
                            model).collect()
    assert [r["sentence"].strip() for r in found] == ["You Loser, you"]


def test_toxicity_score_is_noisy_or():
    model = toxicity.Model({"bad": 9.0, "ugly*": 8.0, "ugly": 1.0}, -8.0, 0.01)
    text = "A bad day. Ugly bad bad! Plain"
    clean = 1 - model.leak
    for _, _, p in model.sentences(text):
        clean *= 1 - p
    assert math.isclose(model.score(text, {}), 1 - clean, rel_tol=1e-9)
    assert model.score("", {}) == pytest.approx(0.01)


def test_toxicity_learns_words_outside_the_sample(spark, monkeypatch):
    """Features are screened over all labelled rows; the sample serves the gradient only."""
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 12)
    rows = [(i, f"plain{i} talk. " + (f"you zorgle number{i}" if i % 6 == 0 else f"word{i} here"), int(i % 6 == 0))
            for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any(f.startswith("zorg") for f in model.weights) and not any(f.startswith("plai") for f in model.weights)


def test_toxicity_feature_counts_are_brute_force(spark):
    rows = [("You loser! Fine day.", 1), ("You loser! Fine day.", 1), ("Fine day|loser", 0), ("", 0), ("losers' Überlosers", 1)]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    want = collections.Counter()
    for y, s in {(y, s) for t, y in rows for s in toxicity.SENTENCE.findall(t.lower())}:
        for f in {toxicity.ALL, *[f for w in toxicity.LETTERS.findall(s) for f in toxicity.features(w)]}:
            want[f, y] += 1
    got = {r["feature"]: (r["toxic"], r["clean"]) for r in toxicity.feature_counts(df).collect()}
    assert got == {f: (want[f, 1], want[f, 0]) for f, _ in want}


def test_toxicity_sample_is_bounded_and_takes_equal_rows_once(spark, monkeypatch):
    seen = []
    count = toxicity.feature_counts
    monkeypatch.setattr(toxicity, "feature_counts", lambda rows: seen.append(rows.count()) or count(rows))
    rows = [(i, f"word{i} is fine. you thing{i} loser!" if i % 4 == 0 else f"word{i} is fine.", int(i % 4 == 0)) for i in range(300)]
    rows += [(5000, "one hot id is fine.", 0)] * 400 + [(5001, f"hot id {i} is fine.", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").distinct()
    toxicity.train(df.select("doc_id", "text"), labels, None, 120, 60)
    model = toxicity.train(df.select("doc_id", "text"), labels)
    assert seen == [120, 501] and model.score("you loser", {}) > 0.5 > model.score("word7 is fine", {})


def test_toxicity_awkward(spark):
    df = awkward_docs(spark, extra=True)
    labels = spark.createDataFrame([(1, 0), (2, 0), (6, 1), (9, 0), (None, 1), (8, None), (77, 1), (100, 0)],
                                   "doc_id long, toxic int")
    got = toxicity.query(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.query(df, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.query(df.limit(0), labels).count() == 0


# ---- 8: language id --------------------------------------------------------------------

def test_language_id_held_out(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r for r in langid.query(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [(truth[i], r["lang_pred"]) for i, r in rows.items() if r["held_out"]]
    assert len(rows) == len(truth) and np.mean([a == b for a, b in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())


def brute_grams(text):
    words = "".join(c if langid.letters()[ord(c)] != langid.BORDER else " " for c in text.lower()).split()
    out = collections.Counter()
    for w in words:
        padded = f"_{w}_"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                if padded[i:i + n] != "_":
                    out[padded[i:i + n]] += 1
    return out


def test_language_grams_match_brute_force():
    code = lambda g: sum((langid.BORDER if c == "_" else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    for text in ("The cat's pyjamas -- a b", "x", "Grüße, 12 élan!", "😀 a\U00010400b"):
        want = {code(g): n for g, n in brute_grams(text).items()}
        codes, counts = np.unique(langid.grams(langid.letter_codes(text.lower())[0])[0], return_counts=True)
        assert dict(zip(codes.tolist(), counts.tolist())) == want
        bag = collections.Counter(text.lower().split())
        again = langid.gram_counts(bag)
        assert dict(zip(again[0].tolist(), again[1].tolist())) == want


def test_language_profiles_cover_all_training_rows(spark, docs):
    profiles = langid.train(docs)
    for lang in ("en", "de"):
        total = collections.Counter()
        for r in docs.filter(docs.lang == lang).select("text").collect():
            total.update(brute_grams(r["text"]))
        code = lambda g: sum((langid.BORDER if c == "_" else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        want = [c for c, _ in sorted(((code(g), n) for g, n in total.items()), key=lambda x: (-x[1], x[0]))[:langid.PROFILE]]
        k = profiles.names.index(lang)
        got = sorted((r, c) for c, r in zip(profiles.codes.tolist(), profiles.ranks[:-1, k].tolist()) if r >= 0)
        assert [c for _, c in got] == want


def test_language_id_awkward(spark):
    df = awkward_docs(spark, extra=True)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.query(df).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (12, "und")} <= got and (1, "en") in got
    unlabelled = df.withColumn("lang", df.lang.substr(100, 1).cast("string")).withColumn("lang", df.n_chars.cast("string"))
    assert langid.query(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in langid.query(unlabelled.withColumn("lang", F.lit(None))).collect()} == {"und"}


# ---- 9: PII ----------------------------------------------------------------------------

def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_match_plain_patterns():
    rnd = random.Random(2)
    for _ in range(8000):
        t = "".join(rnd.choice("01234567890123456789..  --@@ab+%()é\n") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_query_and_awkward(spark, docs):
    for table in (docs, awkward_docs(spark, extra=True)):
        got = pii.query(table).collect()
        texts = collections.defaultdict(list)
        for r in table.select("doc_id", "text").collect():
            texts[r["doc_id"]].append(text_of(r["text"]))
        assert len(got) == table.count()
        for r in got:
            base = [plain_spans(t) for t in texts[r["doc_id"]]]
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in base]
            assert r["base_sha256"] in {hashlib.sha256(j.encode()).hexdigest() for j in joined}
            assert tuple(r[f"n_{k}"] for k in pii.KINDS) in {tuple(sum(x[0] == k for x in s) for k in pii.KINDS) for s in base}
            assert any(set(filter(None, j.split(","))) <= set(r["spans"].split(",")) for j in joined)
    assert pii.query(docs.limit(0)).count() == 0


def test_model_finds_what_it_learned_and_dp_is_exact(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    w = pii.train(docs)
    texts = [r["text"] for r in docs.select("text").collect()]
    base = [(t, s) for t in texts for s in pii.base_spans(t)]
    found = sum(s in [x for a, b in pii.windows(t) for x in pii.Lattice(t, a, b).best(w)] for t, s in base)
    assert found >= 0.95 * len(base)
    text = "a@b.co 1.2.3.4"
    lattice = pii.Lattice(text, 0, len(text))
    rnd = np.random.default_rng(1)
    w = rnd.normal(size=1 << pii.BITS)
    segments = [(i, j, k, float(w[f].sum())) for j, row in enumerate(lattice.by_end) for i, k, f in row]
    best = 0.0
    for n in range(1, 4):  # brute force over sets of disjoint segments
        for combo in itertools.combinations(segments, n):
            spans = sorted((i, j) for i, j, _, _ in combo)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                best = max(best, sum(x for _, _, _, x in combo))
    where = {(k, lattice.cuts[i], lattice.cuts[j]): x for i, j, k, x in segments}
    assert sum(where[s] for s in lattice.best(w)) == pytest.approx(best)


def test_redaction():
    text = "mail bob@x.org now"
    assert pii.redact_text(text, pii.base_spans(text)) == "mail <email> now"
    assert pii.redact_text("abc", []) == "abc"


# ---- 10: language model ----------------------------------------------------------------

def test_lm_base_score_matches_brute_force(spark, docs):
    for table in (docs, awkward_docs(spark, extra=True), awkward_docs(spark).filter("doc_id = 77")):
        rows = table.select("doc_id", "text").collect()
        low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), text_of(t))
        tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
        rest = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
        c = collections.Counter(w for r in rows if rest(r["doc_id"]) != 2 for w in tokens(r["text"]))
        n, v = sum(c.values()), len(c)
        want = sorted(((r["doc_id"], rest(r["doc_id"]) == 2, len(tokens(r["text"])), sum(c[w] > 0 for w in tokens(r["text"])), n,
                        round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r["text"])), 4)) for r in rows), key=repr)
        got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))
                      for r in ngram_lm.query(table).collect()), key=repr)
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert np.allclose([x[5] for x in got], [x[5] for x in want], atol=2e-3)


class BruteModel:
    """Counts of tuples, and the automaton's recursion written out."""

    def __init__(self, texts):
        self.count = collections.Counter()
        for t in texts:
            words = [None, *ngram_tokens(t)]
            self.count.update((w,) for w in words[1:])
            for size in (2, 3):
                self.count.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
        self.n = sum(c for g, c in self.count.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.count)
        self.count = collections.Counter({g: c for g, c in self.count.items() if len(g) == 1 or c >= ngram_lm.MIN_COUNT})
        self.taken = collections.Counter()
        for g, c in self.count.items():
            if len(g) > 1:
                self.taken[g[:-1]] += c - ngram_lm.DISCOUNT

    def p(self, context, w):
        if not context:
            return (self.count[(w,)] + 1) / (self.n + self.v + 1)
        left = 1 - self.taken[context] / self.count[context] if self.taken[context] else 1.0
        c = self.count[(*context, w)]
        return (max(0, c - ngram_lm.DISCOUNT) / self.count[context] if c else 0.0) + left * self.p(context[1:], w)

    def score(self, text):
        words = [None, *ngram_tokens(text)]
        return sum(math.log10(self.p(tuple(words[max(0, i - 2):i]), words[i])) for i in range(1, len(words)))


def ngram_tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text_of(text))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_lm_traversal_is_the_brute_force_model(spark, docs, monkeypatch):
    """Every word and repeated n-gram counts, whatever the buckets, chunks, flushes and rounds."""
    from flowlens.llm.common import crc_mod

    for table in (docs, awkward_docs(spark, extra=True)):
        train = table.filter(crc_mod("doc_id", 7) != 2)
        model = BruteModel([r["text"] for r in train.collect()])
        want = sorted(((r["doc_id"], round(model.score(r["text"]), 2)) for r in table.select("doc_id", "text").collect()), key=repr)
        got = [ngram_lm.query(table)]
        with monkeypatch.context() as m:
            for name, value in (("BUCKET_BYTES", 5_000), ("CHUNK_BYTES", 9_000), ("FLUSH_BYTES", 3_000), ("STRETCH", 100), ("WINDOW", 7), ("HOT_ROWS", 1)):
                m.setattr(ngram_lm, name, value)
            arcs, buckets, n, v = ngram_lm.build(train, rounds=2)
            assert (n, v) == (model.n, model.v)
            got.append(ngram_lm.score(table, arcs, buckets, n, v, rounds=2))
            for rows in (sorted(((r["doc_id"], r["score"]) for r in x.collect()), key=repr) for x in got):
                a, b = sorted(rows, key=lambda r: (repr(r[0]), r[1])), sorted(want, key=lambda r: (repr(r[0]), r[1]))
                assert [x[0] for x in a] == [x[0] for x in b]
                assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=0.02, rtol=1e-5)


def test_lm_is_a_distribution_and_beats_the_base(spark, docs):
    model = BruteModel([r["text"] for r in docs.limit(40).collect()])
    words = [g[0] for g in model.count if len(g) == 1]
    contexts = [g for g in model.taken][:30] + [(), ("nowhere",), ("nowhere", words[0])]
    for context in contexts:
        total = sum(model.p(context, w) for w in words) + model.p(context, "a word that no text holds")
        assert total == pytest.approx(1.0, abs=1e-9)
    held = [r for r in ngram_lm.query(read_table(spark, "/root/testdata/sf0.01", "documents")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_repeated_rows_are_each_scored(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "HOT_ROWS", 3)
    df = spark.createDataFrame([(None, "a b a b a b")] * 50 + [(1, "a b"), (2, "a c"), (2, "a c")], "doc_id long, text string")
    got = ngram_lm.query(df).collect()
    assert len(got) == 53 and len({r["score"] for r in got if r["doc_id"] is None}) == 1 and sum(r["doc_id"] == 2 for r in got) == 2


def test_lm_word_keys_tell_words_apart():
    texts = [b"Ab aB  b\x00a ab\tab\x1cc", b"", b"x" * 3000 + b" " + b"x" * 3001, b"\xc3\xa9 E e"]
    keys, sizes = ngram_lm.word_keys(texts)
    words = [w.lower() if w.isascii() else w for t in texts for w in [*re.split(rb"[\x20\x09-\x0D]+", t.strip(b" \t\n\x0b\x0c\r")), b"END"] if w]
    assert sizes.tolist() == [6, 1, 3, 4] and keys.size == 15
    assert len(set(zip(words, keys[1:].tolist()))) == len(set(words)) == len(set(keys.tolist()))



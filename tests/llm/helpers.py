"""Small tables with every awkward case, shared by the operator tests."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_docs(spark, extra: bool = False):
    """Nulls in any column, empty and blank texts, repeated rows and texts, a very long text,
    a very long word, white space of all kinds and characters beyond the basic plane."""
    rnd = random.Random(5)
    words = ["der", "die", "the", "of", "and", "que", "la", "loser", "Ünter", "naïve", "x1"]
    long_text = " ".join(rnd.choice(words) for _ in range(30_000))
    rows = [
        (1, "The cat sat on the mat and the dog sat on the log.", "en", "a"),
        (2, "The cat sat on the mat and the dog sat on the log!", "en", "a"),
        (3, None, "en", "b"), (4, "", None, None), (5, " \t\n\x0b\x0c\r ", "de", "b"),
        (6, long_text, "de", "c"), (7, "w" * 5000, "fr", "c"),
        (8, "mail bob.x@site.example.org or +1 (555) 010-2000, card 4111 1111 1111 1111 at 10.0.0.255", "en", None),
        (9, "one", "es", "a"), (9, "one", "es", "a"), (10, "  sp ace \U0001f600 <|endoftext|> 'll", "xx", "\U0001f600"),
        (None, "no id here at all, really none", "en", "a"), (11, "no id here at all, really none", None, "b"),
        (12, "123 456 !!", "en", "a"), (100, "Grüße aus München", "de", "ä"),
    ]
    table = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
    df = spark.createDataFrame(table, DOC_SCHEMA)
    if extra:
        for name in ("fingerprint", "fp", "component_id", "size", "target", "copies", "ids", "score", "spans", "kind",
                     "bucket", "row", "key", "node", "root", "toxic", "word", "n", "held_out", "taken", "__row"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def text_of(t):
    return t or ""

"""Small tables with nulls, empty and long texts, ties, repeated rows and
columns whose names clash with the operators' own."""

import random

import public_tokenizers
from pyspark.sql import functions as F

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

_SYLLABLES = "an be co du el fi go ha in jo ku la me no or pa qui ra so tu".split()


def prose(seed, words):
    rng = random.Random(seed)
    said = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for i in range(7, words, 9):
        said[i] += rng.choice([".", ",", "!", ".\n"])
    return " ".join(said)


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def odd_rows():
    """Rows that every operator over documents must take."""
    long = prose(1, 30_000)
    return [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (None, prose(2, 40), None, "b", None), (None, None, None, None, None),
        (3, long, "en", "a", 1), (4, prose(3, 60), "en", "b", 1), (4, prose(3, 60), "en", "b", 1), (5, prose(3, 60), "de", "c", 1),
        (6, "one", "en", "a", 3), (7, " \n\t ", "en", "a", 4), (8, "Ünïcode 日本語 😀 <|endoftext|> ΑΣ \x00   x", "fr", "c", 9),
        (-9, "the " * 300, "en", "b", 1200),
    ]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """``df`` with more columns, named like those the operators work with."""
    for c in ("k", "t", "h", "node", "entry", "size", "target", "copies", "seq", "ids", "file", "bucket", "halo", "start", "words", "who", "root", "score", "value"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=repr)

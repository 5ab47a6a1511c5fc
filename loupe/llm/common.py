"""Helpers shared by the operators: tables, shared folders, text batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.session import checkpoint_dir

#: Rows go through a Python stage in slices of at most this many bytes of text,
#: whose words and their hashes take some forty times as much of a worker's memory.
SLICE_BYTES = 2 << 20

#: The characters that separate words in every operator that counts words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again: cuts the
    lineage, survives lost executors, and readers may still prune columns."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[list, pa.RecordBatch]]:
    """Arrow batches cut into slices of bounded text volume, with the texts
    as Python strings (null: empty).  One text is never cut."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = col.nbytes
        step = max(1, int(batch.num_rows * SLICE_BYTES / size)) if size > SLICE_BYTES else max(1, batch.num_rows)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            yield [t or "" for t in texts], part


def field(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


#: A text without other characters keeps its form under NFC, and lowers
#: character by character alike everywhere; the rest go the library's way.
#: Its letters and digits, as pattern classes have them:
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*")


def plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


_WORDS = re.compile(r"[^\W_]+")

#: Latin-1 with a space for all but letters and digits.
_LATIN = bytes(b if chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORDS.findall(text)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``words_of`` stand in ``text``."""
    return [m.span() for m in _WORDS.finditer(text)]


class WordHash(dict):
    """64-bit hash of a word, alike in every worker; remembers some."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h

    def of(self, seqs: list[list[str]]) -> np.ndarray:
        """The hashes of all words of ``seqs``, one after the other."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(seqs)), np.uint64, sum(map(len, seqs)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive word hashes."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = mixed(out + hashes[j:j + n])
    return out

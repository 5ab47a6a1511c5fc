"""Token ids as Parquet list columns.

Documents are dealt into ranges of their id, each range is sorted, encoded and
written by one task through Spark's Parquet writer (dictionary-encoded ids,
row groups and pages of a set size, page indexes), so that a reader takes a
range of documents, or only the counts, without touching the other pages.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import DIGITS, LETTERS, byte_letters, field, plain, shared_path, slices, text_of
from loupe.llm.token_counts import _tokenizer

#: The pre-token pattern of the byte-level vocabulary, with its
#: letters and digits spelled out for the characters of ``common.plain``.
PLAIN_PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"

#: A space begins a chunk unless white space stands before it: the cases that a
#: plain text can have.
RUNS = ("  ", "\n ", "\r ", "\t ")

#: Chunks that a worker remembers; other pre-tokens (numbers, signs).
MEMO, PIECES = 1_000_000, 100_000

#: Stands for a space that begins no chunk; no plain text holds it.
INSIDE = "\x01"

#: Signs that are a pre-token of their own after a word.
SIGNS = ".,;:!?"


#: The bytes that a plain ASCII text may have (``common.plain``).
_ASCII = bytes([9, 10, 13, *range(0x20, 0x7F)])


def plain_ascii(text: str) -> bool:
    """``common.plain`` of an ASCII text, several times as fast."""
    return not text.encode().translate(None, _ASCII)


class ChunkIds(dict):
    """Ids (little-endian unsigned 32-bit) of a space and the chunk after it.

    A word is one pre-token, a word and a sign two, of which the word is looked
    up; once half the memory is used only the word is remembered: rare words
    come with any sign, and each form would cost the memory of another word."""

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.model = self.tok.model
        self.split = re.compile(PLAIN_PRE_TOKEN).findall
        self.letters = "".join(byte_letters())
        self.space = self.letters[0x20]
        self.known: dict[str, bytes] = {}
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.signs = {sign: self.ids(sign) for sign in SIGNS}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            # ASCII letters stand for themselves
            ids = self.of(self.space + chunk) if chunk.isascii() else self.ids(" " + chunk)
        elif chunk[-1:] in self.signs and chunk[:-1].isalpha():
            ids = self[chunk[:-1]] + self.signs[chunk[-1]]
            if len(self) > MEMO // 2:
                return ids
        else:
            ids = self.merge(" " + chunk.replace(INSIDE, " "))
        if len(self) < MEMO:
            self[chunk] = ids
        return ids

    def of(self, word: str) -> bytes:
        """Of one pre-token in the vocabulary's letters."""
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def ids(self, pre: str) -> bytes:
        """Of one pre-token."""
        return self.of(pre.encode().decode("latin-1").translate(self.letters))

    def merge(self, text: str) -> bytes:
        """Of a text of plain characters (``common.plain``)."""
        out = b""
        for pre in self.split(text):
            ids = self.known.get(pre)
            if ids is None:
                ids = self.ids(pre)
                if len(self.known) < PIECES:
                    self.known[pre] = ids
            out += ids
        return out

    def encode(self, text: str) -> bytes:
        if not (plain_ascii(text) if text.isascii() else plain(text)) or any(s in text for s in self.specials):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(run in text for run in RUNS):
            for run in RUNS:
                text = text.replace(run, run[0] + INSIDE)
            while INSIDE + " " in text:
                text = text.replace(INSIDE + " ", INSIDE + INSIDE)
        first, *rest = text.split(" ")
        return self.merge(first.replace(INSIDE, " ")) + b"".join(map(self.__getitem__, rest))


def encode(docs: DataFrame, vocabulary: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq (place in its partition), ids (list of int), n_tokens; rows and
    their order as in ``docs``, so a sorted partition stays sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, at = ChunkIds(vocabulary), 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for texts, part in slices(batches, "t"):
            rows = [chunks.encode(t) + end for t in texts]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(rows), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [field(part, "k"), pa.array(np.arange(at, at + len(rows))), pa.ListArray.from_arrays(pa.array(offsets), ids),
                 pa.array(np.diff(offsets).astype(np.int64))], ["k", "seq", "ids", "n_tokens"])
            at += len(rows)

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    return src.mapInArrow(run, f"k {kind}, seq long, ids array<int>, n_tokens long").withColumnRenamed("k", key)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text",
              row_group_bytes: int = 32 << 20, page_rows: int = 1000, delta: bool = False) -> None:
    """Writes ``docs`` in ascending order of the key (nulls first, repeated
    keys by text) as Parquet: one file per range of keys.

    ``delta``: delta-encoded ids in place of dictionary-encoded ones.
    Footers hold the page index and the range of keys of each row group.
    """
    kept = docs.select(F.col(key), F.col(text))
    ordered = kept.repartitionByRange(F.col(key)).sortWithinPartitions(F.col(key), F.col(text))
    (encode(ordered, vocabulary, end_id, key, text).write
     .option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
     .option("parquet.enable.dictionary", str(not delta).lower()).option("parquet.writer.version", "v2" if delta else "v1")
     .option("compression", "zstd").parquet(path))


def read_ids(docs_schema: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """The rows of ``write_ids``, with the file that each comes from."""
    kind = docs_schema.schema[key].dataType.simpleString()
    return (docs_schema.sparkSession.read.schema(f"`{key}` {kind}, seq long, ids array<int>, n_tokens long").parquet(path)
            .withColumn("file", F.input_file_name()))


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        lists = field(part, "ids")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([field(part, "k"), field(part, "seq"), field(part, "file"), pa.array(np.diff(offsets).astype(np.int64)),
                                          pa.array(crc, pa.int64())], ["k", "seq", "file", "n_tokens", "ids_crc32"])


def token_index(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each stored document, from its ids.

    ``start`` counts the ids of all documents before it: files are ranges of
    keys, so their totals (one row a file) are summed in key order and added
    to the running count within the file.
    """
    kind = stored.schema[key].dataType.simpleString()
    rows = stored.select(F.col(key).alias("k"), "seq", "file", "ids").mapInArrow(
        _checked, f"k {kind}, seq long, file string, n_tokens long, ids_crc32 long")
    files = stored.groupBy("file").agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key))).alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
            .select(F.col("k").alias(key), (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(docs: DataFrame, vocabulary: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` and describes each document as read back from the files.

    Null and empty texts hold the end id alone; a null key sorts first;
    repeated rows are repeated; an empty table gives no rows; other columns
    are not read.
    """
    path = shared_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary, end_id, key, text)
    return token_index(read_ids(docs, path, key), key)

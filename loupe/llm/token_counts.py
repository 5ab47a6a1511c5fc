"""Token counts by the whole-token shortcut.

A pre-token whose lower-cased text is, alone, one entry of the vocabulary need
not be merged: it counts one.  Which strings these are is proven beforehand,
once, by running the vocabulary through the tokenizer's own model; only the
other pre-tokens are merged, and the workers remember what they merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import DIGITS, LETTERS, byte_letters, field, plain, slices, text_of

#: The pre-token pattern of the word-end vocabulary, with its
#: letters and digits spelled out for the characters of ``common.plain``.
PLAIN_PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+"
#: Fixed value: the mark of a word end in that vocabulary.
WORD_END = "</w>"

#: Chunks and pre-tokens that a worker remembers.
MEMO = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The strings that the model at ``path`` encodes, alone, as exactly the
    one token that the vocabulary has for them.  The vocabulary bounds them."""
    tok = _tokenizer(path)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    proven = set()
    for entry, number in tok.get_vocab(with_added_tokens=False).items():
        body = entry.removesuffix(WORD_END)
        if body == entry or not all(c in byte_of for c in body):
            continue
        got = tok.model.tokenize(body)
        if len(got) == 1 and got[0].id == number:
            try:
                proven.add(bytes(byte_of[c] for c in body).decode("utf-8"))
            except UnicodeDecodeError:  # part of a character: no pre-token is that
                pass
    return frozenset(proven)


class WordCounter(dict):
    """Tokens of a chunk without white space; remembers chunks up to MEMO."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok, self.whole = _tokenizer(path), whole
        self.model = self.tok.model
        self.split = re.compile(PLAIN_PRE_TOKEN).findall
        self.letters = "".join(byte_letters())
        self.merged: dict[str, int] = {}
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: str) -> int:
        n = sum(1 if p in self.whole else self.merge(p) for p in self.split(chunk))
        if len(self) < MEMO:
            self[chunk] = n
        return n

    def merge(self, pre: str) -> int:
        n = self.merged.get(pre)
        if n is None:
            n = len(self.model.tokenize(pre.encode().decode("latin-1").translate(self.letters)))
            if len(self.merged) < MEMO:
                self.merged[pre] = n
        return n

    def count(self, text: str) -> int:
        if not plain(text) or any(s in text for s in self.specials):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, text.lower().split()))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; a null key stays null;
    repeated rows stay repeated; other columns of ``docs`` are not read.
    Special strings inside a text, and texts with characters outside Latin,
    are the library's to encode: its result is used as it is.
    """
    whole = prove_whole_tokens(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(vocabulary, whole)
        for texts, part in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays(
                [field(part, "k"), field(part, "n_bytes"), pa.array([counter.count(t) for t in texts], pa.int64())],
                ["k", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).withColumn("n_bytes", F.octet_length("t").cast("long"))
    out = src.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

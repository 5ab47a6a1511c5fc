"""Fill-in-the-middle: texts cut in three and put in another order.

Each text's UTF-8 bytes are cut into blocks of a fixed size.  Two Fenwick trees
over the blocks hold how many units (code points, or words) and how many code
points begin in each; one binary-lifting descent for each of the two cuts finds
the block in which the cut's unit begins, and only that block is searched for
the byte.  Bytes of a text are never decoded, whatever its length.

A text is plain (left as it is) if it is empty, holds one of the marks, or by
the hash of its key; the others are written as prefix, suffix, middle (psm) or
suffix, prefix, middle (spm), a mark before each.  Marks do not occur inside
and begin with a character they hold only once, so ``restored`` finds the
parts again by the marks alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import SLICE_BYTES

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a block.
BLOCK = 4096
#: Per cent of the texts that are rearranged, and of those written as spm.
RATE, SPM = 90, 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Fenwick:
    """Sums over blocks: ``find(k)`` gives the block in which the item of
    number ``k`` (from 0) lies and its number within the block."""

    def __init__(self, counts: np.ndarray):
        at = np.arange(1, len(counts) + 1)
        sums = np.concatenate([[0], np.cumsum(counts)])
        self.total = int(sums[-1])
        self.tree = np.concatenate([[0], sums[at] - sums[at - (at & -at)]]).tolist()  # each node: its lowest bit's run of blocks
        self.top = 1 << (len(counts).bit_length() - 1) if len(counts) else 0

    def find(self, k: int) -> tuple[int, int]:
        block, step = 0, self.top
        while step:
            ahead = block + step
            if ahead < len(self.tree) and self.tree[ahead] <= k:
                block, k = ahead, k - self.tree[ahead]
            step >>= 1
        return block, k

    def before(self, block: int) -> int:
        """What the blocks before ``block`` hold."""
        total = 0
        while block:
            total += self.tree[block]
            block &= block - 1
        return total


class Blocks:
    """A text's bytes with the two trees; ``unit``: "char" or "word" (a word
    with the white space after it; what stands before the first belongs to it)."""

    def __init__(self, data: np.ndarray, unit: str = "char", block: int = BLOCK):
        self.data, self.block = data, block
        self.points = (data & 0xC0) != 0x80
        if unit == "char":
            self.units = self.points
        elif unit == "word":
            space = _SPACE[data]
            self.units = ~space
            self.units[1:] &= space[:-1]
            self.units[np.flatnonzero(self.units)[:1]] = False
            self.units[:1] = True
        else:
            raise ValueError(f"no such unit: {unit}")
        self.unit_tree = Fenwick(self._per_block(self.units))
        self.point_tree = self.unit_tree if unit == "char" else Fenwick(self._per_block(self.points))

    def _per_block(self, begins: np.ndarray) -> np.ndarray:
        if not len(begins):
            return np.zeros(0, np.int64)
        return np.add.reduceat(begins, np.arange(0, len(begins), self.block), dtype=np.int64)

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and code point at which unit ``k`` begins (the end, if there
        are only ``k``)."""
        if k >= self.unit_tree.total:
            return len(self.data), self.point_tree.total
        block, inside = self.unit_tree.find(k)
        start = block * self.block
        offset = int(np.flatnonzero(self.units[start:start + self.block])[inside])
        return start + offset, self.point_tree.before(block) + int(np.count_nonzero(self.points[start:start + offset]))


@dataclass(frozen=True)
class Recipe:
    marks: tuple[str, str, str] = MARKS
    rate: int = RATE
    spm: int = SPM
    unit: str = "char"
    block: int = BLOCK

    def __post_init__(self):
        if any(not m or m[0] in other[1:] for m in self.marks for other in self.marks) or len(set(self.marks)) < 3:
            raise ValueError("marks must differ and begin with a character that none holds later on")
        if any(a != b and a.startswith(b) for a in self.marks for b in self.marks):
            raise ValueError("no mark may begin with another")

    def arranged(self, data: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
        """units, form, code points of prefix and of middle, output."""
        blocks = Blocks(np.frombuffer(data, np.uint8), self.unit, self.block)
        n, marks = blocks.unit_tree.total, [m.encode() for m in self.marks]
        if not data or any(m in data for m in marks) or draws[2] % 100 >= self.rate:
            return n, "plain", None, None, data
        (a, before), (b, upto) = (blocks.cut(k) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
        p, s, m = marks
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        if draws[3] % 100 < self.spm:
            return n, "spm", before, upto - before, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", before, upto - before, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", recipe: Recipe = Recipe()) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output: a row for each
    row of ``docs``.

    The cuts, whether a text is rearranged and how follow from the sha256 of
    seed, ":" and the key.  Null and empty texts are empty and plain; a null key
    hashes as an empty one, repeated rows alike; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    said = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    hashed = F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), said).cast("binary"), 256))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
                       hashed.alias("draws"))
    kind = rows.schema["k"].dataType.simpleString()

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size = [], 0
            for i in range(batch.num_rows):
                draws = batch.column(2)[i].as_py()
                four = tuple(int.from_bytes(draws[j:j + 4], "big") for j in (0, 4, 8, 12))
                kept.append(recipe.arranged(batch.column(1)[i].as_py(), four))
                size += len(kept[-1][4])
                if size > SLICE_BYTES or i == batch.num_rows - 1:
                    yield _batch(batch.column(0).slice(i + 1 - len(kept), len(kept)), kept)
                    kept, size = [], 0

    out = rows.mapInArrow(arrange, f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("k", key)


def _batch(keys: pa.Array, kept: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*kept)
    return pa.record_batch(
        [keys, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
        ["k", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """The text, from an output and its form alone."""
    parts = F.split(output, "|".join(map(re.escape, recipe.marks)))
    part = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
            .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))


def filled_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``fill_in_middle`` with the digests of output and restored text in place
    of the output."""
    made = fill_in_middle(docs, key, text)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))

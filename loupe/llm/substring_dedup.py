"""Repeated passages by paragraph MinHash banding.

A text is cut into paragraphs that do not depend on what stands before them:
of every ``GAP`` consecutive places the one with the least hash of its five
words begins a paragraph of ``WORDS`` words, so any passage that two texts
share word for word, ``WORDS + GAP - 1`` = 50 words or longer, gives both of
them an equal paragraph.  Words that none of these holds, between two of them,
before the first and after the last, get paragraphs of their own, so every
word of a text of ``WORDS`` words or more stands in a paragraph.  MinHash values of a paragraph's five-word shingles form
``BANDS`` bands of ``ROWS``: paragraphs of Jaccard similarity 0.8 share one in
87 of 100 cases, equal ones always, so of repeated passages with three such
paragraphs 998 of 1000 are found.  Colliding paragraphs are verified by their
edit distance (similarity 0.8 or more), tied into components, and all but
those of each component's first document go.  Words at a span's ends that the
paragraph it repeats does not have are no part of the span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import WordHash, field, mixed, shingled, slices, text_of, word_spans, words_of, written
from loupe.llm.near_dedup import near_roots

#: Words of a paragraph and of a shingle; places of which one begins a paragraph.
WORDS, SHINGLE, GAP = 20, 5, 31
#: Bands, and MinHash values of a band.
BANDS, ROWS = 2, 2
#: Least edit similarity of two paragraphs.
SIMILAR = 0.8


def anchors(grams: np.ndarray, doc: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places that are the least (the first of equals) of ``GAP`` consecutive
    ones of their text, or of all, if it has fewer."""
    chosen = np.zeros(len(grams), bool)
    if len(grams) >= GAP:
        # the place of the least of 1, 2, 4 ... places from each on, at last of GAP
        least, wide = np.arange(len(grams)), 1
        while wide < GAP:
            step = min(wide, GAP - wide)
            left, right = least[:-step], least[step:]
            least, wide = np.where(grams[right] < grams[left], right, left), wide + step
        whole = doc[:len(least)] == doc[GAP - 1:]
        chosen[least[whole]] = True
    for i in np.flatnonzero((counts > 0) & (counts < GAP)):
        chosen[starts[i] + grams[starts[i]:starts[i] + counts[i]].argmin()] = True
    return np.flatnonzero(chosen)


def between(doc: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """text and start of the paragraphs that hold what those at ``at``, in
    order, leave out of their texts: they end where the next one begins, the
    first begins and the last ends with the text."""
    first, last = np.ones(len(at), bool), np.ones(len(at), bool)
    first[1:], last[:-1] = doc[1:] != doc[:-1], doc[1:] != doc[:-1]
    ends = sizes[doc] - WORDS
    after = np.where(last, ends, np.append(at[1:], 0) - WORDS)
    places = [(first & (at > 0), np.maximum(at - WORDS, 0)), (first & (at > WORDS), np.zeros_like(at)),
              (last & (ends > at + WORDS), at + WORDS), (~last & (after > at) | last & (ends > at), after)]
    return np.concatenate([doc[hit] for hit, _ in places]), np.concatenate([where[hit] for hit, where in places])


def paragraph_rows(texts: list[str], known: WordHash) -> tuple[np.ndarray, ...]:
    """text, start, words, content hash and bands of each paragraph; texts of
    fewer than ``WORDS`` words, but of a shingle at least, are one."""
    seqs = [words_of(t) for t in texts]
    sizes = np.array([len(s) for s in seqs], np.int64)
    hashes = np.concatenate((known.of(seqs), np.zeros(WORDS, np.uint64)))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    counts = np.maximum(sizes - WORDS + 1, 0)
    grams = shingled(hashes, SHINGLE)
    doc = np.repeat(np.arange(len(seqs)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    picked = anchors(grams[place], doc, np.cumsum(counts) - counts, counts)
    short = np.flatnonzero((sizes >= SHINGLE) & (sizes < WORDS))
    doc, at = doc[picked], place[picked]
    more, where = between(doc, at - begin[doc], sizes)
    doc, at = np.concatenate((doc, more, short)), np.concatenate((at, where + begin[more], begin[short]))
    words = np.minimum(sizes[doc], WORDS)
    content, bands = words.astype(np.uint64), np.full((BANDS * ROWS, len(at)), 2**64 - 1, np.uint64)
    for j in range(WORDS):
        content = np.where(j < words, mixed(content + hashes[at + j]), content)
        if j <= WORDS - SHINGLE:
            for b in range(BANDS * ROWS):
                value = mixed(grams[at + j] + np.uint64((b + 1) * 0xA24BAED4963EE407 & (2**64 - 1)))
                bands[b] = np.where(j + SHINGLE <= words, np.minimum(bands[b], value), bands[b])
    # a run of places with the same paragraph, as in repeated words, is one longer paragraph
    order = np.lexsort((at, doc))
    doc, at, words, content, bands = doc[order], at[order], words[order], content[order], bands[:, order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (content[1:] != content[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1])) if len(at) else np.zeros(0, np.int64)
    words = at[last] + words[last] - at[new]
    joint = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], (BANDS, int(new.sum())))
    for row in range(ROWS):
        joint = mixed(joint + bands[row::ROWS, new])
    return doc[new], at[new] - begin[doc[new]], words, content[new], joint


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, start, words, node (content hash) and bands of all paragraphs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for texts, part in slices(batches, "t"):
            doc, start, words, content, bands = paragraph_rows(texts, known)
            yield pa.RecordBatch.from_arrays(
                [field(part, "k").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(content.view(np.int64)),
                 *(pa.array(b.view(np.int64)) for b in bands)], ["k", "start", "words", "node", *(f"band{b}" for b in range(BANDS))])

    src = docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t"))
    return src.mapInArrow(run, "k long, start int, words int, node long, " + ", ".join(f"band{b} long" for b in range(BANDS)))


def _paragraph_texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node, t: the words of one paragraph of each wanted content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, part in slices(batches, "t"):
            nodes, out = [], []
            for t, places in zip(texts, field(part, "places").to_pylist(), strict=True):
                seq = words_of(t)
                for p in places:
                    nodes.append(p["node"])
                    out.append(" ".join(seq[p["start"]:p["start"] + WORDS]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.string())], ["node", "t"])

    # a text has at most as many places as paragraphs, so their list is bounded by the text
    places = wanted.groupBy("k").agg(F.collect_list(F.struct("node", "start")).alias("places"))
    src = docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t"))
    rows = src.join(places, src["k"].eqNullSafe(places["k"])).select("t", "places")
    return rows.mapInArrow(run, "node long, t string").dropDuplicates(["node"])


def ends_apart(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many words at the beginning and at the end of ``a`` stand in no
    pair of words that ``b`` has as well."""
    pairs = set(zip(b, b[1:], strict=False))
    both = [i for i in range(len(a) - 1) if (a[i], a[i + 1]) in pairs]
    return (both[0], len(a) - 2 - both[-1]) if both else (0, 0)


def _trimmed(again: DataFrame, texts: DataFrame | None) -> DataFrame:
    """``again`` (node, near, start, words) without the words at a span's ends
    that the paragraph it repeats (``near``) does not have: a paragraph that
    begins before a shared passage is near the other's all the same."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ends = [ends_apart(a.split(" "), b.split(" ")) for a, b in zip(field(part, "ta").to_pylist(), field(part, "tb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([field(part, "node"), field(part, "near"), *(pa.array([e[i] for e in ends], pa.int32()) for i in (0, 1))],
                                             ["node", "near", "lead", "tail"])

    if texts is None:  # no two paragraphs but equal ones
        return again
    pairs = again.where("node != near").select("node", "near").distinct()
    both = (pairs.join(texts.select("node", F.col("t").alias("ta")), "node")
            .join(texts.select(F.col("node").alias("near"), F.col("t").alias("tb")), "near").select("node", "near", "ta", "tb"))
    ends = written(both.mapInArrow(run, "node long, near long, lead int, tail int"), "ends")
    out = again.join(ends, ["node", "near"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lead", "tail")})
    return out.withColumns({"start": F.col("start") + F.col("lead"), "words": F.col("words") - F.col("lead") - F.col("tail")}).drop("lead", "tail")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """key, start, words, first: the spans of each document (counted in words)
    that repeat a passage of an earlier document, and the least of those.

    Equal keys are one document, null keys too, the last one.  Null and empty
    texts, and those of fewer than five words, have no passages; an empty
    table gives no rows; other columns are not read.
    """
    rows = written(paragraphs(docs, key, text), "paragraphs")
    banded = rows.select(F.explode(F.array(*(f"band{b}" for b in range(BANDS)))).alias("entry"), "node", "k", "start", "words")
    who = F.coalesce("k", F.lit(2**63 - 1))
    groups = banded.groupBy("entry").agg(F.min(who).alias("k0"), F.max(who).alias("k1"), F.min("node").alias("n0"), F.max("node").alias("n1")).where("k0 != k1")
    groups = written(groups.select("entry", (F.col("n0") != F.col("n1")).alias("several")), "bands")
    shared = written(banded.join(groups, "entry"), "shared")
    members = written(shared.where("several").select("entry", "node").distinct(), "members")
    at = F.min(F.struct("k", "start")).alias("at")
    held: list[DataFrame] = []

    def texts_of(nodes: DataFrame) -> DataFrame:
        one = shared.where("several").join(nodes, "node", "left_semi").groupBy("node").agg(at)
        held.append(written(_paragraph_texts(docs, one.select("node", F.col("at.k").alias("k"), F.col("at.start").alias("start")), key, text), "paragraph-texts"))
        return held[0]

    roots = near_roots(members, texts_of, least, sketches=False)
    spans = shared.select("node", "k", "start", "words").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spans = written(spans.withColumn("who", who), "spans")
    one = F.min(F.struct("who", "start", "node")).alias("one")
    first = spans.groupBy("root").agg(one, F.max("who").alias("last")).where("one.who != last").select(
        "root", F.col("one.who").alias("first"), F.col("one.node").alias("near"))
    again = _trimmed(spans.join(first, "root").where("who != first"), held[0] if held else None)
    order = Window.partitionBy("who").orderBy("start", "words")
    end = F.max(F.col("start") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("end"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = again.withColumn("end", end).withColumn("island", island)
    out = merged.groupBy("who", "island").agg(F.min("k").alias("k"), F.min("start").cast("long").alias("start"),
                                             F.max(F.col("start") + F.col("words")).alias("until"), F.min("first").alias("first"))
    return out.select(F.col("k").alias(key), "start", (F.col("until") - F.col("start")).cast("long").alias("words"), "first")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """``docs`` with the repeated spans cut from their texts."""
    names = docs.columns
    spans = repeated(docs, key, text, least).groupBy(F.col(key).alias("__k")).agg(F.collect_list(F.struct("start", "words")).alias("__cut"))
    rows = docs.join(spans, docs[key].cast("long").eqNullSafe(spans["__k"]), "left").drop("__k")
    schema = rows.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = field(batch, text).to_pylist(), field(batch, "__cut").to_pylist()
            for i, cut in enumerate(cuts):
                if cut and texts[i]:
                    at = word_spans(texts[i])
                    for c in sorted(cut, key=lambda c: -c["start"]):
                        a, b = c["start"], min(c["start"] + c["words"], len(at)) - 1
                        if a <= b:
                            texts[i] = texts[i][:at[a][0]] + texts[i][at[b][1]:]
            cols = [pa.array(texts, pa.string()) if n == text else field(batch, n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return rows.mapInArrow(run, schema).select(*(F.col(f"`{c}`") for c in names))

"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item of ``n`` words if a passage of it, of
whatever length, is within ``n // 5`` word edits of it (similarity 0.8).  A CGK
random walk embeds a word sequence so that a few edits change few positions:
at each step it writes the current word, and a random bit of that word
and step says whether to move on.  Each of ``WALKS`` walks is sampled
``SAMPLES`` times at ``PLACES`` places; windows of ``n`` words and items that
agree on a sample are candidates.  Places are drawn from steps that a
passage with ``n // 5`` deleted words still fills, so the words that such a
window takes in behind the passage, or leaves out of it, do not count; at the
ends of a text windows are padded.
Candidates are verified by aligning the item to the text around the window
with free ends, ``n // 5`` words to each side.

Only windows that may match are embedded: cut into ``n // 5 + 1`` pieces, an
item keeps at least one piece whole under ``n // 5`` edits, at most ``n // 5``
words off its place, so all other starts are left out, without loss.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.alignment import allowed, edit_distance
from loupe.llm.common import WordHash, field, mixed, shingled, slices, text_of, words_of

#: Least edit similarity of a passage and an item.
SIMILAR = 0.8
#: Independent walks, samples of each, places of a sample.
WALKS, SAMPLES, PLACES = 8, 16, 3
#: Items are sent to the tasks in blocks of so many words; each block is one
#: pass over the documents, so a benchmark of any size needs bounded memory.
BLOCK_WORDS = 4_000_000
#: Windows embedded at once.
WINDOWS = 20_000

_ONE = np.uint64(1)


def cgk(words: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The first ``steps`` places of the CGK embeddings of the rows of
    ``words`` (windows x n hashes, 0 outside the text)."""
    rows, n = words.shape
    padded = np.column_stack((words, np.zeros(rows, np.uint64)))
    at, every, out = np.zeros(rows, np.int64), np.arange(rows), np.empty((rows, steps), np.uint64)
    for step in range(steps):
        word = padded[every, at]
        out[:, step] = word
        at += (mixed(word + np.uint64(walk * 1_000_003 + step + 1)) & _ONE).astype(np.int64)
        np.minimum(at, n, out=at)
    return out


def bit_samples(words: np.ndarray, least: float) -> np.ndarray:
    """The LSH keys of each row of ``words``: rows x (WALKS * SAMPLES)."""
    rows, n = words.shape
    steps = 2 * (n - 2 * allowed(n, least))  # a walk moves on at every other step
    out = np.empty((rows, WALKS * SAMPLES), np.uint64)
    for walk in range(WALKS):
        embedded = cgk(words, walk, steps)
        draw = np.random.default_rng((walk, n))
        for sample in range(SAMPLES):
            key = np.full(rows, walk * SAMPLES + sample + 1, np.uint64)
            for place in draw.choice(steps, min(PLACES, steps), replace=False):
                key = mixed(key + embedded[:, place])
            out[:, walk * SAMPLES + sample] = key
    return out


def passage(text: list[int], words: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, difference in length, start) of the run of ``text`` that is
    nearest to ``words``, of equals the one whose length is, then the first;
    None if none is within ``most`` edits."""
    n = len(words)
    if len(text) < n - most:
        return None
    at: dict[int, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    # bit-parallel columns of the alignment whose start in the text is free
    mask, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, dist, best, ends = mask, 0, n, most, []
    for end, w in enumerate(text, 1):
        eq = at.get(w, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | (mask & ~(d0 | vp)), d0 & vp
        dist += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & mask, hn << 1 & mask
        vp, vn = hn | (mask & ~(d0 | hp)), d0 & hp
        if dist < best:
            best, ends = dist, [end]
        elif dist == best:
            ends.append(end)
    for off in range(best + 1):
        runs = {(end - m, end) for end in ends for m in (n - off, n + off) if 0 < m <= end}
        for start, end in sorted(runs):
            if edit_distance(text[start:end], words, best) is not None:
                return best, off, start
    return None


class Items:
    """A block of benchmark items: pieces, keys and words."""

    def __init__(self, items: list[tuple[int, str]], least: float):
        self.least, known = least, WordHash()
        self.words: dict[int, tuple[int, list[int]]] = {}
        pieces, self.keys = defaultdict(set), defaultdict(lambda: defaultdict(list))
        by_length = defaultdict(list)
        for place, (item, text) in enumerate(items):
            seq = [known[w] for w in words_of(text)]
            if not seq:
                continue
            n, k = len(seq), allowed(len(seq), least)
            self.words[place] = (item, seq)
            q = n // (k + 1)
            hashes = shingled(np.array(seq, np.uint64), q)
            for j in range(k + 1):
                pieces[q, int(hashes[j * q])].add((n, j * q))
            by_length[n].append(place)
        for n, places in by_length.items():
            keys = bit_samples(np.array([self.words[p][1] for p in places], np.uint64), least)
            for p, row in zip(places, keys, strict=True):
                for slot, key in enumerate(row):
                    self.keys[n][slot, int(key)].append(p)
        self.keys = {n: dict(v) for n, v in self.keys.items()}
        held = np.array([key for v in self.keys.values() for _, key in v], np.uint64)
        self.low = np.uint64((1 << min(27, max(16, (16 * len(held)).bit_length()))) - 1)
        self.known = np.zeros(int(self.low) + 1, bool)  # a bit for each low part of a key
        self.known[held & self.low] = True
        self.pieces: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for (q, h), at in pieces.items():
            self.pieces.setdefault(q, {})[h] = at
        self.seen = {}
        for q, held in self.pieces.items():  # a bit for each low part of a piece's hash
            self.seen[q] = np.zeros(1 << 22, bool)
            self.seen[q][np.fromiter(held, np.uint64, len(held)) & np.uint64((1 << 22) - 1)] = True

    def windows(self, hashes: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """length -> texts and starts of the windows that a piece of an item of that length allows."""
        out = defaultdict(list)
        for q, held in self.pieces.items():
            grams = shingled(hashes, q)
            for p in np.flatnonzero(self.seen[q][grams & np.uint64((1 << 22) - 1)]):
                if p + q <= begin[doc[p] + 1]:
                    for n, offset in held.get(int(grams[p]), ()):
                        out[n].append((doc[p], p, p - offset))
        found = {}
        for n, hits in out.items():
            text, p, place = np.array(hits, np.int64).T
            k = allowed(n, self.least)
            lo, hi = np.maximum(place - k, begin[text] - k), np.minimum(place + k, p)
            counts = np.maximum(hi - lo + 1, 0)
            texts, starts = np.repeat(text, counts), np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            width = len(hashes) + 2 * k + 1
            one = np.unique(texts * width + starts + k)
            found[n] = one // width, one % width - k
        return found

    def matches(self, texts: list[str], known: WordHash) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, distance): the best passage of each item found."""
        seqs = [words_of(t) for t in texts]
        sizes = np.array([len(s) for s in seqs])
        hashes = known.of(seqs)
        doc, begin = np.repeat(np.arange(len(seqs)), sizes), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, (within, starts) in self.windows(hashes, doc, begin).items():
            candidates = defaultdict(list)
            for at in range(0, len(starts), WINDOWS):
                some, text = starts[at:at + WINDOWS], within[at:at + WINDOWS]
                place = some[:, None] + np.arange(n)
                inside = (place >= begin[text][:, None]) & (place < begin[text + 1][:, None])
                words = np.where(inside, hashes[np.where(inside, place, 0)], np.uint64(0))
                keys = bit_samples(words, self.least)
                for row, slot in np.argwhere(self.known[keys & self.low]):
                    for p in self.keys[n].get((slot, int(keys[row, slot])), ()):
                        candidates[int(text[row]), p].append(int(some[row]))
            k = allowed(n, self.least)
            for (i, p), found in candidates.items():
                item, words = self.words[p]
                found = sorted(set(found))
                spans: list[list[int]] = []
                for start in found:  # the text around one start, or several close ones
                    if spans and start - k <= spans[-1][1]:
                        spans[-1][1] = start + n + k
                    else:
                        spans.append([start - k, start + n + k])
                for a, b in spans:
                    a, b = max(a, int(begin[i])), min(b, int(begin[i + 1]))
                    match = passage(hashes[a:b].tolist(), words, k)
                    if match is not None:
                        d, off, start = match
                        best[i, item] = min(best.get((i, item), (d, off, a + start)), (d, off, a + start))
        for (i, item), (d, _, start) in best.items():
            yield i, item, int(start - begin[i]), d


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", least: float = SIMILAR) -> DataFrame:
    """key, item_id, start (word), distance: a row for each row of ``docs``
    and item that it holds, with its best passage: of the least distance, then
    of the length nearest to the item's, then the first.

    Null or empty texts and items match nothing; a null key is carried;
    null item ids are carried as one; repeated rows are repeated; empty tables
    give no rows; other columns are not read.
    """
    clean = items.select(F.col(item).cast("long").alias("i"), text_of(text).alias("t")).distinct()
    sized = clean.withColumn("w", F.length("t") / 2 + 1)  # at most so many words
    blocks = int((sized.agg(F.sum("w")).first()[0] or 0) // BLOCK_WORDS) + 1
    parts = [_found(docs, sized.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b), key, text, least) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("k").alias(key), F.col("i").alias(item), "start", "distance")


def _found(docs: DataFrame, block: DataFrame, key: str, text: str, least: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in block.orderBy("i", "t").collect()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = Items(held.value, least), WordHash()
        for texts, part in slices(batches, "t"):
            found = sorted(items.matches(texts, known), key=lambda m: m[0])
            ks = field(part, "k").take(pa.array([m[0] for m in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ks, *(pa.array([m[c] for m in found], pa.int64()) for c in (1, 2, 3))], ["k", "i", "start", "distance"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    return src.mapInArrow(run, f"k {kind}, i long, start long, distance long")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """``docs`` without the rows whose text holds an item; rows of one key
    are judged by their own text."""
    names, texts = docs.columns, "__text"
    marked = docs.withColumn(texts, F.xxhash64(text_of(text)))
    bad = contaminated(marked, items, texts, text, least=least).select(texts).distinct()
    return marked.join(bad, texts, "left_anti").select(*(F.col(f"`{c}`") for c in names))

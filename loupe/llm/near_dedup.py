"""Near-duplicate documents by Order MinHash and banded alignment.

Each of ``SKETCHES`` hash functions picks the ``PICKS`` least of a document's
five-word shingles, each labelled with its number among equal ones, and writes
them in text order; documents that share such an entry are candidates.  Two
documents whose labelled shingles, in one order, have a Jaccard similarity of
0.8 share an entry with probability 0.41 for each hash function, and at least
one of 24 but for 3 cases in a million.  Candidates are verified by aligning
their words in a band: documents are near when their edit distance is at most
20 % of the longer one's words.

Equal texts are one node throughout.  Within a group of candidates all are
aligned to one pivot; those that are not near it are compared with the others
by bounds of their edit distance, and aligned to the few that keep them and
are not of one class by then, so large groups of copies cost a few alignments
each, not all pairs, and no link between classes is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.alignment import allowed, edit_distance
from loupe.llm.common import WordHash, field, mixed, shingled, slices, text_of, words_of, written
from loupe.llm.components import components, joined

#: Words of a shingle, shingles of an entry, entries of a document.
SHINGLE, PICKS, SKETCHES = 5, 4, 24
#: Least edit similarity of near documents.
SIMILAR = 0.8
#: Alignments of a text to the likeliest others of a block, in the first round,
#: and how many times as many there are in each round later.
PAIRS, MORE = 16, 16
#: Texts of a block of a group.
BLOCK = 256
#: Bins of words and of pairs of words of a text.
TEXT_BINS = (256, 1024)
#: Pairs of paragraphs whose distances are found together, and their most words.
TOGETHER, BITS = 1 << 14, 64


def order_minhash(texts: list[str], known: WordHash, shingle: int = SHINGLE, sketches: int = SKETCHES) -> np.ndarray:
    """``sketches`` entries (64-bit) for each text; texts shorter than a
    shingle are padded to one."""
    seqs = [words_of(t) for t in texts]
    for s in seqs:
        s.extend([""] * (shingle - len(s)))
    hashes = known.of(seqs)
    sizes = np.array([len(s) for s in seqs])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(seqs)), sizes)
    inside = np.arange(len(hashes)) <= np.repeat(ends, sizes) - shingle  # its shingle ends in the same text
    grams = shingled(hashes, shingle)[inside[:len(hashes) - shingle + 1]]
    doc = doc[inside]
    # the number of each among equal shingles of its text
    same = mixed(grams + mixed(doc.astype(np.uint64)))
    order = np.argsort(same, kind="stable")
    run = same[order]
    first = np.concatenate(([True], run[1:] != run[:-1]))
    number = np.empty(len(run), np.uint64)
    number[order] = (np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))).astype(np.uint64)
    grams = mixed(grams + number * np.uint64(0xD6E8FEB86659FD93))
    starts = np.concatenate(([0], np.cumsum(sizes - shingle + 1)[:-1]))
    counts = sizes - shingle + 1
    out = np.empty((len(seqs), sketches), np.uint64)
    place = np.arange(len(grams))
    for f in range(sketches):
        value = mixed(grams + np.uint64((f + 1) * 0xA24BAED4963EE407 & (2**64 - 1)))
        picked = []
        for _ in range(PICKS):
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == np.repeat(least, counts))
            at = hit[np.searchsorted(doc[hit], np.arange(len(seqs)))]  # the first of equals
            value[at] = np.uint64(2**64 - 1)
            picked.append(place[at])
        entry = np.full(len(seqs), f + 1, np.uint64)
        for at in np.sort(np.array(picked), axis=0):  # in text order
            entry = mixed(entry + grams[at])
        out[:, f] = entry
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """node, entry: one row for each entry of each text of ``docs`` (node, t).
    A batch sketches equal texts once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHash(), set()
        for texts, part in slices(batches, "t"):
            nodes = field(part, "node").to_pylist()
            new = [i for i, n in enumerate(nodes) if not (n in seen or seen.add(n))]
            if len(seen) > 1_000_000:
                seen.clear()
            if new:
                entries = order_minhash([texts[i] for i in new], known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in new for _ in range(entries.shape[1])], pa.binary()), pa.array(entries.ravel().view(np.int64))], ["node", "entry"])

    return docs.mapInArrow(run, "node binary, entry long")


def aligned(pairs: DataFrame, texts: DataFrame, least: float, beyond: bool = False) -> DataFrame:
    """``pairs`` (a, b) with d, their edit distance in words if it is at most
    the allowed one (or, ``beyond`` it, three times that and 3), else null, the
    longer's words, and near."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list[str]] = ("", [])
        for part in batches:
            found = []
            for t, u in zip(field(part, "ta").to_pylist(), field(part, "tb").to_pylist(), strict=True):
                if u != last[0]:
                    last = u, words_of(u)
                x, y = words_of(t), last[1]
                longer = max(len(x), len(y))
                most = allowed(longer, least)
                found.append((edit_distance(x, y, 3 * most + 3 if beyond else most), longer))
            yield pa.RecordBatch.from_arrays(
                [field(part, "a"), field(part, "b"), pa.array([d for d, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32()),
                 pa.array([d is not None and d <= allowed(n, least) for d, n in found], pa.bool_())], ["a", "b", "d", "longer", "near"])

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, d int, longer int, near boolean")


def near_links(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = SIMILAR, sketches: bool = True) -> DataFrame:
    """Verified links (a, b) that connect, within each group of ``members``
    (entry, node), the texts that are near each other.  ``texts_of`` gives
    (node, t) for a table of nodes."""
    return _linked(members, texts_of, least, sketches)[0]


def near_roots(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = SIMILAR, sketches: bool = True) -> DataFrame:
    """node, root: the components of ``near_links``."""
    return _linked(members, texts_of, least, sketches)[1]


def _linked(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float, sketches: bool) -> tuple[DataFrame, DataFrame]:
    """Links and their components.

    First all texts of a group are aligned to its pivot, the one that shares
    most entries with others: one alignment for each text.  What is not near
    the pivot is compared with the rest of the group by bounds that no near
    pair fails (``screened``), unless tied by then, and each text is aligned
    to the ``PAIRS`` likeliest that remain, then to ``MORE`` times as many of
    those that are still not tied, until none is left out.  ``sketches``
    (24 entries a text) stands for whole texts, else they are paragraphs: so
    short that the distances of what the bounds leave are found at once.
    """
    groups = members.groupBy("entry").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p != q").select("entry")
    shared = written(members.join(groups, "entry"), "shared")
    sizes = shared.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    weights = shared.join(sizes, "entry").groupBy("node").agg((-F.sum("n")).alias("light"))
    heads = shared.join(weights, "node").groupBy("entry").agg(F.min(F.struct("light", "node")).alias("head")).select("entry", F.col("head.node").alias("p"))
    star = written(shared.join(heads, "entry").where("node != p"), "star")
    texts = written(texts_of(shared.select("node").distinct()), "texts")
    pairs = star.select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")).distinct()
    known = written(aligned(pairs, texts, least, beyond=True), "aligned")
    of = known.select(F.col("a").alias("x"), F.col("b").alias("y"), "d", "longer", "near")
    told = written(star.withColumns({"x": F.greatest("node", "p"), "y": F.least("node", "p")}).join(of, ["x", "y"])
                   .select("entry", "node", "d", "longer", "near"), "told")
    links, known = known.where("near").select("a", "b"), known.select("a", "b")
    told = told.join(told.where("not near").select("entry").distinct(), "entry", "left_semi")
    traits, roots = None, components(links)
    for most in (PAIRS * MORE ** i for i in itertools.count()):
        now = told.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = now.groupBy("entry").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p != q").select("entry")
        now = written(now.join(open_, "entry"), "open")
        if now.isEmpty():
            return links, roots
        if traits is None:
            some = texts.join(now.select("node").distinct(), "node", "left_semi")
            traits = written(binned(some, TEXT_BINS) if sketches else hashed(some), "traits")
        if not sketches:
            tied = written(tied_paragraphs(now, traits, least).distinct(), "links")
            return links.union(tied), roots if tied.isEmpty() else joined(roots, tied)
        found = written(screened(now, traits, least, most), "screened")
        new = written(found.where("a is not null").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "pairs")
        tied = written(aligned(new, texts, least).where("near").select("a", "b"), "links")
        links, known = links.union(tied), known.union(new)
        roots = roots if tied.isEmpty() else joined(roots, tied)
        more = written(found.where("a is null").select("entry").distinct(), "more")
        if more.isEmpty():
            return links, roots
        told = written(told.join(more, "entry", "left_semi"), "told")


def binned(texts: DataFrame, bins: tuple[int, int]) -> DataFrame:
    """node, words (their number), bins (how many words, and pairs of
    consecutive ones, fall into each bin, up to 255 as bytes) and what is over
    that, for each of ``texts`` (node, t)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for ts, part in slices(batches, "t"):
            rows: list[tuple] = []
            for t in ts:
                hashes = known.of([words_of(t)])
                counts = [np.bincount((h % np.uint64(n)).astype(np.int64), minlength=n) for h, n in zip((hashes, shingled(hashes, 2)), bins, strict=True)]
                rows.append((len(hashes), np.minimum(np.concatenate(counts), 255).astype(np.uint8).tobytes(), *(int(np.maximum(c - 255, 0).sum()) for c in counts)))
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.int32())
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([field(part, "node"), *cols], ["node", "words", "bins", "over1", "over2"])

    kind = texts.schema["node"].dataType.simpleString()
    out = texts.select("node", "t").mapInArrow(run, f"node {kind}, words int, bins binary, over1 int, over2 int")
    return out.withColumn("width", F.lit(bins[0]))


def hashed(texts: DataFrame) -> DataFrame:
    """node, words (their number) and their hashes, one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for ts, part in slices(batches, "t"):
            rows = [known.of([words_of(t)]) for t in ts]
            yield pa.RecordBatch.from_arrays([field(part, "node"), pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             ["node", "words", "hashes"])

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "t").mapInArrow(run, f"node {kind}, words int, hashes binary")


def paired_blocks(told: DataFrame, traits: DataFrame, least: float) -> DataFrame:
    """entry, us, ws: each block of the texts of a group that are not near the
    pivot with each block of all its texts; groups are dealt into blocks of
    about ``BLOCK`` texts, with the columns of ``traits``."""
    far = 3 * F.floor(F.col("longer") * (1 - least) + 1e-9) + 4  # a distance that was not told is this at least
    sizes = told.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("all_blocks"), F.ceil(F.count_if(~F.col("near")) / BLOCK).alias("left_blocks"))
    rows = told.join(sizes, "entry").join(traits, "node").withColumn("h", F.xxhash64("node")).select(
        "entry", "near", "all_blocks", "left_blocks", "h",
        F.struct("node", F.xxhash64("root").alias("root"), "near", "h", F.coalesce("d", far).cast("int").alias("low"), F.coalesce("d", F.lit(2**30)).alias("high"),
                 *(c for c in traits.columns if c != "node")).alias("x"))

    def blocks(side: DataFrame, own: str, other: str, name: str) -> DataFrame:
        dealt = side.withColumns({own: F.pmod("h", F.col(f"{own}_blocks")), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))})
        return dealt.groupBy("entry", "left", "all").agg(F.collect_list("x").alias(name))

    return blocks(rows.where("not near"), "left", "all", "us").join(blocks(rows, "all", "left", "ws"), ["entry", "left", "all"]).select("entry", "us", "ws")


def tied_paragraphs(told: DataFrame, traits: DataFrame, least: float) -> DataFrame:
    """a, b: of the pairs that ``screened`` compares, near ones that connect
    all that are near; no more of a block than it has texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, ws = field(batch, "us"), field(batch, "ws")
            for i in range(batch.num_rows):
                mine, theirs = us[i].values, ws[i].values
                at, to = ties(mine, theirs, least)
                if at:
                    yield pa.RecordBatch.from_arrays([mine.field("node").take(pa.array(at)), theirs.field("node").take(pa.array(to))], ["u", "w"])

    kind = told.schema["node"].dataType.simpleString()
    found = paired_blocks(told, traits, least).select("us", "ws").mapInArrow(run, f"u {kind}, w {kind}")
    return found.select(F.greatest("u", "w").alias("a"), F.least("u", "w").alias("b"))


def ties(us: pa.StructArray, ws: pa.StructArray, least: float) -> tuple[list[int], list[int]]:
    """Places in ``us`` and ``ws`` of the near pairs that ``tied_paragraphs``
    tells of, at most one for each two classes that it ties."""
    (uh, ur, ul, ut, un), (wh, wr, wl, wt, wn) = ([s.field(c).to_numpy(zero_copy_only=False) for c in ("h", "root", "low", "high", "words")] for s in (us, ws))
    edits = (np.maximum(un[:, None], wn) * (1 - least) + 1e-9).astype(np.int64)
    tied = ws.field("near").to_numpy(zero_copy_only=False).astype(bool)
    may = (ur[:, None] != wr) & (tied | (wh < uh[:, None])) & (np.abs(un[:, None] - wn) <= edits) & (ul[:, None] - wt <= edits) & (wl - ut[:, None] <= edits)
    i, j = np.nonzero(may)
    if not len(i):
        return [], []
    words = [np.frombuffer(h, np.uint64) for s in (us, ws) for h in s.field("hashes").to_pylist()]
    a, b = words[:len(us)], words[len(us):]
    most = edits[i, j]
    if max(map(len, a)) > BITS:
        near = np.array([edit_distance(a[x].tolist(), b[y].tolist(), int(k)) is not None for x, y, k in zip(i, j, most, strict=True)])
    else:
        near = distances(a, b, i, j) <= most
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while (up := parent.get(n, n)) != n:
            parent[n] = n = parent.get(up, up)
        return n

    at, to = [], []
    for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
        if (p := root(int(ur[x]))) != (q := root(int(wr[y]))):
            parent[p] = q
            at.append(x)
            to.append(y)
    return at, to


def distances(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The edit distances of ``a[i]``, of up to ``BITS`` words, and ``b[j]``.

    Bit-parallel, as in ``edit_distance``, for ``TOGETHER`` pairs at once: bit
    r of a pair's numbers is the difference of a column at word r of ``a[i]``.
    """
    an, bn = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    every, word = np.unique(np.concatenate((*a, *b)), return_inverse=True)
    rows, place = np.repeat(np.arange(len(a)), an), np.arange(an.sum()) - np.repeat(np.cumsum(an) - an, an)
    where = np.zeros((len(a), len(every) + 1), np.uint64)  # the places of each word, the last one of none
    np.bitwise_or.at(where, (rows, word[:an.sum()]), np.uint64(1) << place.astype(np.uint64))
    columns = np.full((len(b), max(1, bn.max())), len(every))
    columns[np.arange(columns.shape[1]) < bn[:, None]] = word[an.sum():]
    out, one = np.empty(len(i), np.int64), np.uint64(1)
    for at in range(0, len(i), TOGETHER):
        x, y = i[at:at + TOGETHER], j[at:at + TOGETHER]
        top = (np.maximum(an[x], 1) - 1).astype(np.uint64)
        more, less = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
        found = an[x].copy()
        for c in range(columns.shape[1]):
            same = where[x, columns[y, c]]
            down = same | less
            across = (((same & more) + more) ^ more) | same
            up, off = less | ~(across | more), more & across
            found += np.where(c < bn[y], ((up >> top) & one).astype(np.int64) - ((off >> top) & one).astype(np.int64), 0)
            up = (up << one) | one
            more, less = (off << one) | ~(down | up), up & down
        out[at:at + TOGETHER] = np.where(an[x] > 0, found, bn[y])
    return out


def screened(told: DataFrame, bins: DataFrame, least: float, most: int) -> DataFrame:
    """entry, a, b: pairs of texts of one group of ``told`` (entry, node, root,
    d from the pivot, longer, near the pivot or not), not both near it, that
    are not of one root and may be near each other: for each text that is not
    near the pivot the ``most`` likeliest of a block of the others.  A row of
    null texts tells that there are others in this group.

    Near texts keep three bounds: their distances from the pivot differ by no
    more edits than they may have (triangle inequality), an edit changes one
    word and two pairs of consecutive words at most, and texts that fall into
    bins together have no less in common than they have.  Each pair of blocks
    is one row; a pair of texts is told in the least of their groups only.
    """
    bins = bins.join(told.groupBy("node").agg(F.collect_list("entry").alias("entries")), "node")  # a text has at most as many as entries
    both = paired_blocks(told, bins, least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                us, ws = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("us", "ws"))
                entry = field(batch, "entry")[i].as_py()
                at, to, more = likeliest(us, ws, least, most)
                if len(at):
                    mine, theirs = us.field("entries").to_pylist(), ws.field("entries").to_pylist()
                    here = [(a, b) for a, b in zip(at, to, strict=True) if min(set(mine[a]).intersection(theirs[b])) == entry]
                    a, b = us.field("node").take(pa.array([a for a, _ in here], pa.int64())), ws.field("node").take(pa.array([b for _, b in here], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([entry] * len(here), pa.int64()), a, b], ["entry", "u", "w"])
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array([entry], pa.int64()), pa.nulls(1, us.field("node").type), pa.nulls(1, us.field("node").type)], ["entry", "u", "w"])

    kind = told.schema["node"].dataType.simpleString()
    found = both.mapInArrow(run, f"entry long, u {kind}, w {kind}")
    return found.select("entry", F.greatest("u", "w").alias("a"), F.least("u", "w").alias("b"))


def likeliest(us: pa.StructArray, ws: pa.StructArray, least: float, most: int) -> tuple[list[int], list[int], bool]:
    """Places in ``us`` and ``ws`` of the pairs that ``screened`` tells of, two
    texts that are both not near the pivot once, and whether there are more."""
    def numbers(side: pa.StructArray, name: str) -> np.ndarray:
        return side.field(name).to_numpy(zero_copy_only=False)

    (uh, ur, ul, ut, un, u1, u2), (wh, wr, wl, wt, wn, w1, w2) = ([numbers(s, c) for c in ("h", "root", "low", "high", "words", "over1", "over2")] for s in (us, ws))
    ub, wb = (np.frombuffer(b"".join(s.field("bins").to_pylist()), np.uint8).reshape(len(s), -1) for s in (us, ws))
    width, tied = us.field("width")[0].as_py(), numbers(ws, "near").astype(bool)
    at, to, more = [], [], False
    for i in range(len(us)):
        longer = np.maximum(wn, un[i])
        edits = (longer * (1 - least) + 1e-9).astype(np.int64)
        near = np.flatnonzero((wr != ur[i]) & (tied | (wh < uh[i])) & (np.abs(wn - un[i]) <= edits) & (ul[i] - wt <= edits) & (wl - ut[i] <= edits))
        if len(near):
            common = np.minimum(ub[i, :width], wb[near, :width]).sum(axis=1, dtype=np.int64) + np.minimum(u1[i], w1[near])
            near = near[common >= longer[near] - edits[near]]
        if len(near):
            common = np.minimum(ub[i, width:], wb[near, width:]).sum(axis=1, dtype=np.int64) + np.minimum(u2[i], w2[near])
            enough = common >= longer[near] - 1 - 2 * edits[near]
            near, likeness = near[enough], common[enough] / np.maximum(longer[near[enough]], 1)
            best = near[np.argsort(-likeness, kind="stable")[:most]]
            at.extend([i] * len(best))
            to.extend(best.tolist())
            more |= len(near) > most
    return at, to, more


def node_of(text: str = "text"):
    """Equal texts are one node."""
    return F.unhex(F.md5(text_of(text).cast("binary")))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """node, root, class_id, class_size, keeper for every distinct text:
    ``class_id`` is the least key of its class (null only if all are), and
    ``keeper`` the node that stands for the class."""
    t = docs.select(F.col(key).alias("k"), node_of(text).alias("node"), text_of(text).alias("t"))
    entries = written(sketched(t.select("node", "t")).distinct(), "entries")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return t.select("node", "t").join(nodes, "node", "left_semi").dropDuplicates(["node"])

    roots = near_roots(entries, texts_of, least)
    nodes = t.groupBy("node").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k")).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "n"), "nodes")
    classes = nodes.groupBy("root").agg(F.min(F.struct("first", "node")).alias("one"), F.sum("n").alias("class_size"))
    return nodes.join(classes, "root").select("node", "root", F.col("one.first.k").alias("class_id"), "class_size", F.col("one.node").alias("keeper"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: key, class_id, class_size, kept.

    Equal texts are always of one class; so are all texts without words, as
    null and empty ones.  A class's
    least key is its id, whose rows are ``kept`` (repeated rows alike); a class
    of null keys alone has the id null and is kept.  An empty table gives no
    rows; other columns are not read.
    """
    ids = docs.select(F.col(key).alias("k"), node_of(text).alias("node"))
    return (ids.join(near_classes(docs, key, text, least), "node")
            .select(F.col("k").alias(key), "class_id", "class_size", F.col("k").eqNullSafe(F.col("class_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: one of those
    with the least key and the class's keeping text."""
    node, names = "__node", docs.columns
    kept = near_classes(docs, key, text, least).where(F.col("node") == F.col("keeper")).select(F.col("node").alias(node), F.col("class_id").alias("__class"))
    rows = docs.withColumn(node, node_of(text)).join(kept, node).where(F.col(key).eqNullSafe(F.col("__class")))
    return rows.dropDuplicates([node]).select(*(F.col(f"`{c}`") for c in names))

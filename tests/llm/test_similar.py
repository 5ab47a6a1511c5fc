import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loupe.llm import near_dedup
from loupe.llm.alignment import edit_distance, similar
from loupe.llm.common import WordHash, slices, words_of
from loupe.llm.components import components, joined
from loupe.llm.decontaminate import Items, contaminated, drop_contaminated, passage
from loupe.llm.near_dedup import drop_near_duplicates, near_duplicates, near_links
from loupe.llm.substring_dedup import GAP, WORDS, ends_apart, paragraph_rows, repeated, without_repeats

from .cases import SCHEMA, clashing, edited, frame, keyed, odd_rows, prose


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(4000):
        letters = rng.choice([2, 4, 30])
        a = [rng.randrange(letters) for _ in range(rng.randrange(14))]
        b = list(a) if rng.random() < 0.5 else [rng.randrange(letters) for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(5)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(letters))
        most, d = rng.randrange(16), table_distance(a, b)
        assert edit_distance(a, b, most) == (d if d <= most else None)


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(500, n) for n in range(501, 700)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: r for n, r in grouped(edges, {x for e in edges for x in e}).items() if n != r}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def copies_of(seed, words, edits, n, first):
    base = prose(seed, words)
    return [(first, base)] + [(first + i, edited(base, seed * 100 + i, edits)) for i in range(1, n)]


def near_case():
    rows = [(1000 + i, prose(5000 + i, 20 + i)) for i in range(60)]
    rows += copies_of(1, 200, 4, 40, 100) + copies_of(2, 60, 1, 6, 200) + copies_of(3, 3000, 30, 3, 300) + [(400, prose(4, 90)), (401, prose(4, 90)), (402, prose(4, 90).upper())]
    # a passage that many share is no reason to be near
    rows += [(600 + i, prose(9, 60) + " " + prose(700 + i, 70)) for i in range(50)]
    return [(k, t, "en", "a", 1) for k, t in rows]


def test_near_classes_match_brute_force(spark):
    rows = near_case() + odd_rows()
    got = near_duplicates(clashing(frame(spark, rows)).repartition(3)).collect()
    assert len(got) == len(rows)
    words = {i: words_of(r[1] or "") for i, r in enumerate(rows)}
    pairs = [(i, j) for i in words for j in range(i) if similar(words[i], words[j], 0.8)]
    root = grouped(pairs, words)
    classes = defaultdict(list)
    for i, r in root.items():
        classes[r].append(rows[i][0])
    want = []
    for i, r in root.items():
        ids = [k for k in classes[r] if k is not None]
        want.append((rows[i][0], min(ids) if ids else None, len(classes[r]), rows[i][0] == (min(ids) if ids else None)))
    assert keyed(got) == keyed(want)


def test_one_of_each_class_stays(spark):
    rows = near_case() + odd_rows()
    docs = clashing(frame(spark, rows))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {(r.class_id, r.class_size) for r in near_duplicates(docs).collect()}
    assert len(ids) == len(want) and set(ids) == {c for c, _ in want}
    assert near_duplicates(frame(spark, [], SCHEMA)).collect() == [] and drop_near_duplicates(frame(spark, [], SCHEMA)).collect() == []


def test_rounds_lose_no_link(spark):
    """Groups whose least text is not near the others, and chains through the border."""
    base = prose(1, 100)
    texts = {1: prose(2, 100), 2: edited(base, 1, 18), 3: base, 4: edited(base, 2, 18), 5: edited(base, 3, 36), 6: edited(edited(base, 3, 36), 4, 12)}
    nodes = spark.createDataFrame(list(texts.items()), "node long, t string")
    members = nodes.select(F.lit(7).cast("long").alias("entry"), "node")
    got = grouped([(r.a, r.b) for r in near_links(members, lambda wanted: nodes.join(wanted, "node", "left_semi")).collect()], texts)
    want = grouped([(a, b) for a in texts for b in texts if a < b and similar(words_of(texts[a]), words_of(texts[b]), 0.8)], texts)
    assert got == want


def linked(spark, texts, **how):
    nodes = spark.createDataFrame(list(texts.items()), "node long, t string")
    members = nodes.select(F.lit(7).cast("long").alias("entry"), "node")
    got = grouped([(r.a, r.b) for r in near_links(members, lambda wanted: nodes.join(wanted, "node", "left_semi"), **how).collect()], texts)
    words = {n: words_of(t) for n, t in texts.items()}
    return got, grouped([(a, b) for a in words for b in words if a < b and similar(words[a], words[b], 0.8)], texts)


def test_large_groups_lose_no_link(spark):
    """Copies with own headers and footers, near the bare text but not each
    other, and copies of many texts that share a passage, all of one group."""
    base, texts = prose(1, 100), {}
    for i in range(45):
        texts[i] = f"{prose(100 + i, 22)} {base}"
        texts[100 + i] = f"{base} {prose(200 + i, 22)}"
    texts[50] = base
    for i in range(150):
        own = f"{prose(9, 40)} {prose(300 + i, 60)}"
        texts[1000 + 2 * i], texts[1001 + 2 * i] = own, edited(own, i, 12)
    got, want = linked(spark, texts)
    assert len(texts) > 350 and got == want


def test_alignments_grow_with_members(spark, monkeypatch):
    """Texts that share a passage are aligned a few times each, not to each other."""
    counts, aligned = [], near_dedup.aligned
    monkeypatch.setattr(near_dedup, "aligned", lambda pairs, *args, **how: counts.append(pairs.count()) or aligned(pairs, *args, **how))
    texts = {i: f"{prose(9, 40)} {prose(300 + i // 2, 60)}{' more' * (i % 2)}" for i in range(160)}
    got, want = linked(spark, texts)
    assert got == want and sum(counts) < 3 * len(texts)


def test_paragraph_links_cross_a_pivot(spark):
    """Copies of a paragraph, near the original but not each other, the least of them the pivot."""
    words = words_of(prose(1, WORDS))
    texts = {9: " ".join(words)}
    for i in range(6):
        copy = list(words)
        copy[3 * i:3 * i + 3] = [f"new{i}{j}" for j in range(3)]
        texts[i if i < 3 else 10 + i] = " ".join(copy)
    got, want = linked(spark, texts, sketches=False)
    assert len(set(want.values())) == 1 and got == want


def leak_case():
    items = [(i, prose(100 + i, n)) for i, n in enumerate([14, 20, 25, 33, 40, 59, 5, 1])] + [(90, ""), (91, None), (92, prose(101, 20))]
    rng, rows, k = random.Random(2), [], 0
    for item, text in items[:7]:
        n = len(words_of(text))
        for edits in range(n // 5 + 2):
            body = prose(900 + k, 150).split(" ")
            body[rng.randrange(150):0] = edited(text, k, edits).split(" ") if edits else text.upper().split(" ")
            rows.append((k, " ".join(body), "en", "a", 1))
            k += 1
    return items, rows + [(1000 + i, prose(3000 + i, 120), "en", "a", 1) for i in range(40)] + [(2000 + r[0] if r[0] else r[0], *r[1:]) for r in odd_rows()]


def test_contaminated_matches_brute_force(spark):
    items, rows = leak_case()
    got = contaminated(clashing(frame(spark, rows)), clashing(frame(spark, items, "item_id long, text string"))).collect()
    want = set()
    for i, (k, t, *_) in enumerate(rows):
        seq = words_of(t or "")
        if len(seq) > 20_000:
            continue
        for item, text in items:
            w = words_of(text or "")
            found = [(d, s) for s in range(len(seq) - len(w) + 1) if w and (d := edit_distance(seq[s:s + len(w)], w, len(w) // 5)) is not None]
            if found:
                want.add((k, item, min(found)[1], min(found)[0]))
    exact = {w for w in want if w[3] == 0}
    mine = {tuple(r) for r in got if r.doc_id != 2003}
    assert {(k, i) for k, i, *_ in mine} <= {(k, i) for k, i, *_ in want}
    assert {(k, i) for k, i, *_ in exact} <= {(k, i) for k, i, *_ in mine}
    assert len({(k, i) for k, i, *_ in mine}) >= 0.9 * len({(k, i) for k, i, *_ in want})
    assert all(similar(words_of(dict((r[0], r[1]) for r in rows)[k])[s:s + len(words_of(dict(items)[i]))], words_of(dict(items)[i]), 0.8) for k, i, s, _ in mine)


def test_lsh_recall_at_the_limit():
    """Of passages with the most edits that count, nine in ten at least are found."""
    rng, found, n = random.Random(7), 0, 0
    items = [(i, prose(50 + i, rng.randint(20, 60))) for i in range(40)]
    held, known = Items(items, 0.8), WordHash()
    texts, want = [], []
    for i, text in items * 4:
        w = words_of(text)
        for _ in range(len(w) // 5):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(prose(8000 + len(texts), 60) + " " + " ".join(w) + " " + prose(9000 + len(texts), 60))
        want.append(i)
    got = {(t, i) for t, i, _, _ in held.matches(texts, known)}
    assert sum((t, i) in got for t, i in enumerate(want)) >= 0.9 * len(want)


def changed(words, kind, edits, rng):
    words = list(words)
    for _ in range(edits):
        if kind == "del":
            del words[rng.randrange(len(words))]
        else:
            words.insert(rng.randrange(1, len(words)), f"new{rng.randrange(10**6)}")
    return words


@pytest.mark.parametrize("kind", ["del", "ins"])
@pytest.mark.parametrize("around", [0, 60])
def test_recall_with_words_lost_or_gained(kind, around):
    """At the most edits that count; without text around it, the document is the passage alone."""
    rng = random.Random(11)
    items = [(i, prose(50 + i, rng.randint(14, 60))) for i in range(40)]
    texts, want = [], []
    for i, text in items * 4:
        w = words_of(text)
        texts.append(" ".join([prose(8000 + len(texts), around), *changed(w, kind, len(w) // 5, rng), prose(9000 + len(texts), around)]))
        want.append(i)
    got = {(t, i): d for t, i, _, d in Items(items, 0.8).matches(texts, WordHash())}
    assert sum((t, i) in got for t, i in enumerate(want)) >= 0.95 * len(want)
    assert all(d <= len(words_of(dict(items)[i])) // 5 for (_, i), d in got.items())


def test_passage_matches_brute_force():
    rng = random.Random(12)
    for _ in range(1500):
        letters = rng.choice([2, 4, 30])
        text, words = ([rng.randrange(letters) for _ in range(rng.randint(a, 12))] for a in (0, 1))
        most = rng.randrange(len(words))
        runs = [(table_distance(text[a:b], words), abs(b - a - len(words)), a) for a in range(len(text)) for b in range(a + 1, len(text) + 1)]
        best = min(runs, default=(99, 0, 0))
        assert passage(text, words, most) == (best if best[0] <= most else None)


def test_contamination_edges(spark):
    items, rows = leak_case()
    empty, none = frame(spark, [], SCHEMA), frame(spark, [], "item_id long, text string")
    docs, bench = clashing(frame(spark, rows)), frame(spark, items, "item_id long, text string")
    assert contaminated(empty, bench).collect() == [] and contaminated(docs, none).collect() == []
    bad = {r.doc_id for r in contaminated(docs, bench).collect()}
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad)


def passage_case():
    shared = [prose(4000 + i, n) for i, n in enumerate((50, 55, 80))]
    rows = [(i, prose(i, 30 + i), "en", "a", 1) for i in range(30)]
    for i in range(30, 60):
        rows.append((i, f"{prose(i, 20 + i)} {shared[i % 3]} {prose(i + 1000, 30)}", "en", "a", 1))
    rows.append((60, edited(shared[2], 1, 1), "en", "a", 1))
    return shared, rows


def test_repeated_passages(spark):
    shared, rows = passage_case()
    got = repeated(clashing(frame(spark, rows + odd_rows()[4:5])).repartition(3)).collect()
    words = {r[0]: words_of(r[1]) for r in rows}
    covered = defaultdict(set)
    for r in got:
        if r.doc_id in words:
            assert r.first < r.doc_id and r.doc_id >= 33
            covered[r.doc_id] |= set(range(r.start, r.start + r.words))
    assert set(covered) == set(range(33, 61))
    for k, spans in covered.items():  # within the passage, and it is found in each document but the first
        passage = words_of(shared[k % 3] if k < 60 else rows[60][1])
        at = next((s for s in range(len(words[k])) if words[k][s:s + len(passage)] == passage), 0)
        assert spans <= set(range(at, at + len(passage))) and len(spans) >= WORDS


def test_any_shared_run_gives_an_equal_paragraph():
    rng, known = random.Random(4), WordHash()
    for seed in range(150):
        run = prose(seed, WORDS + GAP - 1)
        texts = [f"{prose(seed + 500 + j, rng.randrange(80))} {run} {prose(seed + 900 + j, rng.randrange(80))}" for j in range(2)]
        doc, _, _, content, _ = paragraph_rows(texts, known)
        assert set(content[doc == 0]) & set(content[doc == 1])


def test_every_word_stands_in_a_paragraph():
    texts = [prose(seed, n) for seed, n in enumerate([20, 21, 39, 40, 41, 50, 51, 70, 71, 200, 1000, 3000])]
    doc, start, words, _, _ = paragraph_rows(texts + ["same " * 100, "", "one two"], WordHash())
    for i, t in enumerate([*texts, "same " * 100]):
        held = {w for s, n in zip(start[doc == i], words[doc == i], strict=True) for w in range(s, s + n)}
        assert held == set(range(len(words_of(t)))), i


def test_a_text_that_begins_a_longer_one(spark):
    short, long = prose(1, 31), prose(1, 3000)
    assert words_of(long)[:31] == words_of(short)
    got = repeated(frame(spark, [(1, short, "en", "a", 1), (3, long, "en", "a", 1)])).collect()
    assert {(r.doc_id, r.first) for r in got} == {(3, 1)}
    assert all(r.start + r.words <= 31 for r in got)


def test_repeats_cut_and_edges(spark):
    shared, rows = passage_case()
    docs = clashing(frame(spark, rows))
    out = without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert all(texts[r[0]] == r[1] for r in rows if r[0] < 33)
    assert all(len(words_of(texts[k])) <= len(words_of(dict((r[0], r[1]) for r in rows)[k])) - WORDS for k in range(33, 60))
    assert repeated(frame(spark, [], SCHEMA)).collect() == []
    twice = repeated(frame(spark, odd_rows())).collect()
    assert {(r.doc_id, r.first) for r in twice} == {(5, 4)}


def test_ends_that_are_not_shared():
    a, b = "x s1 s2 s3 s4".split(), "y s1 s2 s3 s4 z".split()
    assert ends_apart(a, b) == (1, 0) and ends_apart(b, a) == (1, 1)
    assert ends_apart(a, a) == (0, 0) and ends_apart(["a"], ["b"]) == (0, 0) and ends_apart("a b".split(), "c d".split()) == (0, 0)


def test_memory_of_a_batch():
    """A large batch of texts is not split into words and sketched at once."""
    text = prose(4, 10_000)
    batch = pa.RecordBatch.from_pydict({"t": [text] * (8_000_000 // len(text))})
    tracemalloc.start()
    for texts, _ in slices([batch], "t"):
        near_dedup.order_minhash(texts, WordHash(), sketches=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


def test_distances_together():
    rng = random.Random(6)
    for n in (3, 14, near_dedup.BITS):
        a, b = ([np.array([rng.randrange(9) for _ in range(rng.randrange(most + 1))], np.uint64) for _ in range(25)] for most in (n, n + 5))
        i, j = (x.ravel() for x in np.mgrid[:25, :25])
        assert near_dedup.distances(a, b, i, j).tolist() == [table_distance(a[x].tolist(), b[y].tolist()) for x, y in zip(i, j, strict=True)]


def test_joined_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    first, more = (spark.createDataFrame(e, "a long, b long") for e in (edges[:140], edges[140:]))
    got = {r.node: r.root for r in joined(components(first), more).collect()}
    assert got == {n: r for n, r in grouped(edges, {x for e in edges for x in e}).items() if n != r}


@pytest.mark.parametrize("more", [0, 60])
def test_paragraphs_are_aligned_to_the_pivot_only(spark, monkeypatch, more):
    """What is not near the pivot is tied block by block, longer texts too."""
    counts, aligned = [], near_dedup.aligned
    monkeypatch.setattr(near_dedup, "aligned", lambda pairs, *args, **how: counts.append(pairs.count()) or aligned(pairs, *args, **how))
    base, texts = prose(9, 12), {}
    for i in range(150):
        own = f"{base} {prose(300 + i, 8 + more)}"
        texts[2 * i], texts[2 * i + 1] = own, edited(own, i, 2)
    got, want = linked(spark, texts, sketches=False)
    assert got == want and sum(counts) < len(texts)


def test_words_are_runs_of_letters_and_digits():
    for c in map(chr, range(0x3000)):
        text = f"a{c}B {c}{c} c_1{c}"
        assert words_of(text) == re.findall(r"[^\W_]+", text.lower()), hex(ord(c))

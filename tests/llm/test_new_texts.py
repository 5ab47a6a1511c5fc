"""Exact deduplication, filter audit and fill-in-the-middle against brute force."""

import hashlib
import re
import tempfile
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loupe.llm import exact_dedup
from loupe.llm.exact_dedup import arrivals, exact_duplicates, remembered, without_copies
from loupe.llm.filter_audit import audit, audit_filters
from loupe.llm.fill_middle import Blocks, Fenwick, Recipe, fill_in_middle, filled_digests, restored

from .cases import SCHEMA, clashing, frame, keyed, odd_rows, prose

CLASHING = ("digest", "place", "said", "keep", "n", "salt", "own", "file", "row", "same", "mask", "part", "id", "good", "toxic", "k", "draws", "form", "output")


def with_clashes(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return clashing(df)


def stored(df, files=3):
    path = tempfile.mkdtemp(prefix="loupe-test-") + "/docs.parquet"
    df.repartition(files).write.parquet(path)
    return path


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def copies_case():
    rows = odd_rows()
    rows += [(100 + i, "Same TEXT for Ä many" if i % 2 else "same text FOR Ä many", "en", "a", 1) for i in range(400)]
    rows += [(600 + i, prose(i % 40, 30).upper() if i % 3 else prose(i % 40, 30), "en", "a", 1) for i in range(120)]
    return rows + [(900, "ä", "de", "a", 1), (901, "Ä", "de", "a", 1), (902, "xİ", "de", "a", 1), (903, "Xİ", "de", "a", 1)]


def brute_copies(rows):
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(k)
    top = {t: max(ks, key=lambda k: (k is not None, k or 0)) for t, ks in groups.items()}
    return Counter((k, top[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for k, t, *_ in rows)


def check_copies(got, rows):
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_copies(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == {r.text_sha256 for r in got} and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates(spark):
    rows = copies_case()
    path = stored(with_clashes(frame(spark, rows)))
    check_copies(exact_duplicates(spark, path).collect(), rows)
    # one file a micro-batch: copies meet in state, not in a batch
    check_copies(exact_duplicates(spark, path, maxFilesPerTrigger=1).collect(), rows)
    left = without_copies(spark, path)
    assert left.columns == spark.read.parquet(path).columns
    assert sorted(lowered(r.text) for r in left.collect()) == sorted({lowered(t) for _, t, *_ in rows})


def test_exact_duplicates_of_one_file(spark):
    path = stored(frame(spark, odd_rows()), 1)
    file = next(r.file for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).collect())
    check_copies(exact_duplicates(spark, file.removeprefix("file:")).collect(), odd_rows())


def test_digest_collisions_are_told_apart(spark):
    """With a digest of one byte every entry is shared by many texts."""
    rows = copies_case()
    short = lambda said: F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, 1)
    check_copies(exact_duplicates(spark, stored(frame(spark, rows)), digest=short).collect(), rows)


def test_state_stays(spark):
    """A later run over the same folder reads only the new file and hits the
    entries of the old ones; the state is a store on disk."""
    path, state = tempfile.mkdtemp(prefix="loupe-test-") + "/docs.parquet", tempfile.mkdtemp(prefix="loupe-test-") + "/state"
    first, second = [(1, "a", "en", "x", 1), (2, "b", "en", "x", 1)], [(7, "A", "en", "x", 1), (8, "c", "en", "x", 1)]
    frame(spark, first).coalesce(1).write.parquet(path)
    seen = remembered(arrivals(spark, path), state)
    assert sorted((r.keep.id, r.n) for r in seen.collect()) == [(1, 1), (2, 1)]
    frame(spark, second).coalesce(1).write.mode("append").parquet(path)
    seen = remembered(arrivals(spark, path), state)
    assert sorted((r.keep.id, r.n) for r in seen.collect()) == [(2, 1), (7, 2), (8, 1)]
    assert spark.read.format("state-metadata").load(state).first().numPartitions == 4
    check_copies(exact_duplicates(spark, path, checkpoint=state).collect(), first + second)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_large_group_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PARTS", 20)
    monkeypatch.setattr(exact_dedup, "LEAST", 8)
    rows = copies_case()
    path = stored(frame(spark, rows))
    check_copies(exact_duplicates(spark, path).collect(), rows)
    state = remembered(arrivals(spark, path), tempfile.mkdtemp(prefix="loupe-test-") + "/state")
    met = exact_dedup.resolved(exact_dedup.located(spark.read.parquet(path), "doc_id", "text"), state)
    assert met.count() == len(rows) and met.where("NOT same").isEmpty()


def test_exact_duplicates_of_nothing(spark):
    path = stored(frame(spark, []), 1)
    got = exact_duplicates(spark, path)
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert without_copies(spark, path).count() == 0


def test_exact_duplicates_of_text_keys(spark):
    rows = [("b", "X"), ("a", "x"), (None, "x"), ("c", "y")]
    got = exact_duplicates(spark, stored(spark.createDataFrame(rows, "doc_id string, text string"))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)}


LABELS = "doc_id long, quality int, toxic int"


def brute_audit(rows, labels):
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for k, t, *_ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    docs = []
    for k, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ["A"] * (len(w) < 200) + ["B"] * (100 * len(set(w)) < 50 * len(w)) + ["C"] * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        fails += ["D"] * bool(re.search("[#$%&*|]", t)) + ["E"] * (k is not None and k > least[t])
        docs.append((lang or "", set(fails), k in good and k is not None, k in toxic and k is not None))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            there = mine
            for i, f in enumerate(order):
                gone = [d for d in there if f in d[1]]
                left = [d for d in there if f not in d[1]]
                failing = [d for d in mine if f in d[1]]
                out[part, "".join(order), i + 1] = [
                    len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
                there = left
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_case():
    rows = odd_rows() + [(None, None, "de", "x", 0), (50, "A B C D # " * 60, "en", "a", 1), (51, "A B C D # " * 60, "de", "a", 1), (51, "A B C D # " * 60, "de", "a", 1)]
    rows += [(60 + i, [prose(i, 250), prose(9, 250), "word " * 300, "SHOUT " * 210 + prose(i, 100), "a|b " * 5][i % 5], ["en", "de", None][i % 3], "a", 1) for i in range(40)]
    labels = [(60 + i, i % 2, int(i % 5 == 0)) for i in range(0, 30)] + [(51, 1, 1), (51, 0, None), (None, 1, 1), (10**6, 1, 1), (4, None, 1)]
    return rows, labels


def columns(got):
    return {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_matches_brute_force(spark):
    rows, labels = audit_case()
    got = audit_filters(with_clashes(frame(spark, rows)).repartition(3), frame(spark, labels, LABELS)).collect()
    want = brute_audit(rows, labels)
    assert len(got) == 600 * len({r[0] for r in want}) and columns(got) == want


def test_audit_without_labels_or_rows(spark):
    rows, _ = audit_case()
    got = audit_filters(frame(spark, rows), frame(spark, [], LABELS)).collect()
    assert columns(got) == brute_audit(rows, [])
    assert audit_filters(frame(spark, []), frame(spark, [], LABELS)).count() == 0


def test_audit_of_other_filters(spark):
    """The fold is general in the number of filters."""
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 7, 2, 1), ("p", 2, 4, 0, 0), ("q", 7, 1, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in audit(cells, "XYZ").collect()}
    assert len(got) == 2 * 6 * 3
    assert got["p", "XYZ", 1] == (9, 7, 0, 0, 2, 21) and got["p", "XYZ", 2] == (5, 4, 7, 4, 0, 45) and got["q", "ZYX", 3] == (0, 0, 1, 0, 0, 2)


def brute_filled(key, text):
    """units, form, code points, output by slicing the decoded text."""
    text, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def middle_case():
    rows = odd_rows() + [(70, "a <P> b", "en", "a", 1), (71, "<<S", "en", "a", 1), (72, "<M", "en", "a", 1), (73, "😀" * 5000, "en", "a", 1)]
    return rows + [(100 + i, prose(i, 5 + i * 13) + ("é😀日" * i), "en", "a", 1) for i in range(80)] + [(300 + i, "<" * (i + 1) + "P<S<M", "en", "a", 1) for i in range(30)]


def test_fill_in_middle_matches_brute_force(spark):
    rows = middle_case()
    got = fill_in_middle(with_clashes(frame(spark, rows)).repartition(3), recipe=Recipe(block=64))
    assert keyed((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()) == keyed((k, *brute_filled(k, t)) for k, t, *_ in rows)
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert keyed(back.collect()) == keyed((k, t or "") for k, t, *_ in rows)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = filled_digests(frame(spark, rows)).collect()
    assert keyed((r.doc_id, r.output_sha256, r.restored_sha256) for r in digests) == keyed((k, sha(brute_filled(k, t)[4]), sha(t or "")) for k, t, *_ in rows)
    assert fill_in_middle(frame(spark, [])).count() == 0


def test_fill_in_middle_by_words(spark):
    """Cuts fall where words begin; marks and keys of one's own."""
    rows = [(f"k{i}", prose(i, 40)) for i in range(60)] + [(None, " \n "), ("z", "  lead in")]
    recipe = Recipe(marks=("[pre]", "{suf}", "(mid)"), rate=100, spm=50, unit="word", block=32)
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = fill_in_middle(docs, seed="x", recipe=recipe)
    texts = dict(rows)
    for r in got.collect():
        text = texts[r.doc_id]
        begins = [m.start() for m in re.finditer(r"\S+", text)]
        units = sorted({0, *begins[1:], len(text)})
        assert r.n == len(units) - 1 and r.prefix_chars in units and r.prefix_chars + r.middle_chars in units
    back = got.select("doc_id", restored(F.col("output"), F.col("form"), recipe).alias("text"))
    assert keyed(back.collect()) == keyed(rows)


def test_recipe_wants_marks_that_can_be_found():
    for marks in (("<P>", "<P>", "<M>"), ("aba", "c", "d"), ("<", "<S>", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            Recipe(marks=marks)


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=300), st.integers(1, 40), st.sampled_from(["char", "word"]))
def test_blocks_cut_where_units_begin(text, block, unit):
    data = text.encode("utf-8", "ignore")
    text = data.decode()
    blocks = Blocks(np.frombuffer(data, np.uint8), unit, block)
    if unit == "char":
        begins = list(range(len(text)))
    else:
        words = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        begins = sorted({0, *words[1:]}) if text else []
    assert blocks.unit_tree.total == len(begins)
    for k, at in enumerate([*begins, len(text)]):
        assert blocks.cut(k) == (len(text[:at].encode()), at)


@settings(deadline=None)
@given(st.lists(st.integers(0, 5), max_size=70))
def test_fenwick_finds_blocks(counts):
    tree = Fenwick(np.array(counts, np.int64))
    items = [(b, i) for b, c in enumerate(counts) for i in range(c)]
    assert [tree.find(k) for k in range(tree.total)] == items
    assert [tree.before(b) for b in range(len(counts) + 1)] == [sum(counts[:b]) for b in range(len(counts) + 1)]

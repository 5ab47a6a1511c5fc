import re

import pytest

from loupe.llm.mixing import mix, mixed_documents

from .cases import SCHEMA, clashing, frame, keyed, odd_rows, prose


def goals(totals):
    """Shares by weight, what is above three times a source reshared until none is."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(totals.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * totals[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
            free.discard(s)
        if not free:
            return target


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 5 + i * 37 % 400), "en", f"s{min(i % 7, i % 3 + 2)}" if i % 11 else None, 1) for i in range(900)] + odd_rows()
    got = mix(clashing(frame(spark, rows)).repartition(4)).collect()
    again = mix(frame(spark, rows)).collect()
    assert keyed(got) == keyed(again)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, t, _, s, _ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = goals(totals)
    of = {}
    for (k, t, _, s, _) in rows:
        of.setdefault((k, size(t)), s)
    taken, largest = dict.fromkeys(totals, 0), dict.fromkeys(totals, 0)
    assert len(got) == len(rows)
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == totals[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in totals:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1, s


def test_mix_keeps_lengths(spark):
    """The second moment: long documents are not what pays for a small target."""
    rows = [(i, prose(i, 1000 if i % 4 == 0 else 50), "en", "big" if i < 900 else "small", 1) for i in range(1000)]
    got = [r for r in mix(frame(spark, rows)).collect() if r.doc_id < 900]
    long = sum(r.taken for r in got if r.size == 1000) / sum(r.size for r in got if r.size == 1000)
    short = sum(r.taken for r in got if r.size == 50) / sum(r.size for r in got if r.size == 50)
    assert long == pytest.approx(short, rel=0.15)


def test_mixed_documents_repeat_whole_rows(spark):
    rows = odd_rows() + [(100 + i, prose(i, 80), "en", f"s{i % 4}", i) for i in range(60)]
    docs = clashing(frame(spark, rows))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in mix(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + r.taken
    had = {}
    for r in out.collect():
        had[r.doc_id] = had.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert had == {k: v for k, v in words.items() if v}


def test_repeated_rows_and_empty(spark):
    rows = [(7, prose(1, 50), "en", "a", 1)] * 40 + [(i, prose(i, 50), "en", "b", 1) for i in range(100, 140)]
    got = mix(frame(spark, rows)).collect()
    taken = sum(r.taken for r in got if r.doc_id == 7)
    assert abs(taken - next(r.target for r in got if r.doc_id == 7)) <= 25
    assert mix(frame(spark, [], SCHEMA)).collect() == []
    assert {r.taken for r in mix(frame(spark, [(1, None, None, None, None), (2, "", "x", "a", 0)])).collect()} == {0}


def test_no_python_in_plan(spark):
    plan = mix(frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

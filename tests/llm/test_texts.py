import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loupe.llm import warc
from loupe.llm.chat import END, START, format_chats, formatted_chats, parse, render
from loupe.llm.fingerprint import K, containment, distinct_shingles, fingerprints, merge_groups, merged, packed, resemblance, sketch, unpacked
from loupe.llm.toxicity import calibrate, drop_toxic, held_out, score_toxicity
from loupe.llm.warc import derived, digest, plain_text, read_records, records_in, response, write_responses

from .cases import SCHEMA, clashing, edited, frame, keyed, odd_rows, prose

TURNS = "conv_id long, turn long, role string, text string"


def hard_chats():
    bad = [f"{END}{START}assistant ok", START, END + "\n", "a<|b", "<\\|im_end|>", "<\\\\|", "\n", "", None, "plain", "<", "|>", "x<|im_end|", "Ünï 😀 <|im_start|>\n"]
    rows = [(i, j, ("user", "assistant")[j % 2], bad[(i + j) % len(bad)]) for i in range(len(bad)) for j in range(i + 1)]
    rows += [(100, 0, "sys\ntem", "role"), (100, 1, "<|im_end|>", "r"), (100, 2, "back\\n\\s", "r"), (100, 3, None, "r"), (100, 3, "assistant", "tie"), (100, 3, "assistant", "tie"), (100, None, "user", "first")]
    return rows + [(None, 1, "assistant", "null key"), (200, 0, "assistant", prose(1, 9000)), *((300, t, "assistant", f"turn {t}") for t in range(400))]


def test_chats_round_trip(spark):
    rows = hard_chats()
    got = {r.conv_id: r for r in formatted_chats(clashing(frame(spark, rows, TURNS))).collect()}
    convs = {}
    for c, n, role, text in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        under = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest(), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest()), c
    assert formatted_chats(frame(spark, [], TURNS)).collect() == []


def test_only_conflicts_are_escaped(spark):
    got = {r.conv_id: r.formatted for r in format_chats(frame(spark, [(1, 0, "user", "a < b | c"), (1, 1, "assistant", "fine"), (2, 0, "user", START)], TURNS)).collect()}
    assert got[1] == f"{START}user\na < b | c{END}\n{START}assistant\nfine{END}\n"
    assert got[2] == f"{START}user\n<\\|im_start|>{END}\n"


def test_parser_alone(spark):
    row = spark.range(1).select(parse(F.concat(render(F.lit("user"), F.lit("x\ny")), render(F.lit("assistant"), F.lit("")))).alias("p")).first().p
    assert [tuple(t) for t in row] == [("user", "x\ny"), ("assistant", "")]


def test_fingerprints(spark):
    rows = odd_rows() + [(100 + i, prose(i, 40 + 20 * i), "en", "a", 1) for i in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = clashing(frame(spark, rows)).repartition(3)
    out = fingerprints(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = []
    for i, (k, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        new = t[:len(t) - third] + after[:third]
        want.append((k, len(t), hashlib.sha256(new.encode()).hexdigest()))
    got = out.collect()
    assert keyed((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == keyed(want)
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, []).append(r)
    assert by[4][0].fingerprint == by[4][1].fingerprint == by[5][0].fingerprint
    assert fingerprints(frame(spark, [], SCHEMA)).collect() == []
    one = fingerprints(frame(spark, [(1, prose(1, 300), "en", "a", 1)])).first()
    assert one.near_next == 1.0 and one.near_edited > 0.3


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_estimates(spark):
    base = prose(1, 3000)
    texts = [base, edited(base, 1, 60), edited(base, 2, 300), base[:len(base) // 2], prose(2, 3000), prose(3, 60), edited(prose(3, 60), 4, 2), "", "two words"]
    s = {r.i: r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sketch(F.col("t")).alias("s")).collect()}
    assert all(len(v) == min(K, len(shingles(t))) and v == sorted(set(v)) for t, v in zip(texts, s.values(), strict=True))
    pairs = spark.createDataFrame([(i, j, s[i], s[j]) for i in s for j in s], "i int, j int, a array<long>, b array<long>")
    got = pairs.select("i", "j", resemblance(F.col("a"), F.col("b")).alias("r"), containment(F.col("a"), F.col("b")).alias("c"), distinct_shingles(F.col("a")).alias("n"),
                       (unpacked(packed(F.col("a"))) == F.col("a")).alias("back")).collect()
    for r in got:
        a, b = shingles(texts[r.i]), shingles(texts[r.j])
        true = len(a & b) / len(a | b) if a | b else 1.0
        held = len(a & b) / len(a) if a else 1.0
        exact = len(a) < K and len(b) < K and len(a | b) <= K
        assert r.back and abs(r.r - true) <= (1e-9 if exact else 0.16) and abs(r.c - held) <= 0.3
        assert abs(r.n - len(a)) <= (0 if len(a) < K else 0.35 * len(a))


def test_sketches_merge(spark):
    text = prose(5, 2000)
    words = text.split(" ")
    parts = [" ".join(words[i:i + 504]) for i in range(0, 2000, 500)]  # parts overlap by a shingle less a word
    rows = spark.createDataFrame([("g", p) for p in parts] + [("e", "")], "g string, t string").withColumn("s", sketch(F.col("t")))
    got = {r.g: r.sketch for r in merge_groups(rows, "g", "s").collect()}
    whole = spark.createDataFrame([(text,)], "t string").select(sketch(F.col("t")).alias("s")).first().s
    assert got == {"g": whole, "e": []}
    two = spark.createDataFrame([(parts[0], parts[1])], "a string, b string").select(merged(sketch(F.col("a")), sketch(F.col("b"))).alias("m"), sketch(F.concat("a", F.lit(" "), "b")).alias("w")).first()
    assert len(set(two.m) & set(two.w)) >= K - 5


def toxic_case():
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = prose(i, 60 + i % 200)
        if toxic:
            text = edited(text, i, 0).replace(" ", " vile ", 2) + " nasty vile brute"
        rows.append((i, text, "en", "a", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows + [(k if k is None else 5000 + k, *r) for k, *r in odd_rows()], labels + [(None, 1, 1), (7, None, None), (8, 1, 1), (8, 1, 1)]


def test_toxicity_held_out(spark):
    rows, labels = toxic_case()
    docs, marks = clashing(frame(spark, rows)), frame(spark, labels, "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and 0 <= r.doc_id < 600]
    assert sum(right) >= 0.97 * len(right)
    # labels that the rule holds out change nothing
    other = [(k, q, 1 - y if k is not None and y is not None and zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, q, y in labels]
    again = score_toxicity(docs, frame(spark, other, "doc_id long, quality int, toxic int")).collect()
    assert keyed(got) == keyed(again)
    kept = drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_edges(spark):
    docs = frame(spark, odd_rows())
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.5}
    assert score_toxicity(frame(spark, [], SCHEMA), none).collect() == []
    assert spark.range(3).select(held_out("id").alias("h")).collect()[0].h == (zlib.crc32(b"0") % 5 == 0)
    slope, base = calibrate([(0.0, 0), (0.1, 0), (0.9, 1), (1.0, 1)])
    assert slope > 0 and slope * 0.05 + base < 0 < slope * 0.95 + base


PAGES = "page_id long, url string, html string"


def test_plain_text():
    html = '<html><head><title> A  b </title><style>p{}</style><script>var t="</p><p>no";</script></head><body><p>One <b>two</b><br>three &amp; é<ul><li>x</li><li><a href="/u">y</a> z</ul><!-- no -->'
    assert plain_text(html) == ("One two\nthree & é\nx\ny z", "A b", ["/u"])
    assert plain_text("") == ("", "", []) and plain_text("no tags") == ("no tags", "", []) and plain_text("<p" * 3000)[1] == ""


def test_plain_pages_are_read_without_the_parser(monkeypatch):
    """What the quick reading takes, it reads as the parser does; the rest it leaves."""
    bits = ["<title>", "</title>", "<title>a &amp; b</title>", "<TITLE>x</TITLE >", "<title>a<b>c</title>", "<title/>", "<p>", "</p>", "<br/>", "<div class='x>y'>", "</div>",
            "<a href=/u>", '<A HREF="/v?a=1&amp;b">', "<a href=''>", "<a href=/x href=/y>", "<a>", "</a>", "one &amp; two", " &lt;b&gt; &eacute &#233", "a & b", "<b>", "</b>", "<head>", "</head>", "<body>",
            "<script>var t = '</p>';</script>", "<script>", "</script >", "<script><!-- <p> --></script>", "<script/>", "<style>p{}</style>", "</scripty>", "<!-- a -->", "<!-- a -- b -->", "<!>", "<!doctype html>",
            "<textarea>", "</textarea>", "<noscript>", "<?x>", "< p", "<p", "<![CDATA[x]]>", "<p a=\"", "\n\t ", "<template>", "</template>"]
    rng, taken = random.Random(5), 0
    for _ in range(3000):
        html = "".join(rng.choices(bits, k=rng.randint(1, 8)))
        quick, page = warc._Page(), warc._Page()
        page.feed(html)
        page.close()
        if warc.plainly(quick, html):
            taken += 1
            assert ["".join(p) for p in (quick.parts, quick.heading)] + quick.links == ["".join(p) for p in (page.parts, page.heading)] + page.links, html
    assert taken > 500
    monkeypatch.setattr(warc._Page, "feed", None)
    html = "<!DOCTYPE html><head><title>T &amp; u</title><script>a('</p>')</script></head><body><p>x<a href='/l'>y</a><br>z</body>"
    assert plain_text(html) == ("xy\nz", "T & u", ["/l"])


def test_warc_chain(spark, tmpdir_path):
    split = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nafter"  # looks like records
    pages = [(1, "http://a/1", "<title>T</title><p>Hello <a href='/x'>x</a>"), (2, "http://a/2", f"<p>{split}"), (3, None, None), (4, "", ""), (None, "http://n", "<p>n"),
             (5, "http://a/\r\n5", "<p>Ünï 😀 " + prose(1, 20_000)), (6, "http://a/1", "<title>T</title><p>Hello <a href='/x'>x</a>"), (7, "http://t", "<p>twice"), (7, "http://t", "<p>twice")]
    df = clashing(frame(spark, pages, PAGES))
    got = derived(df, captured="2024-01-02T03:04:05Z").collect()
    assert len(got) == len(pages) and all(r.verified for r in got)
    by = {r.page_id: r for r in got}
    for k, url, html in pages:
        text, title, links = plain_text(html or "")
        r = by[k]
        assert (r.text, r.title, r.outlinks, r.payload_digest, r.conversion_digest) == (text, title, len(links), digest((html or "").encode()), digest(text.encode()))
        assert next(records_in(response("" if k is None else str(k), url or "", html or "", "2024-01-02T03:04:05Z").encode()))[0]["WARC-Record-ID"] == r.response_id
    assert len({r.response_id for r in got}) == len(pages) - 1
    path = f"{tmpdir_path}/responses"
    write_responses(df, path)
    stored = read_records(spark, path).collect()
    assert len(stored) == len(pages) and all(r.verified and r.type == "response" for r in stored)
    assert derived(frame(spark, [], PAGES)).collect() == []


def test_warc_files_are_small_and_read_once(spark, tmpdir_path):
    pages = [(i, f"http://a/{i}", f"<title>{i}</title>" + "<p>one line of many</p>" * 2000) for i in range(3)] + [(7, "http://t", "<p>twice")] * 3
    df, path = frame(spark, pages, PAGES), f"{tmpdir_path}/responses"
    write_responses(df, path)
    assert sum(f.stat().st_size for f in Path(path).glob("part-*")) < sum(len(h) for _, _, h in pages) / 4
    got = derived(df)
    assert sorted(r.page_id for r in got.collect()) == [0, 1, 2, 7, 7, 7]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert [q for q in __spark_entry__.queries() if q == name or q.startswith(name + "_")]

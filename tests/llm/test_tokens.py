import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loupe.llm.token_counts import WordCounter, count_tokens, prove_whole_tokens
from loupe.llm.token_store import ChunkIds, read_ids, token_output, write_ids

from .cases import BYTE_BPE, SCHEMA, WORD_BPE, clashing, frame, keyed, odd_rows, prose


def hard_texts():
    rng = random.Random(5)
    signs = "aB é'.,\n \t\r1²ªZß_-<|>"
    return ([f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} It's{chr(c)}  x" for c in range(0x260)]
            + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)]
            + ["don't We'LL 'sit it'd x'", "a \nb", "a\n b", "tail  ", "<|startoftext|>a<|endoftext|>", "Ὀδυσσεύς ΑΣ", "é", prose(1, 500)])


def test_counts_are_the_librarys():
    tok, counter = Tokenizer.from_file(WORD_BPE), WordCounter(WORD_BPE, prove_whole_tokens(WORD_BPE))
    for t in hard_texts():
        assert counter.count(t) == len(tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_proven_tokens_are_single():
    tok, whole = Tokenizer.from_file(WORD_BPE), prove_whole_tokens(WORD_BPE)
    assert "the" in whole and len(whole) > 30_000
    for w in random.Random(1).sample(sorted(whole), 500):
        if w == w.lower() and w.isalpha():
            assert len(tok.encode(w, add_special_tokens=False).ids) == 1, w


def test_ids_are_the_librarys():
    tok, chunks = Tokenizer.from_file(BYTE_BPE), ChunkIds(BYTE_BPE)
    for t in hard_texts():
        assert list(np.frombuffer(chunks.encode(t), "<u4")) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_count_rows(spark):
    tok = Tokenizer.from_file(WORD_BPE)
    got = count_tokens(clashing(frame(spark, odd_rows())), WORD_BPE, limit=100)
    want = []
    for k, t, *_ in odd_rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 100))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert keyed(got.collect()) == keyed(want)
    assert count_tokens(frame(spark, [], SCHEMA), WORD_BPE).collect() == []


def test_stored_ids(spark):
    tok = Tokenizer.from_file(BYTE_BPE)
    docs = clashing(frame(spark, odd_rows())).repartition(5)
    got = token_output(docs, BYTE_BPE, 2).collect()
    start, want = 0, []
    for k, t, *_ in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert keyed(got) == keyed(want)
    assert token_output(frame(spark, [], SCHEMA), BYTE_BPE).collect() == []


@pytest.mark.parametrize("delta", [False, True])
def test_file_layout(spark, tmpdir_path, delta):
    import glob

    import pyarrow.parquet as pq

    docs = frame(spark, [(i, prose(i, 200), "en", "a", 1) for i in range(300)])
    path = f"{tmpdir_path}/ids-{delta}"
    write_ids(docs, path, BYTE_BPE, delta=delta, page_rows=50)
    kinds = set()
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            col = next(c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns)) if c.path_in_schema.startswith("ids"))
            kinds |= set(col.encodings)
            key = meta.row_group(g).column(0)
            assert key.has_offset_index and key.has_column_index and key.statistics.has_min_max
    assert ("DELTA_BINARY_PACKED" in kinds) == delta
    plan = read_ids(docs, path).where("doc_id = 17").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in plan and "ids:" not in plan.split("ReadSchema")[1]

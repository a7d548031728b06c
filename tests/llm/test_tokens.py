"""Token files, BPE codec and token counts against the tokenizers library."""

import glob
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import bpe_codec, token_counts, token_files, tokenizing
from folioscope.llm.common import LONGEST_KEY, Memo, table_path
from tests.llm.cases import TEXTS, documents, rows_of, table

PATH = tokenizing.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def counted(i, text):
    n = len(ids(text))
    return i, len((text or "").encode()), n, n > 1024


def coded(i, text):
    x = ids(text)
    return i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(x, skip_special_tokens=False).encode()).hexdigest()


def filed(rows):
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        x = [*ids(text), 2]
        out.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["cases", "table"])
def docs(request, spark, sf):
    return documents(spark, extra=True) if request.param == "cases" else table(spark, sf, "documents")


def test_counts(docs):
    assert rows_of(token_counts.count_tokens(docs)) == sorted(counted(*p) for p in pairs(docs))


def test_codec(docs):
    assert rows_of(bpe_codec.encode(docs, digest_only=True)) == sorted(coded(*p) for p in pairs(docs))


def test_codec_round_trip(spark):
    docs = documents(spark)
    tokens = bpe_codec.encode(docs, chunk_bytes=100)
    assert rows_of(tokens, "doc_id", "ids") == [(i, ids(t)) for i, t in enumerate(TEXTS, 1)]
    assert rows_of(bpe_codec.decode(tokens)) == [(i, t or "") for i, t in enumerate(TEXTS, 1)]


def test_decode_of_broken_bytes(spark):
    broken = ids("👩")[:1]
    tokens = spark.createDataFrame([(1, broken), (2, None)], "doc_id long, ids array<int>")
    assert rows_of(bpe_codec.decode(tokens)) == [(1, LIBRARY.decode(broken, skip_special_tokens=False)), (2, "")]


def test_decode_odd_rows_and_small_chunks(spark):
    x, y = ids("one two two"), ids("<|endoftext|> three")
    rows = [(None, x), (None, x), (5, [*y, None, 10**6]), (6, []), (7, y * 50)]
    tokens = spark.createDataFrame([(i, v, "clash") for i, v in rows], "doc_id long, ids array<int>, token string").repartition(1)
    known = [[t for t in v if t is not None and t < 10**6] for _, v in rows]
    texts = sorted(zip([i for i, _ in rows], (LIBRARY.decode(v, skip_special_tokens=False) for v in known)), key=lambda r: (r[0] is not None, r[0] or 0))
    for size in (1, 60, bpe_codec.CHUNK_BYTES):
        assert rows_of(bpe_codec.decode(tokens, chunk_bytes=size)) == texts
    assert bpe_codec.decode(tokens.limit(0)).collect() == []


def test_decoding_is_a_join_and_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    plan = bpe_codec.encode(documents(spark), digest_only=True)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin [token" in plan
    assert {t.name for t in spark.catalog.listTables()} == before


def test_files(docs):
    assert rows_of(token_files.token_files(docs)) == filed(pairs(docs))


def test_repeats_and_null_ids(spark):
    docs = documents(spark, ["a b", "a b", "c", None], ids=[None, 7, 7, None])
    assert [r[0] for r in rows_of(token_counts.count_tokens(docs))] == [None, None, 7, 7]
    assert [r[0] for r in rows_of(bpe_codec.encode(docs, digest_only=True))] == [None, None, 7, 7]
    found = rows_of(token_files.token_files(docs))
    assert [r[0] for r in found] == [None, None, 7, 7]
    spans = sorted((r[1], r[1] + r[2]) for r in found)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty_tables(spark):
    docs = documents(spark, [])
    for found in (token_counts.count_tokens(docs), bpe_codec.encode(docs, digest_only=True), bpe_codec.encode(docs), token_files.token_files(docs)):
        assert found.collect() == []


def test_lookup_and_layout(spark, sf):
    path = table_path(spark, "tokens")
    docs = table(spark, sf, "documents")
    token_files.write_token_files(docs, path, partitions=3)
    wanted = [r.doc_id for r in docs.orderBy("doc_id").limit(2).collect()]
    assert sorted(r.doc_id for r in token_files.lookup(spark, path, wanted).collect()) == wanted
    files = sorted(glob.glob(path.removeprefix("file://") + "/*.orc"))
    ends = [spark.read.orc(f).agg(F.min("doc_id"), F.max("doc_id")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    import pyarrow.orc

    assert all(pyarrow.orc.ORCFile(f).nstripes >= 1 for f in files)


def rows_scanned(df):
    """Rows that the only scan of ``df`` gives to the filter behind it."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookup_prunes_by_bloom_filter(spark):
    """Ids are even, so an odd one lies between the least and highest of a row group: only the Bloom filter rules it out."""
    docs = spark.range(0, 16_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    path = table_path(spark, "tokens")
    token_files.write_token_files(docs, path, partitions=1)
    assert rows_scanned(spark.read.orc(path)) == 8_000
    assert rows_scanned(token_files.lookup(spark, path, [5_000])) == 1_000
    assert sum(rows_scanned(token_files.lookup(spark, path, [i])) for i in range(5_001, 5_041, 2)) <= 3_000  # 20 lookups of 1,000 rows without it


def test_partitions_follow_the_input(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).repartition(23)
    path = table_path(spark, "tokens")
    token_files.write_token_files(docs, path)
    assert spark.read.orc(path).select("part").distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


ODD = st.text(st.sampled_from(list(" \n\t'.,<|>_aAbst0129éß京क́  👩\x00")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_any_texts(texts):
    expected = [ids(t) for t in texts]
    assert [np.frombuffer(x, tokenizing.id_type(PATH)).tolist() for x in tokenizing.encode_bytes(PATH, texts)] == expected
    assert token_counts.counter(PATH).count(texts) == [len(x) for x in expected]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abetho "), max_size=40))
def test_heap_merges_as_the_library(text):
    of_byte, merges = token_counts.merge_table(PATH)
    word = text.replace(" ", "")
    assert token_counts.merged_length([of_byte[b] for b in word.encode()], merges) == len(ids(word))


def test_word_memory_is_bounded():
    """The bound is in bytes: many words, and texts without spaces, which are one word each."""
    memo = Memo(len, limit=10_000)
    for i in range(2_000):
        assert memo[f"word{i}"] == len(f"word{i}") and memo["again"] == 5
    assert memo.held <= 10_200 and len(memo) + len(memo.old) < 200
    encoder = tokenizing.Encoder(PATH, limit=100_000)
    for i in range(20):
        texts = ["京" * (20_000 + i), "x1" * (10_000 + i), " ".join(f"v{j}w" for j in range(200 * i, 200 * i + 200))]
        for text, found in zip(texts, encoder.look_up([tokenizing.split_words(t) for t in texts])):
            assert np.frombuffer(b"".join(found), encoder.dtype).tolist() == ids(text)
    for table in (encoder.words, encoder.old, encoder.pieces, encoder.pieces.old):
        assert max(map(len, table), default=0) <= LONGEST_KEY and sum(map(len, table)) < 40_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aetnrh.,:\n\xe9ß\xa0京é'0"), max_size=12), min_size=1, max_size=30))
def test_words_coded_together(words):
    text = " ".join(words)
    assert np.frombuffer(tokenizing.encode_bytes(PATH, [text])[0], tokenizing.id_type(PATH)).tolist() == ids(text)


def test_buckets_grow_slower_than_text(spark, monkeypatch):
    counts = [bpe_codec.bucket_count(n) for n in (0, 1, 16 << 20, 1 << 30, 1 << 31, 10**13)]
    assert counts[:4] == [1, 1, 1, 64] and counts == sorted(counts) and counts[5] < 2 * 64 * (10**13 / (1 << 30)) ** 0.6
    monkeypatch.setattr(bpe_codec, "BUCKET_BYTES", 500)
    monkeypatch.setattr(bpe_codec, "MANY", 4)
    docs = documents(spark, extra=True)
    assert rows_of(bpe_codec.encode(docs, digest_only=True)) == sorted(coded(i, t) for i, t in enumerate(TEXTS, 1))

"""Token files and packing: ids as the library gives them, exact round trips, no padding."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import repair
from sievework.llm.packing import binary_pieces, pack_power_of_two
from sievework.llm.tokenize import encoder
from tests.llm.helpers import ROWS, documents, with_extra

VOCABULARIES = {"byte_bpe_50k.json": "space", "word_bpe_49k.json": "words"}


@functools.cache
def library(name):
    """The library as it is."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text, end: [*t.encode(text or "", add_special_tokens=False).ids, end]


#: White space, marks, combining and growing characters, control characters, other scripts; strings of added tokens.
ALPHABET = [*"ab .,'\n\t\x01\x02éß😀1_\"%- ́　Σ|İıǅﬁ<>\x85\u200b", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "İ...", "It's", "日本"]


def test_chunks_are_neutral_for_awkward_texts():
    texts = ["aİ...", "a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y  <|endoftext|>\nz", "İ", "AİB, cİ!", None, ""]
    for name, cut in VOCABULARIES.items():
        e, encode = encoder(public_tokenizers.path(name), cut), library(name)
        ids, at = e(pa.array(texts, pa.string()))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [encode(t, 0)[:-1] for t in texts]
    assert encoder(public_tokenizers.path("byte_bpe_50k.json"), "space")(pa.array([texts[1]]))[0].tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_chunks_are_neutral_for_random_texts(name):
    rng = random.Random(len(name))
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(30))) for _ in range(3000)]
    e, lib = encoder(public_tokenizers.path(name), VOCABULARIES[name]), Tokenizer.from_file(public_tokenizers.path(name))
    ids, at = e(pa.array(texts, pa.string()))
    odd = [t for i, (t, want) in enumerate(zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True)) if ids[at[i] : at[i + 1]].tolist() != want.ids]
    assert not odd


@pytest.mark.parametrize("name", VOCABULARIES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), min_size=1, max_size=6))
def test_chunks_are_neutral(name, texts):
    ids, at = encoder(public_tokenizers.path(name), VOCABULARIES[name])(pa.array(texts, pa.string()))
    encode = library(name)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encode(t, 0)[:-1], t


def test_token_shards_round_trip(spark):
    _, path = repair.write_token_shards(documents(spark), shard_ids=200, least=2)
    got = repair.read_token_shards(spark, path).orderBy("start").collect()
    encode = library("byte_bpe_50k.json")
    want = [encode(t, 2) for _, t, _, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r.n_tokens for r in got] == list(map(len, want))


def test_hot_ids_spread_and_stay_in_order(spark):
    rows = [(5, f"t{i}", None, None) for i in range(400)] + [(None, f"n{i}", None, None) for i in range(300)] + [(i, "x", None, None) for i in range(300)]
    dealt = repair.in_order(documents(spark, rows).select("doc_id", "text"), "doc_id", "text", 8)
    parts = dealt.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("low"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("high")).orderBy("p").collect()
    assert sum(r.n for r in parts) == 1000 and max(r.n for r in parts) < 350
    assert all(a.high <= b.low for a, b in zip(parts[:-1], parts[1:], strict=True))
    _, path = repair.write_token_shards(documents(spark, rows))
    got = [r.doc_id for r in repair.read_token_shards(spark, path).orderBy("start").collect()]
    assert got == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))


def test_random_access(spark):
    table, _ = repair.write_token_shards(documents(spark), shard_ids=10**6, least=2)
    encode = library("byte_bpe_50k.json")
    texts = {k: t for k, t, _, _ in ROWS}
    for shard in table.collect():
        for n, doc in enumerate(shard.doc_ids):
            assert repair.read_document(shard.asDict(), n).tolist() == encode(texts[doc], 2)


def test_grammar_saves_and_never_crosses_documents():
    ids = np.array([5, 6, 7, 8] * 200 + [5, 6], np.uint32)
    ends = np.array([400, 402, 802])
    g, symbols, counts = repair.compress(ids, ends, 100, 6, 50, 2)
    assert len(symbols) < len(ids) / 3 and counts.sum() == len(symbols)
    at = np.concatenate(([0], np.cumsum(counts)))
    for k in range(3):
        assert repair.expand(g, symbols[at[k] : at[k + 1]]).tolist() == ids[([0, 400, 402][k]) : ends[k]].tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=5))
def test_repair_is_lossless(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    ends = np.cumsum([len(d) for d in docs])
    g, symbols, counts = repair.compress(ids, ends, 4, 5, 7, 2)
    assert repair.expand(g, symbols).tolist() == ids.tolist() and counts.sum() == len(symbols)
    assert g.sizes.tolist() == [len(repair.expand(g, np.array([4 + k]))) for k in range(len(g.rules))]


def test_ids_that_16_bits_cannot_hold_raise():
    with pytest.raises(ValueError, match="16-bit"):
        repair.compress(np.array([70_000, 99_999], np.uint32), np.array([2]), 100_000, 3, 10, 2)
    with pytest.raises(ValueError, match="16-bit"):
        repair.compress(np.array([70_000], np.uint32), np.array([1]), 50_000, 3, 10, 2)


def test_repeated_passages_shrink_by_more_than_a_round():
    """Copies of a long text take a few symbols each."""
    text = np.random.RandomState(5).randint(0, 500, 400)
    g, symbols, counts = repair.compress(np.tile(text, 50).astype(np.uint32), np.arange(400, 20_001, 400), 500, 8, 1900, 4)
    assert max(counts) <= 4 and g.sizes.max() >= 128
    assert repair.expand(g, symbols[: counts[0]]).tolist() == text.tolist()


def test_packing(spark):
    got = pack_power_of_two(documents(spark)).collect()
    encode = library("word_bpe_49k.json")
    assert len({r.sequence_id for r in got}) == len(got)
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id, r.row_no, r.sequence_id >> 41), []).append(r)
    assert len(seen) == len(ROWS)
    texts = {k: t for k, t, _, _ in ROWS}
    for (doc, _, _), pieces in seen.items():
        pieces.sort(key=lambda r: r.start)
        want = encode(texts[doc], 1)
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        for r in pieces:
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(want) and r.length == 1 << r.bucket
    assert max(r.length for r in got) == 2048


def test_packing_crc_and_reruns(spark):
    def run():
        return sorted(map(tuple, pack_power_of_two(documents(spark)).select("sequence_id", F.crc32("ids"), "length").collect()))

    assert run() == run()
    r = pack_power_of_two(documents(spark)).select("ids", F.crc32("ids").alias("c")).first()
    assert r.c == zlib.crc32(bytes(r.ids))


def test_binary_pieces():
    doc, size = binary_pieces(np.array([5, 4096 + 3, 0, 1]), 2048)
    assert doc.tolist() == [0, 0, 1, 1, 1, 1, 3] and size.tolist() == [4, 1, 2048, 2048, 2, 1, 1]
    with pytest.raises(ValueError, match="power of two"):
        pack_power_of_two(None, longest=100)


def test_empty_tables_and_extra_columns(spark):
    none = documents(spark, []).coalesce(1)
    assert pack_power_of_two(none).count() == 0
    _, path = repair.write_token_shards(none)
    assert repair.read_token_shards(spark, path).count() == 0
    assert pack_power_of_two(with_extra(spark)).select("row_no").count() > len(ROWS)
    _, path = repair.write_token_shards(with_extra(spark))
    assert repair.read_token_shards(spark, path).count() == len(ROWS)

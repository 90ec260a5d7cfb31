"""Exact and near duplicates against plain versions."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import exact_dedup as exact_dedup_module
from sievework.llm import ngram_join as nj
from sievework.llm.common import shingle_sets, text_bytes
from sievework.llm.components import connected_components
from sievework.llm.exact_dedup import ContentTable, exact_dedup, grace
from tests.llm.helpers import BASE, ROWS, components, documents, shingles, with_extra


def packed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup(spark):
    got = exact_dedup(documents(spark)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for k, t, _, _ in ROWS:
        groups.setdefault(packed(t), []).append((k, len(t or "")))
    by_sha = {hashlib.sha256(p.encode()).hexdigest(): sorted(g, key=lambda x: (-x[1], x[0] is None, x[0])) for p, g in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (g[0][0], len(g))
    assert sum(r.kept for r in got) == len(groups)  # of repeated rows one
    assert {r.doc_id: r.keep_id for r in got if r.doc_id in (1, 3, 5, 6, 7, 8, 9)} == {1: 3, 3: 3, 5: 7, 6: 7, 7: 7, 8: 9, 9: 9}


def test_exact_dedup_tags_budget_and_empty(spark):
    rows = with_extra(spark).withColumn("no", F.monotonically_increasing_id())
    small = exact_dedup(rows, budget=100, tag_col="no").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "tag").collect()
    assert len({r.tag for r in small}) == len(ROWS)
    large = exact_dedup(documents(spark)).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    strip = lambda rs: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rs)
    assert strip(small) == strip(large)
    assert exact_dedup(documents(spark, [])).count() == 0


@pytest.mark.parametrize("budget", [1, 500, 10**6])
def test_grace_spills_until_it_fits(tmp_path, budget):
    rng = random.Random(3)
    contents = [bytes([rng.randrange(4) for _ in range(rng.randrange(1, 5))]) for _ in range(500)]
    key = lambda c: int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "big") if c[0] else 7  # noqa: E731  many share a hash
    found = list(grace(((key(c), c, 1, (len(c), i, 0, i), [i]) for i, c in enumerate(contents)), budget, Path(tmp_path)))
    assert sorted(f[0] for f in found) == sorted(set(contents))
    for content, tags, n, best in found:
        mine = [i for i, c in enumerate(contents) if c == content]
        assert sorted(tags) == mine and n == len(mine) and best[1] == mine[0]
    assert not list(tmp_path.iterdir())


class Spill(list):
    """Counts what is written to spill files."""

    def watch(self, monkeypatch):
        dump = exact_dedup_module.pickle.dump
        monkeypatch.setattr(exact_dedup_module.pickle, "dump", lambda x, f, p: (self.append(len(x[1]) if isinstance(x[1], bytes) else 0), dump(x, f, p))[1])
        return self


@pytest.mark.parametrize("others", [0, 300])
def test_copies_of_one_text_stay_small(tmp_path, monkeypatch, others):
    """1,000 copies of a text a tenth of the budget: neither spilled again and again nor held, though other texts fill the table first."""
    spill = Spill().watch(monkeypatch)
    rng = random.Random(2)
    filler = [rng.randbytes(4_000) for _ in range(others)]
    hot = rng.randbytes(100_000)
    every = [*filler, *[bytes(hot) for _ in range(1000)]]
    key = lambda c: int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "big")
    tracemalloc.start()
    found = list(grace(((key(c), bytes(bytearray(c)), 1, (len(c), i, 0, i), [i]) for i, c in enumerate(every)), 10**6, Path(tmp_path)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(len(f[1]) for f in found) == [1] * others + [1000]
    assert sum(spill) <= (0 if not others else 2 * len(filler) * 4_000 + 2 * len(hot))
    assert peak < 6 * 10**6


def test_hot_hashes_collapse_first(spark):
    rows = [(i, "one text" if i % 3 else f"text {i}", None, None) for i in range(300)]
    docs = documents(spark, rows).repartition(9)
    strip = lambda df: sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    got = strip(exact_dedup(docs, hot_from=2, budget=300))
    assert got == strip(exact_dedup(docs))
    assert {r[1] for r in got if r[0] % 3} == {1} and sum(r[3] for r in got) == 101


def test_content_table_compares_content():
    t = ContentTable()
    assert [t.add(5, b"a"), t.add(5, b"b"), t.add(5, b"a")] == [(0, True), (1, True), (0, False)]
    for i in range(5000):
        t.add(i % 7, str(i).encode())
    assert t.add(3, b"3")[1] is False and len(t.contents) == 5002


def near_rows(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, bases = [], [[rng.choice(vocab) for _ in range(rng.randrange(20, 120))] for _ in range(6)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if i % 5 == 0:
            w = [rng.choice(vocab) for _ in range(15)] + passage
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80), (1, 60)])
def test_near_duplicates(spark, size, num):
    rows = near_rows() + [(k if k is None else k + 1000, t) for k, t, _, _ in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.ngram_jaccard_join(docs, size=size, num=num).collect())
    assert got == sorted((str(k), n, str(c)) for k, n, c in components(rows, size, num, 100))


def test_frequent_shingles_are_counted(spark):
    rows = near_rows(80, 4)
    texts = spark.createDataFrame(rows, "id long, text string")
    keys, counts = nj.frequent_shingles(texts, 4, least=2)
    every = Counter(s for _, t in rows for s in shingles(t, 4))
    assert sorted(counts.tolist()) == sorted(n for n in every.values() if n > 1)
    some, least = nj.frequent_shingles(texts, 4, least=2, most=len(keys) // 2)
    assert 0 < len(some) < len(keys) and len(some) == sum(n >= 2 ** int(np.log2(least.min())) for n in every.values())


def test_long_lists_and_bundles_are_dealt_out(spark):
    """With lists of over 8 entries and bundles of over 8 nodes cut, no part is large and the links are the same."""
    rows = near_rows(200, 4) + [(1000 + i, f"{BASE} x{i} y") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    want = sorted(components(rows, 2, 80, 100))
    for block, node_block in ((8, (4, 8)), (8, (4, 10**6)), (nj.BLOCK, (4, 8))):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_jaccard_join(docs, size=2, num=80, block=block, node_block=node_block).collect())
        assert got == want
    largest = {}
    for block in (8, nj.BLOCK):
        entries = nj.inverted_lists(texts, 2, 80, 100, block).where("is_entry").select("grp", "bundle")
        largest[block] = entries.groupBy("bundle").count().agg(F.max("count")).first()[0]
    assert largest[8] < largest[nj.BLOCK] / 2  # lists with one least group are one bundle still; its nodes are dealt out next
    entries = spark.createDataFrame([(g, b) for g in range(100) for b in (1, 2 + g // 2)], "grp long, bundle long")
    nodes = spark.createDataFrame([(g, bytearray(f"{g}-{i}", "ascii"), 5, bytearray(16)) for g in range(100) for i in range(3)], "grp long, node binary, n int, sketch binary")
    parts = nj.parts_of_bundles(entries, nodes, (10, 20)).collect()
    sizes, met, of = Counter((r.bundle, r.part) for r in parts), set(), defaultdict(list)
    assert max(sizes.values()) <= 80  # two blocks of about 20, by hash
    for r in parts:
        of[r.bundle, r.part].append(bytes(r.node))
    for (bundle, _), names in of.items():
        met |= {(bundle, a, b) for a in names for b in names}
    every = [f"{g}-{i}".encode() for g in range(100) for i in range(3)]
    assert met >= {(1, a, b) for a in every for b in every}
    assert sum(v for (b, _), v in sizes.items() if b != 1) == 300


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        w = (BASE + " " + BASE[::-1]).split()
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_jaccard_join(docs, size=2, num=85).collect())
    assert got == sorted(components(rows, 2, 85, 100))


def test_near_duplicates_of_nothing(spark):
    assert nj.ngram_jaccard_join(documents(spark, [])).count() == 0
    got = nj.ngram_jaccard_join(documents(spark, [(1, None, None, None), (2, " ", None, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2)]
    assert nj.ngram_jaccard_join(with_extra(spark)).count() == len(ROWS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB é\t\n"), max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_shingle_sets_have_the_right_sizes(texts, size):
    hashes, at = shingle_sets(*text_bytes(pa.array(texts, pa.string())), size)
    assert np.diff(at).tolist() == [len(shingles(t, size)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80))
def test_sketches_bound_overlaps(x, y):
    one, two = sorted(x | set(list(y)[:40])), sorted(y)
    at = np.array([0, len(one), len(one) + len(two)])
    a, b = nj.sketches(np.array(one + two, np.uint64), at)
    size = min(len(a), len(b))
    bound = np.minimum(nj.folded(np.frombuffer(a, np.uint8), size), nj.folded(np.frombuffer(b, np.uint8), size)).sum()
    assert bound >= len(set(one) & set(two))


def test_filter_hash_is_sparks(spark):
    keys = np.random.RandomState(1).randint(0, 2**63, (50, 2)).astype(np.uint64)
    rows = spark.createDataFrame([(i, bytearray(k.tobytes())) for i, k in enumerate(keys)], "i int, node binary")
    want = {r.i: r.h for r in rows.select("i", F.xxhash64("node").alias("h")).collect()}
    assert nj.spark_xxhash64_of_16(keys).astype(np.int64).tolist() == [want[i] for i in range(50)]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (7, 9), (5, 5), (20, 19), (2, 1)] + [(i, i + 1) for i in range(30, 60)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((7, 8, 9), 7), **dict.fromkeys((19, 20), 19), **dict.fromkeys(range(30, 61), 30)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("num", [48, 30])
def test_links_of_sizes_far_apart(spark, num):
    """Below a threshold of a half, sizes of a link, and widths of sketches, differ by more than twice."""
    long = [f"w{i}" for i in range(128)]
    rows = [(1, " ".join(long[:63])), (2, " ".join(long)), (3, " ".join(f"v{i}" for i in range(40))), (4, " ".join(f"v{i}" for i in range(130)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_jaccard_join(docs, size=1, num=num).collect())
    assert got == sorted(components(rows, 1, num, 100))
    assert [r[2] for r in got] == ([1, 1, 3, 3] if num == 30 else [1, 1, 3, 4])

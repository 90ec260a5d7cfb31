"""Clusters and codes of vectors, and I-Match fingerprints."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import clusters, codebooks, imatch, queries
from sievework.llm.vectors import largest
from sievework.plans.oracle import connect, differences
from tests.llm.helpers import ROWS, documents, with_extra, words

NAN, INF = float("nan"), float("inf")
DDL = "vec_id long, embedding array<double>, label int"


def vectors(dim, n=150, kinds=17, seed=3):
    """Vectors with many equal ones, and ones that are left out."""
    rng = random.Random(seed)
    base = [[rng.uniform(-0.5, 0.5) for _ in range(dim)] for _ in range(kinds)]
    rows = [(i, base[rng.randrange(kinds)] if i % 3 else [rng.uniform(-0.5, 0.5) for _ in range(dim)], i % 4 if i % 5 else None) for i in range(n)]
    odd = [None, [], [0.1] * (dim - 1), [NAN] + [0.0] * (dim - 1), [INF] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1)]
    rows += [(1000 + i, v, 7) for i, v in enumerate(odd)]
    rows += [(5, rows[5][1], 1), (None, [0.25] * dim, None), (None, [1e30, -1e30] * (dim // 2), 2)]
    rng.shuffle(rows)
    return rows


def whole(v, scale, dim):
    most = largest(dim)
    return [min(max(math.floor(scale * x), -most), most) for x in v]


def good(v, dim):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def best(v, table):
    return min((far(v, c), i) for i, c in enumerate(table))


def means(vs, at, table):
    out = []
    for i, c in enumerate(table):
        mine = [v for v, k in zip(vs, at, strict=True) if k == i]
        out.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c)
    return out


def plain_clusters(rows, k, rounds, scale, dim, seed):
    kept = [(i, whole(v, scale, dim)) for i, v, _ in rows if good(v, dim)]
    vs = [v for _, v in kept]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    table = [v for _, v in sorted(kept, key=rank)[:k]]
    for _ in range(rounds):
        table = means(vs, [best(v, table)[1] for v in vs], table)
    near = [best(v, table) for v in vs]
    top = 2**63 - 1
    by = {c: min(top, sum(d for d, x in near if x == c)) for _, c in near}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in table]
    return [(i, c, d, by[c], min(top, sum(d for d, _ in near)), digest[c]) for (i, _), (d, c) in zip(kept, near, strict=True)]


def plain_codes(rows, parts, entries, rounds, scale, dim):
    kept = [(i, whole(v, scale, dim) if len(v) == dim else None, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    m = dim // parts
    cut = lambda v, p: v[p * m : (p + 1) * m]
    fitted = [(i, v) for i, v, _ in kept if v is not None]
    first = sorted(fitted, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = []
    for p in range(parts):
        table, vs = [cut(v, p) for _, v in first], [cut(v, p) for _, v in fitted]
        for _ in range(rounds):
            table = means(vs, [best(v, table)[1] for v in vs], table)
        books.append(table)
    digest = hashlib.sha256(",".join(str(x) for t in books for c in t for x in c).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        near = [best(cut(v, p), t) for p, t in enumerate(books)] if v is not None else None
        out.append((i, "".join(f"{c:02x}" for _, c in near) if near else None, sum(d for d, _ in near) if near else None, label))
    total = {}
    for _, _, e, label in out:
        total[label] = (total.get(label) or 0) + e if e is not None else total.get(label)
    return [(i, c, e, total[label], digest) for i, c, e, label in out]


def same(found, wanted):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("k", [5, 400])
def test_clusters_of_distinct_vectors(spark, k):
    rows = vectors(8)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL + ", q int, cluster string").repartition(3)
    found = clusters.cluster_vectors(df, k=k, rounds=3, scale=64, dim=8, seed=9)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(found.collect(), plain_clusters(rows, k, 3, 64, 8, 9))


def test_codes_of_parts(spark):
    rows = vectors(8)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL + ", error int, code string").repartition(3)
    found = codebooks.compress_vectors(df, parts=2, entries=20, rounds=3, scale=64, dim=8)
    same(found.collect(), plain_codes(rows, 2, 20, 3, 64, 8))


def test_vectors_of_empty_and_unfit_tables(spark):
    for rows in ([], [(1, None, 1), (2, [NAN] * 8, None), (3, [0.5] * 7, 2)]):
        df = spark.createDataFrame(rows, DDL)
        assert clusters.cluster_vectors(df, dim=8).collect() == []
        assert [tuple(r)[:4] for r in codebooks.compress_vectors(df, dim=8).collect()] == [(3, None, None, None)][: len(rows)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 30, 700, 10**5, largest(16)]), st.booleans())
def test_screening_leaves_the_nearest(seed, high, close):
    """Exact nearest entries whatever the sizes of components, with ties and entries one unit apart."""
    rng = np.random.RandomState(seed)
    c = rng.randint(-high, high + 1, (40, 16)).astype(np.int64)
    c[20:30] = c[:10]
    if close:
        c[30:] = np.clip(c[0] + rng.randint(-1, 2, (10, 16)), -high, high)
    v = np.concatenate((rng.randint(-high, high + 1, (30, 16)), c[:10], (c[:10] + c[10:20]) // 2)).astype(np.int64)
    d = ((v[:, None, :] - c[None]) ** 2).sum(2)
    assert codebooks.nearest(v, c).tolist() == d.argmin(1).tolist()
    may = codebooks.candidates(v, c)
    assert all(may[i, j] for i, j in zip(*np.nonzero(d == d.min(1)[:, None]), strict=True))
    at, least = clusters.nearest(v, c)
    assert at.tolist() == d.argmin(1).tolist() and least.tolist() == d.min(1).tolist()


def test_screening_is_narrow():
    rng = np.random.RandomState(1)
    v, c = (np.floor(rng.randn(2000, 16) * 150).astype(np.int64), np.floor(rng.randn(256, 16) * 150).astype(np.int64))
    assert codebooks.candidates(v, c).sum() < 2010


@pytest.mark.parametrize("name", ["op11_weighted_centroids", "op13_vector_codes"])
def test_vector_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name]) == ([], [], [])


# --- fingerprints ------------------------------------------------------------


def plain_lexicon(texts, common, rare):
    n = len(texts)
    count = {}
    for t in texts:
        for w in set(words(t)):
            count[w] = count.get(w, 0) + 1
    return {w for w, c in count.items() if c >= max(2, n / 2**rare) and c <= n / 2**common}


def test_lexicon_is_the_band(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("aeiou") * rng.randrange(1, 9) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = imatch.lexicon(df, common=2, rare=6)
    wanted = sorted(plain_lexicon(texts, 2, 6))
    hashes = [int(imatch.shingle_sets(*imatch.text_bytes(imatch.pa.array([w])), 1)[0][0]) for w in wanted]
    assert found.tolist() == sorted(hashes) and len(hashes) > 5


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), r[1] or ""))


def test_fingerprints_with_neighbours(spark):
    long = [(100 + i, " ".join(f"term{(i * 7 + j * j) % 90}" for j in range(40)) + " é😀", "en", "a") for i in range(60)]
    rows = [*ROWS, *long, (400, long[3][1], "en", "b")]
    found = imatch.fingerprint_with_neighbours(with_extra(spark, rows).repartition(3)).collect()
    wanted, line = [], ordered(rows)
    for k, r in enumerate(line):
        text, after = r[1] or "", line[(k + 1) % len(line)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        wanted.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), edited))
    same([(r.doc_id, r.n_chars, r.edited_sha256) for r in found], [w[:3] for w in wanted])
    by_text = {}
    for r in found:
        for t, f in ((next((x[1] or "") for x in line if x[0] == r.doc_id and len(x[1] or "") == r.n_chars), r.fingerprint), (next(w[3] for w in wanted if w[:3] == (r.doc_id, r.n_chars, r.edited_sha256)), r.edited_fingerprint)):
            assert by_text.setdefault(t, f) == f
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {r.near_edited for r in found if r.doc_id in (5, 6)} == {1.0}
    assert next(r for r in found if r.doc_id == 5).near_next == 1.0  # null and empty texts are the same text
    assert imatch.fingerprint_with_neighbours(documents(spark, [])).collect() == []
    one = imatch.fingerprint_with_neighbours(documents(spark, [(3, "abcdefgh", None, None)])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_subset_hashes_follow_their_definition():
    rng = np.random.RandomState(2)
    docs = [np.unique(rng.randint(1, 2**62, n).astype(np.uint64)) for n in (0, 1, 2, 5, 90, 3000)]
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    rows = imatch.subset_hashes(np.concatenate(docs), at)
    for d, row in zip(docs, rows, strict=True):
        alone = imatch.subset_hashes(d, np.array([0, len(d)]))[0]
        assert alone.tolist() == row.tolist()
        for j in range(1, imatch.SHARES + 1):
            for r in range(imatch.REPEATS):
                column = 1 + (j - 1) * imatch.REPEATS + r
                kept = [t for t in d.tolist() if int(imatch.mix(np.array([t], np.uint64) ^ imatch._SEEDS[r])[0]) < 2 ** (64 - j)]
                hashed = kept and (len(d) * 2.0**-j <= imatch.FEW or j == imatch.SHARES)
                assert bool(row[column]) == bool(hashed)
                if hashed and j > 1:  # a term that the subset drops changes nothing, one that it keeps changes the hash
                    other = imatch.subset_hashes(np.array(kept[1:], np.uint64), np.array([0, len(kept) - 1]))[0][column]
                    assert other != row[column]


def test_likeness_grows_with_common_terms():
    found = np.zeros((20, 5))
    for seed, row in enumerate(found):
        rng = np.random.RandomState(seed)
        pool = rng.permutation(np.unique(rng.randint(1, 2**62, 600).astype(np.uint64)))
        base = np.sort(pool[:200])
        for k, changed in enumerate((0, 20, 60, 120, 200)):
            other = np.sort(np.concatenate((rng.permutation(base)[: 200 - changed], pool[300 : 300 + changed])))
            a, b = (imatch.subset_hashes(x, np.array([0, len(x)])) for x in (base, other))
            row[k] = imatch.likeness(np.array([200]), a, np.array([200]), b)[0]
    assert (found[:, 0] == 1).all() and (found[:, -1] == 0).all()
    assert (np.diff(found.mean(0)) < -0.1).all()

"""Quality and language: held-out accuracy, folds, and the awkward rows."""

import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm.common import _BYTES, mix, text_bytes
from sievework.llm.langid import DIMS, UNKNOWN, Hierarchy, family_of, fit_hierarchy, fit_svm, has_letter, ngram_features, predict_languages, train_languages
from sievework.llm.quality import Trees, fit_trees, fold, score_quality, train_quality
from sievework.llm.queries import op2_gbt_quality
from sievework.llm.textstats import FEATURES, document_statistics
from tests.llm.helpers import ROWS, documents, with_extra

import pyarrow as pa

SYLLABLES = {"en": "the ing er tion and st ha", "de": "der ung sch ein lich ver ü", "fr": "le eau oi que é des ai", "es": "el ción do ar ñ os que"}


def text_of(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def language_rows(n=400, seed=2):
    rng = random.Random(seed)
    langs = list(SYLLABLES)
    return [(i, text_of(rng, langs[i % 4], rng.randrange(8, 60)), langs[i % 4], None) for i in range(n)]


def test_language_held_out(spark):
    docs = documents(spark, language_rows())
    got = {r.doc_id: r for r in predict_languages(docs, train_languages(docs)).collect()}
    held = [(i, lang) for i, _, lang, _ in language_rows() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_learns_from_its_folds_only(spark):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "xx", s) for i, t, lang, s in language_rows()]
    model = train_languages(documents(spark, rows))
    assert sorted(x for m in model.members for x in m) == ["de", "en", "es", "fr"]
    assert [sorted(m) for m in model.members] == [["de", "en"], ["es", "fr"]]


def test_language_edges(spark):
    docs = documents(spark, [*language_rows(40), (900, None, "en", None), (901, "", "en", None), (902, "123 +-", None, None), (903, "日本", None, None), (None, "le eau oi", None, None)])
    got = {r.doc_id: r for r in predict_languages(docs, train_languages(docs)).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == [UNKNOWN] * 3 and got[900].score == 0
    assert got[903].lang_pred != UNKNOWN and got[None].lang_pred in SYLLABLES
    assert predict_languages(documents(spark, []), Hierarchy()).count() == 0
    assert {r.lang_pred for r in predict_languages(with_extra(spark), train_languages(documents(spark, []))).collect()} == {UNKNOWN}
    one = train_languages(documents(spark, [(i, "the ing", "en", None) for i in range(9)]))
    assert predict_languages(documents(spark, [(1, "abc", None, None)]), one).first().lang_pred == "en"


def test_three_in_a_family():
    rng = random.Random(5)
    langs = ["de", "en", "nl"]
    words = {"de": "der ung sch", "en": "the ing er", "nl": "het ijk een"}
    texts = [" ".join(rng.choice(words[langs[i % 3]].split()) for _ in range(20)) for i in range(150)]
    x = ngram_features(*text_bytes(pa.array(texts)))
    model = fit_hierarchy(x[:100], [langs[i % 3] for i in range(100)])
    assert [len(m) for m in model.machines] == [3]  # one versus one
    assert model.predict(x[100:])[0] == [langs[i % 3] for i in range(100, 150)]


def test_families_and_letters():
    assert family_of("de-AT") == "germanic" and family_of("eu") == "only eu"
    assert has_letter(*text_bytes(pa.array(["1", "é", "", "a", "😀", "٣"]))).tolist() == [False, True, False, True, False, False]


def quality_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        t = text_of(rng, "en", rng.randrange(20, 80))
        rows.append((i, t if good else rng.choice([" ".join(w + "$$$" for w in t.split()), (t[:30] + " ") * 12, t.upper()]), None, None))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = quality_rows()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_quality(docs, train_quality(docs, marks)).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_learns_from_its_folds_only(spark):
    rows, labels = quality_rows(200)
    docs = documents(spark, rows)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    a, b = (train_quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a.prior == b.prior and (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_quality_bound_and_edges(spark):
    rows, labels = quality_rows(200)
    docs = documents(spark, [*rows, *ROWS])
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    trees = train_quality(docs, marks, most=50)
    scored = score_quality(docs, trees, keep=("lang", "text")).collect()
    assert len(scored) == len(rows) + len(ROWS) and scored[0].text is not None
    none = train_quality(docs, marks.limit(0))
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(documents(spark, []), trees).count() == 0
    assert score_quality(with_extra(spark), trees).count() == len(ROWS)


def test_bounds_hold_for_rows(spark, monkeypatch):
    """An id with many texts doesn't bring more rows to the driver than the bound."""
    fitted = []
    monkeypatch.setattr(sys.modules["sievework.llm.quality"], "fit_trees", lambda x, y, **_: fitted.append(len(x)))
    monkeypatch.setattr(sys.modules["sievework.llm.langid"], "fit_hierarchy", lambda x, langs: fitted.append(len(x)))
    rows = [(1, text_of(random.Random(i), "en", 9), "en", None) for i in range(90)]
    docs = documents(spark, rows)
    train_quality(docs, spark.createDataFrame([(1, 1, 0)] * 5, "doc_id long, quality int, toxic int"), most=7)
    train_languages(docs, most=3)
    assert fitted == [7, 3]


def plain_trees(x, y, trees, depth, rate, bins, least, l2):
    """Boosting as a recursion over lists of rows: every cut of every feature is tried by summing gradients of its rows."""
    n = len(y)
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for c in x.T]
    prior = math.log(y.mean() / (1 - y.mean()))
    margin = [prior] * n
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [y[i] - p[i] for i in range(n)], [max(p[i] * (1 - p[i]), 1e-9) for i in range(n)]

        def grow(rows, level, g=g, h=h):
            total, weight = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = (1e-6, None, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for t in cuts[f]:
                        low = [i for i in rows if x[i, f] <= t]
                        a, b = sum(g[i] for i in low), sum(h[i] for i in low)
                        if b < least or weight - b < least:
                            continue
                        gain = a**2 / (b + l2) + (total - a) ** 2 / (weight - b + l2) - total**2 / (weight + l2)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, t)
            if best[1] is None:
                for i in rows:
                    margin[i] += rate * total / (weight + l2)
                return
            grow([i for i in rows if x[i, best[1]] <= best[2]], level + 1)
            grow([i for i in rows if x[i, best[1]] > best[2]], level + 1)

        grow(list(range(n)), 0)
    return margin


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trees_are_those_of_a_plain_search(seed):
    rng = np.random.RandomState(seed)
    x = np.concatenate((rng.rand(310, 3), rng.randint(0, 3, (310, 1))), 1)
    y = ((x[:, 0] + x[:, 1] * (x[:, 3] > 0) + 0.3 * rng.rand(310)) > 0.9).astype(float)
    options = {"trees": 4, "depth": 3, "rate": 0.3, "bins": 8, "least": 1.0, "l2": 1.0}
    assert fit_trees(x, y, **options).margin(x) == pytest.approx(plain_trees(x, y, **options), abs=1e-9)


def test_query_scores_are_those_of_single_documents(spark, tmp_path):
    """op2's rows against statistics, trees and bar worked out a document at a time."""
    rows, labels = quality_rows(150)
    documents(spark, [*rows, *ROWS]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op2_gbt_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(ROWS)
    stats = lambda t: document_statistics(*text_bytes(pa.array([t or ""])))[0]
    learn = [(stats(t), q) for (i, t, _, _), (_, q, _) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    learn += [(stats(t), labels[k][1]) for k, t, _, _ in {r[:1] + r[1:]: r for r in ROWS}.values() if k is not None and zlib.crc32(str(k).encode()) % 5]
    trees = fit_trees(np.stack([s for s, _ in learn]), np.array([float(q) for _, q in learn]))
    texts = Counter()
    for i, t, _, _ in [*rows, *ROWS]:
        margin = trees.prior
        for f, cut, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(stats(t)[f[node]] > cut[node])
            margin += leaf[node - len(f)]
        texts[i, round(1 / (1 + math.exp(-margin)), 6)] += 1
    assert texts == Counter((r.doc_id, round(r.score, 6)) for r in got)
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def plain_features(text):
    """Byte n-grams of 2 to 4 that hold a letter, each hashed by itself."""
    data = (text or "").encode()
    letter = [chr(b).isalpha() if b < 128 else True for b in data]
    value = [int(_BYTES[b]) if w else 1 for b, w in zip(data, letter, strict=True)]
    row = np.zeros(DIMS)
    for k in (2, 3, 4):
        for i in range(len(data) - k + 1):
            if any(letter[i : i + k]):
                h = value[i]
                for v in value[i + 1 : i + k]:
                    h = (h * 0x9E3779B97F4A7C15 + v) % 2**64
                row[int(mix(np.array([h], np.uint64))[0]) >> 52] += 1
    row = np.sqrt(row)
    return row / np.linalg.norm(row) if row.any() else row


def test_language_votes_are_those_of_single_texts(spark):
    """Predictions against features, family and duels worked out one text at a time."""
    docs = [*language_rows(120), (900, "1 2", None, None), (901, "a", None, None), (902, "Über den le eau" * 300, None, None)]
    model = train_languages(documents(spark, docs))
    got = {r.doc_id: r for r in predict_languages(documents(spark, docs), model).collect()}
    for i, t, _, _ in docs:
        x = np.append(plain_features(t), 1.0)
        assert x[:-1] == pytest.approx(ngram_features(*text_bytes(pa.array([t])))[0], abs=1e-6)
        z = [float(w @ x) for w in model.weights]
        family = z.index(max(z))
        share = math.exp(max(z)) / sum(map(math.exp, z))
        wins, belief = Counter(), Counter()
        for a, b, w in model.machines[family]:
            m = float(w @ x)
            wins[a if m > 0 else b] += 1
            q = 1 / (1 + math.exp(-4 * m))
            belief[a] += q
            belief[b] += 1 - q
        names = model.members[family]
        best = max(range(len(names)), key=lambda k: (wins[k], belief[k]))
        if any(c.isalpha() for c in t):
            assert got[i].lang_pred == names[best]
            assert got[i].score == pytest.approx(share * (belief[best] / (len(names) - 1) if len(names) > 1 else 1), abs=1e-4)
        else:
            assert (got[i].lang_pred, got[i].score) == (UNKNOWN, 0)


def test_duels_minimise_the_squared_hinge():
    """A machine loses no more than a slow plain descent."""
    rng = np.random.RandomState(4)
    x1 = np.concatenate((rng.rand(60, 5), np.ones((60, 1))), 1).astype(np.float32)
    side = np.where(x1[:, 0] > x1[:, 1], 1.0, -1.0).astype(np.float32)
    loss = lambda w: float(np.mean(np.maximum(0, 1 - side * (x1 @ w)) ** 2) + 5e-5 * w @ w)
    w = np.zeros(6)
    for _ in range(5000):
        gap = np.maximum(0, 1 - side * (x1 @ w))
        w -= 0.1 * (-2 * (x1.T @ (gap * side)) / 60 + 1e-4 * w)
    assert loss(fit_svm(x1, side, steps=2000)) <= 1.001 * loss(w)


def test_trees_find_an_interaction():
    rng = np.random.RandomState(0)
    x = rng.rand(2000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = fit_trees(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_flattened_traversal_is_node_by_node():
    rng = np.random.RandomState(1)
    trees = Trees(0.1, rng.randint(0, 4, (5, 7)), rng.rand(5, 7), rng.rand(5, 8))
    x = rng.rand(50, 4)
    for row, got in zip(x, trees.margin(x), strict=True):
        want = 0.1
        for t in range(5):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
            want += trees.leaf[t, node - 7]
        assert got == pytest.approx(want)


def test_statistics_of_single_documents_agree():
    texts = ["", "One two two.\nOne two two.", "ABC $$$ 12", "é é é"]
    together = document_statistics(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert document_statistics(*text_bytes(pa.array([t])))[0].tolist() == together[i].tolist()
    named = dict(zip(FEATURES, together[1], strict=True))
    assert named["distinct_lines"] == 0.5 and named["repeat_next"] == 0  # "two." is another word than "two"
    assert dict(zip(FEATURES, together[3], strict=True))["repeat_next"] == pytest.approx(2 / 3)
    assert not together[0].any()


def test_fold_is_crc32(spark):
    rows = spark.range(50).select(fold("id", 5).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]

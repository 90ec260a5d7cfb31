"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are trained on a bounded sample of labelled rows and flattened into arrays, one
complete binary tree a row, so that a batch of documents goes down all of them with
numpy gathers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import arrow_schema, small_batches, take_over, text_bytes
from sievework.llm.textstats import FEATURES, document_statistics

#: No more labelled rows than this are fitted, chosen by a hash of their id.
TRAIN_ROWS = 20_000


@dataclass
class Trees:
    prior: float
    feature: np.ndarray  # (trees, inner nodes); children of node k are 2k + 1 and 2k + 2
    threshold: np.ndarray  # (trees, inner nodes); larger values go right
    leaf: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 3.0, l2: float = 1.0) -> Trees:
    """Boosts logistic loss; each level of a tree is split on histograms of gradients by bins of each feature."""
    n, inner = len(y), (1 << depth) - 1
    shape = (0, inner)
    if not n or y.min() == y.max():
        prior = 0.0 if not n else float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        return Trees(prior, np.zeros(shape, np.int64), np.zeros(shape), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, prior)
    made: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            split = np.full(count, bins)
            base = (node - first) * bins
            for f in range(len(cuts)):
                if not len(cuts[f]):
                    continue
                key = base + binned[f]
                gs = np.cumsum(np.bincount(key, g, count * bins).reshape(count, bins), 1)
                hs = np.cumsum(np.bincount(key, h, count * bins).reshape(count, bins), 1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = -1
                gain[:, len(cuts[f]) :] = -1
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for k in np.flatnonzero(top > best).tolist():
                    best[k], split[k], feature[first + k], threshold[first + k] = top[k], at[k], f, cuts[f][at[k]]
            own = node - first
            node = 2 * node + 1 + (binned[feature[node], np.arange(n)] > split[own])
        leaf = rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + l2)
        margin += leaf[node - inner]
        made.append((feature, threshold, leaf))
    return Trees(prior, *(np.stack(c) for c in zip(*made, strict=True)))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the packed FEATURES (doubles) of each document."""
    ddl = "id long, packed binary"
    schema = arrow_schema(ddl)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for big in batches:
            for batch in small_batches(big, "text", 2 << 20):
                x = document_statistics(*text_bytes(batch.column("text")))
                yield pa.record_batch([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(measure, ddl)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, most: int = TRAIN_ROWS, **options) -> Trees:
    """Learns from labelled documents whose fold isn't 0: at most `most` of them, the first by a hash of their id.

    Null labels and ids teach nothing; repeated labels of an id count once, the largest. The bound holds for rows,
    however many texts share an id; equal rows count once. Very long texts are measured whole.
    """
    usable = labels.where(F.col(label_col).isNotNull() & (fold(id_col, folds) != 0))
    chosen = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    sample = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    here = texts.join(F.broadcast(sample), "id").select("id", "text", "label")  # `most` rows bound the broadcast
    measured = with_statistics(here, "id", "text").distinct()
    got = measured.orderBy(F.xxhash64("id"), "id", F.xxhash64("packed")).limit(most).toArrow()
    known = dict(zip(*(c.to_pylist() for c in sample.select("id", "label").toArrow().columns), strict=True))
    rows = sorted(zip(got["id"].to_pylist(), got["packed"].to_pylist(), strict=True))
    x = np.stack([np.frombuffer(p, float) for _, p in rows]) if rows else np.zeros((0, len(FEATURES)))
    return fit_trees(x, np.array([float(known[i] > 0) for i, _ in rows]), **options)


def score_quality(docs: DataFrame, trees: Trees, bar: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 if score >= bar), and the columns named in keep.

    Scores depend on the whole text alone; null counts as empty and is scored like any text. Ids may be null or
    repeat; an empty table gives an empty one. One narrow pass.
    """
    names = list(dict.fromkeys((id_col, *keep)))
    kept = docs.select(*dict.fromkeys((*names, text_col)))
    fields = [f for f in kept.schema.fields if f.name in names]
    out = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    known = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        model = known.value
        for big in batches:
            for batch in small_batches(big, text_col, 2 << 20):
                s = model.score(document_statistics(*text_bytes(batch.column(text_col))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s), pa.array((s >= bar).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(score, out)

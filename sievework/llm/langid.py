"""Language identification by hierarchical discrimination.

A text's family is predicted first, by a linear softmax over hashed byte n-grams. Within
the family one-versus-one linear support vector machines, trained on texts of that family
alone, vote between its closely related languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import _BYTES, arrow_schema, mix, small_batches, take_over, text_bytes
from sievework.llm.quality import fold

#: Families of common ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
#: No more labelled texts than this are fitted, chosen by a hash of their id.
TRAIN_ROWS = 4_000
DIMS = 4096
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), f"only {lang}")


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of DIMS for each text: square roots of counts of hashed byte 2-, 3- and 4-grams with letters, of length 1.

    A-Z count as a-z, and all bytes that are no letter as one gap, so digits and punctuation tell nothing.
    """
    n, size = len(offsets) - 1, len(data)
    out = np.zeros((n, DIMS), np.float32)
    if not size:
        return out
    letter = _IS_LETTER[data]
    value = np.where(letter, _BYTES[data], np.uint64(1))
    hashed, ok = [], []
    gram, some = value, letter
    for k in (2, 3, 4):
        gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + value[k - 1 :] if len(gram) > 1 else gram[:0]
        some = some[:-1] | letter[k - 1 :] if len(some) > 1 else some[:0]
        hashed.append((mix(gram) >> np.uint64(52)).astype(np.int64))
        ok.append(some)
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        row = np.zeros(DIMS)
        for k, (h, s) in enumerate(zip(hashed, ok, strict=True)):
            if b - a > k + 1:
                row += np.bincount(h[a : b - k - 1], s[a : b - k - 1], DIMS)
        row = np.sqrt(row)
        total = np.sqrt((row * row).sum())
        out[d] = row / total if total else 0
    return out


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = True
    t[0x80:] = True
    return t


_IS_LETTER = _letters()
_ASCII_LETTER = _IS_LETTER & (np.arange(256) < 128)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a letter of any script."""
    total = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    out = total[offsets[1:]] > total[offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Hierarchy:
    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS + 1)))  # a row for each family
    machines: list[list[tuple[int, int, np.ndarray]]] = field(default_factory=list)  # per family: i, j, weights for i over j

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        x1 = np.concatenate((x, np.ones((n, 1), np.float32)), 1)
        z = x1 @ self.weights.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best, lang, score = p.argmax(1), [UNKNOWN] * n, p.max(1)
        for f, names in enumerate(self.members):
            rows = np.flatnonzero(best == f)
            votes, belief = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for i, j, w in self.machines[f]:
                m = x1[rows] @ w
                q = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                belief[:, i] += q
                belief[:, j] += 1 - q
            pick = (votes + 1e-3 * belief).argmax(1) if len(names) > 1 else np.zeros(len(rows), np.int64)
            share = belief[np.arange(len(rows)), pick] / (len(names) - 1) if len(names) > 1 else np.ones(len(rows))
            score[rows] *= share
            for r, k in zip(rows.tolist(), pick.tolist(), strict=True):
                lang[r] = names[k]
        return lang, score


def _descend(grad, start: np.ndarray, rate: float, steps: int) -> np.ndarray:
    """Nesterov's accelerated gradient descent."""
    w, v = start, start
    for k in range(steps):
        after = v - np.float32(rate) * grad(v)
        v = after + np.float32(k / (k + 3)) * (after - w)
        w = after
    return w


def fit_softmax(x1: np.ndarray, y: np.ndarray, k: int, l2: float = 1e-5, steps: int = 100) -> np.ndarray:
    truth = np.eye(k, dtype=np.float32)[y]

    def grad(w: np.ndarray) -> np.ndarray:
        z = x1 @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        return ((p / p.sum(1, keepdims=True) - truth).T @ x1) / np.float32(len(y)) + np.float32(l2) * w

    return _descend(grad, np.zeros((k, x1.shape[1]), np.float32), 1.0, steps)


def fit_svm(x1: np.ndarray, side: np.ndarray, l2: float = 1e-4, steps: int = 100) -> np.ndarray:
    """Weights that minimise the squared hinge loss of side (+1 or -1)."""

    def grad(w: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, 1 - side * (x1 @ w))
        return -2 * (x1.T @ (gap * side)) / np.float32(len(side)) + np.float32(l2) * w

    return _descend(grad, np.zeros(x1.shape[1], np.float32), 0.25, steps)


def fit_hierarchy(x: np.ndarray, langs: list[str]) -> Hierarchy:
    if not langs:
        return Hierarchy()
    families = sorted({family_of(c) for c in langs})
    members = [sorted({c for c in langs if family_of(c) == f}) for f in families]
    x1 = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    name = np.array(langs)
    home = np.array([families.index(family_of(c)) for c in langs])
    weights = fit_softmax(x1, home, len(families)) if len(families) > 1 else np.zeros((1, x1.shape[1]), np.float32)
    machines = []
    for names in members:
        machines.append([])
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                rows = np.flatnonzero((name == names[i]) | (name == names[j]))
                machines[-1].append((i, j, fit_svm(x1[rows], np.where(name[rows] == names[i], 1.0, -1.0).astype(np.float32))))
    return Hierarchy(families, members, weights, machines)


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, most: int = TRAIN_ROWS) -> Hierarchy:
    """Learns from texts with a lang whose fold isn't `held`: at most `most` of them, the first by a hash of their id.

    The bound holds for rows, however many share an id; equal rows count once. Null texts and langs teach nothing,
    nor do texts without a letter; very long texts are measured whole.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, folds) != held))
    ids = usable.select(F.col(id_col).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    texts = usable.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chosen = texts.join(F.broadcast(ids), "id")  # `most` ids bound the broadcast
    ddl = "id long, lang string, packed binary"
    schema = arrow_schema(ddl)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for big in batches:
            for batch in small_batches(big, "text", 4 << 20):
                data, at = text_bytes(batch.column("text"))
                x = ngram_features(data, at).astype(np.float16)
                yield pa.record_batch([batch.column("id"), batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema).filter(pa.array(has_letter(data, at)))

    measured = chosen.select("id", "text", "lang").mapInArrow(measure, ddl).distinct()
    got = measured.orderBy(F.xxhash64("id"), "id", F.xxhash64("lang", "packed"), "lang").limit(most).toArrow()
    rows = sorted(set(zip(got["id"].to_pylist(), got["lang"].to_pylist(), got["packed"].to_pylist(), strict=True)))
    x = np.stack([np.frombuffer(p, np.float16) for _, _, p in rows]).astype(np.float32) if rows else np.zeros((0, DIMS), np.float32)
    return fit_hierarchy(x, [c for _, c, _ in rows])


def predict_languages(docs: DataFrame, model: Hierarchy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1; the family's probability times the share of the votes).

    A text's family is the likeliest, of equal ones the first by name; its language the member with most votes, of
    equal ones that with the larger margins, then the first by name. Very long texts are read whole.
    A null text, or one without a letter of any script, is `und` with score 0; with nothing learned, every text is.
    Only the text is looked at. Ids may be null or repeat; an empty table gives an empty one. One narrow pass.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    ddl = f"{id_col} long, lang_pred string, score double"
    schema = arrow_schema(ddl)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for big in batches:
            for batch in small_batches(big, text_col, 2 << 20):
                data, at = text_bytes(batch.column(text_col))
                lang, score = known.value.predict(ngram_features(data, at))
                some = has_letter(data, at)
                yield pa.record_batch([batch.column(id_col).cast(pa.int64()), pa.array([c if s else UNKNOWN for c, s in zip(lang, some.tolist(), strict=True)], pa.string()), pa.array(np.where(some, score, 0.0))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(predict, ddl)

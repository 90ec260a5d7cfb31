"""Compression of vectors into codes: one codebook entry for each of several parts.

A part's nearest entry is found in two steps. A float32 matrix product gives every
entry's distance within a proven rounding error; entries whose interval meets the
best one are worked out again in int64, and of equal ones the lowest index wins. A
round brings one row of sums for each entry to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, binary_rows, stored, take_over
from sievework.llm.vectors import complete, floor_means, floored, matrix

_UNIT = 2.0**-24  # of float32
#: Pairs of a part and an entry that are worked out in int64 at once.
_PAIRS = 1 << 18


def candidates(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Of each row, which entries may be nearest (bool matrix): all others are further, whatever rounding did.

    With m components, f = |c|^2 - 2 v.c in float32 is off by g * (|c|^2 + 2 |v| |c|) at most, where g = n u / (1 - n u):
    m roundings of the product in any order, one of each factor, of |c|^2, of the difference; four more cover the
    bounds' own arithmetic, and a factor of 1 + 2^-18 that of the radius.
    """
    steps = (v.shape[1] + 8) * _UNIT
    g = steps / (1 - steps) * (1 + 2.0**-18)
    squares = (entries * entries).sum(1).astype(np.float64)
    c_len, v_len = np.sqrt(squares), np.sqrt((v * v).sum(1).astype(np.float64))
    f = squares.astype(np.float32) - np.float32(2) * (v.astype(np.float32) @ entries.astype(np.float32).T)
    radius = (g * squares).astype(np.float32) + (2 * g * v_len).astype(np.float32)[:, None] * c_len.astype(np.float32)
    return f - radius <= (f + radius).min(1)[:, None]


def nearest(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of each row's nearest entry by exact squared distance, ties to the lowest."""
    may = candidates(v, entries)
    at = may.argmax(1)
    number = may.sum(1)
    open_rows = np.flatnonzero(number > 1)
    ends = np.cumsum(number[open_rows])
    first = 0
    while first < len(open_rows):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PAIRS, "right")))
        rows = open_rows[first:last]
        i, j = np.nonzero(may[rows])
        d = ((v[rows[i]] - entries[j]) ** 2).sum(1)
        heads = np.flatnonzero(np.diff(i, prepend=-1))
        best = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, heads), number[rows]))
        at[rows] = j[best[np.searchsorted(best, heads)]]  # the first of the best of each row
        first = last
    return at


def _codes(v: np.ndarray, books: np.ndarray) -> np.ndarray:
    m = books.shape[2]
    return np.stack([nearest(v[:, p * m : (p + 1) * m], b) for p, b in enumerate(books)], 1)


def _sums(rows: DataFrame, books: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Sums and numbers of the parts nearest to each entry, in order of part and entry."""
    parts, k, m = books.shape
    ddl = "entry int, n long, s array<bigint>"
    schema = arrow_schema(ddl)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        sums, counts = np.zeros((parts * k, m), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column("q"), parts * m)
            at = (_codes(v, books) + np.arange(parts) * k).ravel()
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.diff(at[order], prepend=-1))
            used = at[order][heads]
            sums[used] += np.add.reduceat(v.reshape(-1, m)[order], heads)
            counts[used] += np.diff(np.append(heads, len(at)))
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), schema.field("s").type)], schema=schema)

    total = rows.select("q").mapInArrow(add, ddl).groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(m)))
    sums, counts = [[0] * m for _ in range(parts * k)], [0] * (parts * k)
    for r in total.collect():  # parts * entries rows at most
        sums[r["entry"]], counts[r["entry"]] = [r[f"s{i}"] for i in range(m)], r["n"]
    return sums, counts


def compress_vectors(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    dim: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every vector whose components are all finite numbers.

    Null vectors and those with null or non-finite components are left out. One of another length than dim has a
    null code and error and takes no part in the codebooks. These start as the parts of the vectors of the smallest
    ids (nulls last, equal ids by vector), as many as there are up to entries; equal entries leave all but the first
    unused, which stay as they are. label_error sums the errors of equal labels, nulls together. Rows that repeat an id are all returned.
    Other columns are ignored; an empty table gives an empty one. entries is 256 at most, dim a multiple of parts.
    Components are kept within 2^27 (for 64 of them) so that errors fit a long.
    """
    if not 1 <= entries <= 256 or dim % parts:
        raise ValueError("entries must be 1 to 256, and dim a multiple of parts")
    q = F.when(F.size(vector_col) == dim, floored(F.col(vector_col), scale, dim)).alias("q")
    kept, _ = stored(vectors.where(complete(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), q), "vector-parts")
    fitted = kept.where("q is not null")
    first = fitted.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        sums, counts = _sums(fitted, books)
        books = floor_means(sums, counts, books.reshape(-1, dim // parts)).reshape(books.shape)
    ddl = "id {}, label {}, code binary, error long".format(kept.schema["id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString())
    schema = arrow_schema(ddl)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for batch in batches:
            there = batch.column("q").is_valid().to_numpy(zero_copy_only=False)
            v = matrix(batch.column("q").drop_null(), dim)
            codes, error = [None] * len(batch), [None] * len(batch)
            if len(v):
                at = _codes(v, books)
                off = v - np.concatenate([b[at[:, p]] for p, b in enumerate(books)], 1)
                codes = binary_rows(at.astype(np.uint8).ravel(), np.concatenate(([0], np.cumsum(there) * parts)))
                error = np.zeros(len(batch), np.int64)
                error[there] = (off * off).sum(1)
                error = pa.array(error, mask=~there)
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(codes, pa.binary()) if isinstance(codes, list) else codes, pa.array(error, pa.int64()) if isinstance(error, list) else error], schema=schema)

    coded, _ = stored(kept.mapInArrow(encode, ddl), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # no hint: labels may be few or many; Spark sends a small table to all and splits what a frequent label skews
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["same"])).select(
        F.col("id").alias(id_col), F.when(F.col("error").isNotNull(), F.lower(F.hex("code"))).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _oracle(rounds: int = 4) -> str:
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "piece AS MATERIALIZED (SELECT r, p, q[p * 16 + 1 : p * 16 + 16] AS q FROM kept, range(4) t(p))",
        "c0 AS MATERIALIZED (SELECT p, r AS c, q FROM piece WHERE r < 256)"]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, p, min({{'d': d, 'c': c}}) AS b FROM (
    SELECT r, p, c, list_sum(list_transform(list_zip(piece.q, c{n}.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM piece JOIN c{n} USING (p))
  GROUP BY r, p)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT p, c, i, (s - ((s % n) + n) % n) // n AS x FROM (
    SELECT p, c, i, sum(x) AS s, count(*) AS n FROM (SELECT p, a.b.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{n} a JOIN piece USING (r, p)) GROUP BY p, c, i)),
c{n + 1} AS MATERIALIZED (
  SELECT c{n}.p, c{n}.c, coalesce(m.q, c{n}.q) AS q FROM c{n} LEFT JOIN (SELECT p, c, list(CAST(x AS BIGINT) ORDER BY i) AS q FROM m{n} GROUP BY p, c) m ON m.p = c{n}.p AND m.c = c{n}.c)""")
    last = f"""coded AS (
  SELECT r, string_agg(printf('%02x', a.b.c), '' ORDER BY p) AS code, CAST(sum(a.b.d) AS BIGINT) AS error FROM a{rounds} a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, c)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""
    return "WITH " + ",\n".join([*steps, last])


ORACLE_SQL = _oracle()

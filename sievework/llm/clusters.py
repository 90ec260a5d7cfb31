"""Centroid clustering of distinct quantised vectors.

Vectors are floored to whole numbers, identical ones become one row with a
multiplicity, and Lloyd's rounds run over these rows alone with whole-number sums
weighted by multiplicity. A round brings k rows of sums to the driver. At the end
the assignments are joined back to the ids of all vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, stored, take_over
from sievework.llm.vectors import complete, floor_means, floored, matrix

_MOST_LONG = 2**63 - 1


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, exactly; of two as near the smaller number."""
    high = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * v.shape[1] * high * high < 2**53:  # every sum is a whole number that a double holds
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        score = (c * c).sum(1) - 2 * (x @ c.T)
        at = score.argmin(1)
        return at.astype(np.int32), (score[np.arange(len(v)), at] + (x * x).sum(1)).astype(np.int64)
    at, least = np.zeros(len(v), np.int32), np.full(len(v), _MOST_LONG)
    for k, c in enumerate(centroids):
        d = ((v - c) ** 2).sum(1)
        nearer = d < least
        at[nearer], least[nearer] = k, d[nearer]
    return at, least


def _weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Of each centroid, the weighted sum and the number of the vectors that are nearest to it."""
    k, dim = centroids.shape
    ddl = "cluster int, n long, s array<bigint>"
    schema = arrow_schema(ddl)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            v, n = matrix(batch.column("q"), dim), batch.column("n").to_numpy()
            at, _ = nearest(v, centroids)
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums[at[order][heads]] += np.add.reduceat((v * n[:, None])[order], heads)
            counts[at[order][heads]] += np.add.reduceat(n[order], heads)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), schema.field("s").type)], schema=schema)

    parts = distinct.select("q", "n").mapInArrow(add, ddl)
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)))
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    for r in total.collect():  # k rows at most
        sums[r["cluster"]], counts[r["cluster"]] = [r[f"s{i}"] for i in range(dim)], r["n"]
    return sums, counts


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    scale: int = 256,
    dim: int = 64,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of dim finite components.

    Other vectors (null, of another length, with null or non-finite components) are left out. Centroids start as
    the vectors with the k smallest sha256 of "seed:id", nulls last and equal ids by vector; with fewer vectors
    there are fewer centroids. Equal vectors share a cluster; of centroids as near, the smaller number wins, so
    that of equal centroids the later ones stay empty and as they are. Rows that repeat an id are all returned. Other columns are
    ignored; a table without vectors gives an empty one. Components are kept within 2^27 (for 64 of them) so that
    distances fit a long, and inertias end at the largest long.
    """
    spark = vectors.sparkSession
    kept = vectors.where((F.size(vector_col) == dim) & complete(F.col(vector_col)))
    rows = kept.select(F.col(id_col).alias(id_col), floored(F.col(vector_col), scale, dim).alias("q"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    centroids = np.array([r["q"] for r in rows.select("q", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "q").limit(k).collect()], np.int64).reshape(-1, dim)
    distinct, _ = stored(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "vector-counts")
    for _ in range(rounds if len(centroids) else 0):
        centroids = floor_means(*_weighted_sums(distinct, centroids), centroids)
    ddl = "q array<int>, n long, cluster int, distance long"
    schema = arrow_schema(ddl)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for batch in batches:
            if len(batch):
                at, distance = nearest(matrix(batch.column("q"), dim), centroids)
                yield pa.record_batch([batch.column("q").cast(schema.field("q").type), batch.column("n"), pa.array(at), pa.array(distance)], schema=schema)

    assigned, _ = stored(distinct.select("q", "n").mapInArrow(assign, ddl), "vector-clusters")
    weighed = F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(weighed).alias("s")).collect()}  # k rows at most
    facts = [(c, min(s, _MOST_LONG), min(sum(inertia.values()), _MOST_LONG), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    by_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # the hash first, so that rows are sorted by a long; a vector of very many ids is a skewed key, which Spark's skew join splits
    keyed = lambda df: df.withColumn("h", F.xxhash64("q"))
    return (
        keyed(rows)
        .join(keyed(assigned.drop("n")).hint("merge"), ["h", "q"])
        .join(F.broadcast(by_cluster), "cluster")
        .select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )


def _oracle(k: int = 40, rounds: int = 5) -> str:
    kept = """kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
    steps = [kept, f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q FROM kept QUALIFY c < {k})"]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'c': c}}) AS b FROM (
    SELECT r, c, list_sum(list_transform(list_zip(kept.q, c{n}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{n})
  GROUP BY r)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a.b.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{n} a JOIN kept USING (r)) GROUP BY c, i)),
c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(m.q, c{n}.q) AS q FROM c{n} LEFT JOIN (SELECT c, list(CAST(x AS BIGINT) ORDER BY i) AS q FROM m{n} GROUP BY c) m ON m.c = c{n}.c)""")
    last = f"""SELECT vec_id, CAST(a.b.c AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = a.b.c"""
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE_SQL = _oracle()

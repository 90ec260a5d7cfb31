"""I-Match fingerprints over randomised subsets of a lexicon.

The lexicon is the terms whose document frequency lies within a band. A document's
distinct terms in it are sorted, and hashed once as they are and once for each random
subset of the lexicon that is left of them. Subsets come in halving shares, so that
short and long documents each have some that keep a handful of terms: two documents
agree there as often as their terms do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, mix, partitions, shingle_sets, small_batches, stored, take_over, text_bytes
from sievework.llm.repair import order_part

#: The lexicon's largest size, 8 MB; see `lexicon`.
MOST_TERMS = 1 << 20
#: Distinct terms that a task counts before it hands them on.
_COUNTED = 1 << 20
SHARES, REPEATS = 11, 8
#: Expected terms of a document in a subset up to which the subset is hashed: larger ones agree for equal documents only, as the whole does.
FEW = 2.0
_SEEDS = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: The share of the lexicon of each hash: the whole, then REPEATS subsets each of a half, a quarter and so on.
RATES = np.array([1.0, *(2.0**-j for j in range(1, SHARES + 1) for _ in range(REPEATS))])
_POWER = np.uint64(0xD6E8FEB86659FD93)


def lexicon(docs: DataFrame, text_col: str = "text", common: float = 2.0, rare: float = 12.0) -> np.ndarray:
    """Sorted hashes of the terms with an inverse document frequency of common to rare bits, and in two documents at least.

    Terms are the words [^\\x20\\x09-\\x0D]+ with A-Z as a-z. Frequencies are counted over all documents. Of p
    pairs of a document and a term of it, terms in p / MOST_TERMS documents or more are MOST_TERMS at most; where
    that is more than the rare end of the band, it is the rare end, so what is brought to the driver has a bound.
    """
    ddl = "kind int, term long, n long"
    schema = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        n_docs = n_pairs = size = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(kind: int, terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(terms), kind, np.int32)), pa.array(terms.view(np.int64)), pa.array(n)], schema=schema)

        for big in batches:
            for batch in small_batches(big, "text"):
                terms, _ = shingle_sets(*text_bytes(batch.column("text")), 1)
                n_docs, n_pairs = n_docs + len(batch), n_pairs + len(terms)
                held.append(np.unique(terms, return_counts=True))
                size += len(held[-1][0])
                if size > 2 * _COUNTED:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _COUNTED:
                        yield rows(1, *held[0])
                        held, size = [], 0
        if held:
            yield rows(1, *merged())
        yield rows(0, np.arange(2, dtype=np.uint64), np.array([n_docs, n_pairs], np.int64))

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, ddl).groupBy("kind", "term").agg(F.sum("n").alias("n"))
    table, _ = stored(counted.where("kind = 0 or n >= 2"), "term-counts")
    total = {r["term"]: r["n"] for r in table.where("kind = 0").collect()}
    n_docs, n_pairs = total.get(0, 0), total.get(1, 0)
    least = max(2.0, n_docs * 2.0**-rare, n_pairs / MOST_TERMS)
    found = table.where((F.col("kind") == 1) & (F.col("n") >= least) & (F.col("n") <= n_docs * 2.0**-common)).select("term")
    return np.sort(found.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


def subset_hashes(terms: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of hashes, in the order of RATES, of each document's sorted terms: 64 bits of the whole, then 32 of each subset that
    keeps FEW terms at most on average, and of the smallest. 0 where a subset leaves none, or isn't hashed."""
    n = len(at) - 1
    size = np.repeat(np.diff(at), np.diff(at))
    out = np.zeros((n, len(RATES)), np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    powers = np.multiply.accumulate(np.full(int(np.diff(at).max(initial=0)) + 1, _POWER, np.uint64))

    def put(column: int, kept: np.ndarray) -> None:
        """Hashes the sequence of kept terms of each document that has any."""
        who = owner[kept]
        heads = np.flatnonzero(np.diff(who, prepend=-1))
        if len(heads):
            rank = np.arange(len(kept)) - np.repeat(heads, np.diff(np.append(heads, len(kept))))
            found = mix(np.add.reduceat(terms[kept] * powers[rank], heads)) | np.uint64(1)
            out[who[heads], column] = found if column == 0 else found & np.uint64(0xFFFFFFFF)

    everything = np.arange(len(terms))
    put(0, everything)
    for r in range(REPEATS):
        draw, kept = mix(terms ^ _SEEDS[r]), everything
        for j in range(1, SHARES + 1):
            kept = kept[draw[kept] < np.uint64(1 << (64 - j))]
            put(1 + (j - 1) * REPEATS + r, kept[size[kept] <= FEW * 2**j] if j < SHARES else kept)
    return out


def fingerprints(texts: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of hashed terms, and rows of hashes. A text without a term of the lexicon has all its terms hashed."""
    terms, at = shingle_sets(*text_bytes(pa.array(texts, pa.large_string())), 1)
    known = words[np.minimum(np.searchsorted(words, terms), len(words) - 1)] == terms if len(words) else np.zeros(len(terms), bool)
    total = np.concatenate(([0], np.cumsum(known)))
    none = total[at[1:]] == total[at[:-1]]
    kept = known | np.repeat(none, np.diff(at))
    total = np.concatenate(([0], np.cumsum(kept)))
    ends = total[at]
    return np.diff(ends), subset_hashes(terms[kept], ends)


def as_text(counts: np.ndarray, hashes: np.ndarray) -> list[str]:
    """The number of terms, then the hashes in hex, empty where there is none."""
    return [",".join([str(n), *(f"{h:x}" if h else "" for h in row)]) for n, row in zip(counts.tolist(), hashes.tolist(), strict=True)]


def likeness(counts: np.ndarray, hashes: np.ndarray, other_counts: np.ndarray, other_hashes: np.ndarray) -> np.ndarray:
    """The share of equal hashes among the subsets that are hashed for the larger document and leave a term of either. 1 where
    the whole agrees, with terms or without; else 0 where no subset tells."""
    most = np.maximum(counts, other_counts)[:, None]
    tells = ((RATES * most <= FEW) | (RATES == RATES[-1])) & ((hashes != 0) | (other_hashes != 0))
    same, number = (tells & (hashes == other_hashes)).sum(1), tells.sum(1)
    return np.where((counts == other_counts) & (hashes[:, 0] == other_hashes[:, 0]), 1.0, same / np.maximum(number, 1))


def fingerprint_with_neighbours(docs: DataFrame, common: float = 2.0, rare: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is a document's whose last quarter of code points (rounded down) is replaced by the first as
    many, or all, of the next document in ascending order of id; after the last comes the first. Null texts count
    as empty; an empty text has no terms, and is like another such only. Null ids come first; rows with equal ids
    follow each other by length and text, or where an id fills several partitions by a hash of the text first.
    Equal texts have equal fingerprints. Other columns are ignored; an empty table gives an empty one. A very long text is worked
    on by its one task.
    """
    spark = docs.sparkSession
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = spark.sparkContext.broadcast(lexicon(small, "text", common, rare))
    n = partitions(spark)
    placed = small.withColumn("part", order_part(small, "id", "text", n)).withColumn("guest", F.lit(False))
    # the least id of each partition also goes, as a guest, to the partition before it: as many rows as partitions
    least = placed.groupBy("part").agg(F.min(F.coalesce("id", F.lit(-(2**63)).cast("long"))).alias("least")).orderBy("part").collect()
    heads = [(r["part"], least[k - 1]["part"], r["least"]) for k, r in enumerate(least)]
    heads = spark.createDataFrame(heads, "part int, before int, least long")
    guests = placed.join(F.broadcast(heads), (placed["part"] == heads["part"]) & (F.coalesce("id", F.lit(-(2**63)).cast("long")) == F.col("least")))
    guests = guests.select("id", "text", F.col("before").alias("part"), F.lit(True).alias("guest"))
    dealt = placed.unionByName(guests).repartitionById(n, "part").drop("part").sortWithinPartitions("guest", "id", F.octet_length("text"), "text")
    ddl = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        before: tuple[list, list] = ([], [])  # the last document, which waits for the next
        over = False
        for big in batches:
            for batch in small_batches(big, "text"):
                if over:
                    continue
                ids, texts, guest = (batch.column(c).to_pylist() for c in ("id", "text", "guest"))
                if any(guest):  # the first guest is the last document's next one
                    end, over = guest.index(True) + 1, True
                    ids, texts = ids[:end], texts[:end]
                ids, texts = before[0] + ids, before[1] + texts
                before = (ids[-1:], texts[-1:])
                if len(ids) > 1:
                    yield rows(ids[:-1], texts)

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        counts, hashes = fingerprints(texts, words.value)
        edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(texts, texts[1:], strict=False)]
        e_counts, e_hashes = fingerprints(edited, words.value)
        own = counts[:-1], hashes[:-1]
        return pa.record_batch(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(as_text(*own)), pa.array(as_text(e_counts, e_hashes)), pa.array(likeness(*own, e_counts, e_hashes)), pa.array(likeness(*own, counts[1:], hashes[1:])),
            ],
            schema=schema,
        )

    return dealt.mapInArrow(work, ddl)

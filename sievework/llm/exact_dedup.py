"""Exact deduplication by Grace hashing.

Each task of the scan collapses its own rows in open-addressing tables, so that a
text copied a billion times leaves one record per table. These records, with complete
content, are a table of their own. Those of hashes that very many tables hold are
collapsed once more, dealt by hash and salt. Then all are dealt by hash. Each receiving
task probes an open-addressing table, which compares complete content, while it reads;
once that is as large as its budget, new content goes to spill files by further bits of
the hash, and each file is treated likewise. Small rows carry the verdicts back to the
documents.

Spill files are scratch of a running task: they lie in the task's own temporary
folder and go with the task; a task that is run again writes its own.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import _IS_SPACE, arrow_schema, partitions, small_batches, stored, take_over, text_bytes

LOCAL = "is_class boolean, id long, part int, class long, row long, n_chars long, n long, hash long, content binary, tag long"
MERGED = "hash long, content binary, n long, n_chars long, id long, part int, row long, tags array<struct<part: int, class: long>>"
VERDICT = "part int, class long, keep_id long, keep_part int, keep_row long, group_size long, sha string"
_FAN_BITS = 4
#: A hash with more than this share of a task's records is hot: there are at most 1 / HOT of them a task.
HOT = 1 / 4


class ContentTable:
    """Open addressing with linear probing. A slot holds an entry's number; equal means equal bytes, not equal hashes."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, key: int, content: bytes) -> int | None:
        """The entry that holds the content, if any."""
        at = key & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == key and self.contents[e] == content:
                return e
            at = (at + 1) & self.mask
        return None

    def add(self, key: int, content: bytes) -> tuple[int, bool]:
        """The entry that holds the content, and whether it is new."""
        at = key & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == key and self.contents[e] == content:
                return e, False
            at = (at + 1) & self.mask
        self.slots[at] = e = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for e, key in enumerate(self.hashes):
            at = key & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e


def better(a: tuple, b: tuple) -> tuple:
    """Of two candidates (n_chars, id, part, row): more code points, then the smaller id (null last), then the earlier row."""
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[3])
    return a if order(a) <= order(b) else b


def grace(records: Iterable[tuple], budget: int, scratch: Path, level: int = 0) -> Iterator[tuple[bytes, list[tuple], int, tuple]]:
    """Classes of equal content among records (hash, content, n, best, tags): content, tags, number of rows, best row.

    The first budget bytes of different contents stay in a table, and what equals them is added there as it comes.
    Records of other contents go to spill files by the next bits of their hash, and each file is treated likewise. In
    front of a file one recent content is remembered for each of a few slots: its copies are written without it.
    Where no bits are left, a bucket holds texts of one hash only and stays in memory.
    """
    table = ContentTable()
    found: list[list] = []
    size, files = 0, None
    recent: list[tuple[bytes, int] | None] = [None] * 256
    kept = 0  # bytes of recent contents
    written = [0] * (1 << _FAN_BITS)
    for key, content, n, best, tags in records:
        e = table.find(key, content) if files is not None else table.add(key, content)[0]
        if e is None:
            k = (key >> (64 - _FAN_BITS * (level + 1))) & 15
            slot = key & 255
            last = recent[slot]
            if last is not None and last[0] == content:
                pickle.dump((key, last[1], n, best, tags), files[k], 5)
                continue
            kept += len(content) - (len(last[0]) if last else 0)
            recent[slot] = (content, written[k])
            if kept > budget:
                recent, kept = [None] * 256, 0
            written[k] += 1
            pickle.dump((key, content, n, best, tags), files[k], 5)
        elif e == len(found):
            found.append([list(tags), n, best])
            size += len(content) + 200
            if size > budget and files is None and level * _FAN_BITS < 64:
                files = [open(scratch / f"{level}-{k}-{id(found):x}", "wb+") for k in range(1 << _FAN_BITS)]  # noqa: SIM115
        else:
            c = found[e]
            c[0] += tags
            c[1] += n
            c[2] = better(c[2], best)
    for content, (tags, n, best) in zip(table.contents, found, strict=True):
        yield content, tags, n, best
    table.clear()
    found.clear()
    recent.clear()
    for f in files or ():
        f.seek(0)
        yield from grace(_read(f), budget, scratch, level + 1)
        f.close()
        Path(f.name).unlink()


def _read(f) -> Iterator[tuple]:
    """Records of a spill file; one written without its content gets that of the record it names."""
    at: list[int] = []
    last = -1, b""
    while True:
        place = f.tell()
        try:
            key, content, n, best, tags = pickle.load(f)
        except EOFError:
            return
        if isinstance(content, int):
            if last[0] != content:
                after = f.tell()
                f.seek(at[content])
                last = content, pickle.load(f)[1]
                f.seek(after)
            content = last[1]
        else:
            at.append(place)
        yield key, content, n, best, tags


def without_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts without the characters [\\x20\\x09-\\x0D], and their offsets."""
    stay = ~_IS_SPACE[data]
    return data[stay], np.concatenate(([0], np.cumsum(stay)))[offsets]


def exact_dedup(docs: DataFrame, budget: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None, hot_from: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_chars, tag.

    Texts are equal when identical after white space [\\x20\\x09-\\x0D] is deleted; null counts as empty, and
    empty texts equal each other. Of equal texts the one with most code points stays, then the smallest id
    (null after all others), then the earliest row: repeated rows keep one. tag_col, a long, comes back as tag, so
    that rows with one id can be told apart. Very long texts are compared whole. hot_from sets how many records of a
    hash make it hot. Other columns are ignored; an empty table gives an empty one.
    """
    local, merged, verdict = arrow_schema(LOCAL), arrow_schema(MERGED), arrow_schema(VERDICT)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        part, table, first, row0, size = TaskContext.get().partitionId(), ContentTable(), 0, 0, 0
        counts: list[int] = []
        best: list[tuple] = []

        def classes() -> Iterator[pa.RecordBatch]:
            n, step = len(counts), 2_000
            for a in range(0, n, step):
                b = min(n, a + step)
                yield pa.record_batch(
                    [
                        pa.array([True] * (b - a)), pa.array([x[1] for x in best[a:b]], pa.int64()), pa.array([part] * (b - a), pa.int32()),
                        pa.array(np.arange(first + a, first + b)), pa.array([x[3] for x in best[a:b]], pa.int64()), pa.array([x[0] for x in best[a:b]], pa.int64()),
                        pa.array(counts[a:b], pa.int64()), pa.array(np.array(table.hashes[a:b], np.uint64).astype(np.int64)), pa.array(table.contents[a:b], pa.binary()), pa.nulls(b - a, pa.int64()),
                    ],
                    schema=local,
                )

        for big in batches:
            for batch in small_batches(big, text_col):
                data, at = text_bytes(batch.column(text_col))
                chars = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at])
                packed, cut = without_space(data, at)
                raw, ids, cls = packed.tobytes(), batch.column(id_col).to_pylist(), []
                for i, (a, b, n) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), chars.tolist(), strict=True)):
                    content = raw[a:b]
                    e, new = table.add(xxhash.xxh3_64_intdigest(content), content)
                    mine = (n, ids[i], part, row0 + i)
                    if new:
                        counts.append(1)
                        best.append(mine)
                        size += len(content)
                    else:
                        counts[e] += 1
                        best[e] = better(best[e], mine)
                    cls.append(first + e)
                n = len(batch)
                yield pa.record_batch(
                    [pa.array([False] * n), batch.column(id_col).cast(pa.int64()), pa.array([part] * n, pa.int32()), pa.array(cls, pa.int64()), pa.array(row0 + np.arange(n)), pa.array(chars, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), batch.column("tag")],
                    schema=local,
                )
                row0 += n
                if size > budget:
                    yield from classes()
                    first, size = first + len(counts), 0
                    counts, best = [], []
                    table.clear()
        yield from classes()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                yield r["hash"] & (2**64 - 1), r["content"], r["n"], (r["n_chars"], r["id"], r["part"], r["row"]), [(t["part"], t["class"]) for t in r["tags"]]

    def collapsed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows_of: Callable, at_once: int) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        out: list[tuple] = []
        size = 0
        with tempfile.TemporaryDirectory(prefix="grace-") as scratch:
            for content, tags, n, best in grace(records(batches), budget, Path(scratch)):
                rows = rows_of(content, tags, n, best)
                out += rows
                size += len(rows) * at_once
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(content: bytes, tags: list, n: int, best: tuple) -> list[tuple]:
            key = int(np.uint64(xxhash.xxh3_64_intdigest(content)).astype(np.int64))
            return [(key, content, n, *best, [{"part": p, "class": c} for p, c in tags])]

        return collapsed(batches, merged, rows_of, 1 << 16)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(content: bytes, tags: list, n: int, best: tuple) -> list[tuple]:
            sha = hashlib.sha256(content).hexdigest()
            return [(part, cls, best[1], best[2], best[3], n, sha) for part, cls in tags]

        return collapsed(batches, verdict, rows_of, 256)

    spark = docs.sparkSession
    parts = partitions(spark)
    small = docs.select(F.col(id_col).cast("long").alias(id_col), text_col, (F.col(tag_col) if tag_col else F.lit(None)).cast("long").alias("tag"))
    table, _ = stored(small.mapInArrow(collapse, LOCAL), "grace-records")
    found = table.where("is_class").select("hash", "content", "n", "n_chars", "id", "part", "row", F.array(F.struct("part", "class")).alias("tags"))
    bar = max(64, int(HOT * found.count() / parts)) if hot_from is None else hot_from
    hot = found.groupBy("hash").agg(F.count(F.lit(1)).alias("tables")).where(F.col("tables") > bar).collect()  # at most parts / HOT rows
    if hot:
        known = F.broadcast(spark.createDataFrame([tuple(r) for r in hot], "hash long, tables long"))  # as many
        salted = found.join(known, "hash").withColumn("salt", F.pmod("part", F.ceil(F.sqrt("tables"))))
        once = salted.repartition(parts, "hash", "salt").select([f.name for f in merged]).mapInArrow(merge, MERGED)
        found = found.join(known, "hash", "left_anti").unionByName(once)
    classes, _ = stored(found.select([f.name for f in merged]).repartition(parts, "hash").mapInArrow(judge, VERDICT), "grace-verdicts")
    return (
        table.where("not is_class").select("id", "part", "class", "row", "n_chars", "tag")
        .join(classes, ["part", "class"])
        .select(
            F.col("id").alias(id_col), "keep_id", "group_size",
            ((F.col("part") == F.col("keep_part")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.col("sha").alias("text_sha256"), "n_chars", "part", "row", "tag",
        )
    )


__all__ = ["ContentTable", "exact_dedup", "grace", "without_space"]

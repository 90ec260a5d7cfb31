"""Shared plumbing of the training-data operators.

Nothing here collects rows: the helpers write tables into the folder that the
cluster shares, view Arrow string columns as numpy bytes, and hash words.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in this process (tests), one of our own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_sievework_dir", None):
        sc._sievework_dir = tempfile.mkdtemp(prefix="sievework-")
        sc.setCheckpointDir(sc._sievework_dir)
    return sc._sievework_dir


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table written by `stored`."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner clears what is left
            _written.pop(path, None)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder; returns it as read back, and its path.

    This cuts the lineage: a lost executor costs the tasks of one stage only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written() -> set[str]:
    """Paths of the tables that `stored` has written and nothing has removed."""
    return set(_written)


_owner: list[str] = []
_held: list[Callable[[], None]] = []


def release_with_owner(release: Callable[[], None]) -> None:
    """Has release called in a Python worker when it turns from one operator to another."""
    _held.append(release)


def take_over(owner: str) -> None:
    """Called as an operator starts in a Python worker, which Spark uses again and again: what another operator has kept there goes."""
    if _owner == [owner]:
        return
    if _owner:
        for release in _held:
            release()
        _powers.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _owner[:] = [owner]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and len + 1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i is the bytes of values[offsets[i]:offsets[i + 1]]."""
    values = np.ascontiguousarray(values)
    at = np.asarray(offsets, np.int64) * values.itemsize
    if at[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])
    return pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def doc_slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of whole documents of about limit bytes; a longer document is a run of its own."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def small_batches(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> list[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    return [batch.slice(a, b - a) for a, b in doc_slices(offsets, limit)]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    narrow = total < 2**31 and -(2**31) < int(shift.min()) and int(shift.max()) + total < 2**31
    kind = np.int32 if narrow else np.int64
    out = np.repeat(shift.astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


# --- words and shingles as 64-bit hashes -----------------------------------

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEP = [np.uint64(int(x) | 1) for x in np.random.RandomState(11).randint(1, 2**62, 16)]
_powers: dict[str, np.ndarray] = {}
#: Bytes whose words are hashed at once; only a longer word takes more.
WINDOW = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * _R)
    table[65:91] = table[97:123]  # A-Z count as a-z
    return table


_BYTES = _byte_values()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(2 * WINDOW, 1 << (n - 1).bit_length())
        for key, base in (("up", _R), ("down", _R_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs outside [\\x20\\x09-\\x0D] that don't cross documents, and offsets of each document's words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    cut = inner[inner > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words, A-Z folded to a-z, mixed with their lengths; in windows of about WINDOW bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + WINDOW, "right")))
        high = int(ends[j - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP[8])
        i = j
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets.

    A document with fewer words than size has its whole word sequence as its one
    shingle; one without words has none.
    """
    starts, ends, at = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(at)
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(n_out)))
    out = np.empty(out_at[-1], np.uint64)
    full = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= size:
        m = len(hashes) - size + 1
        for k in range(size):
            full[:m] += hashes[k : k + m] * _STEP[k]
    long = counts >= size
    out[ragged(out_at[:-1][long], n_out[long])] = full[ragged(at[:-1][long], n_out[long])]
    for d in np.flatnonzero(~long & (counts > 0)):
        part = hashes[at[d] : at[d + 1]]
        out[out_at[d]] = np.add.reduce(np.append(part * np.array(_STEP[: len(part)], np.uint64), np.uint64(len(part) * int(_STEP[9]) % 2**64)))
    out = mix(out)
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    if not len(out):
        return out, out_at
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[out_at[:-1][n_out > 0]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], total[out_at]

"""Exact Jaccard self-join on word n-grams by a grouped prefix join.

Sets of shingles that reach the threshold share a shingle in their prefixes, whatever
the one order is in which all sets are sorted; here shingles known to be frequent come
last, by their counts, and all others by hash. Documents with one set are one node.
Nodes with identical prefixes and sizes are one group, and only groups go into the
inverted lists; a list that is known to be long is dealt out in pairs of blocks. Lists, or
pairs of one place, with the same least group are one bundle. A bundle's groups are
expanded to nodes, and a bundle with many is dealt out in pairs of blocks of nodes, so
that no task gets more than two blocks of one. Nodes without a partner whose size and
sketch allow a link leave, and the others are verified on complete sets. A part of a
bundle reports links that join its nodes' components, never all its pairs, and no link
between different components is lost.

Numbers of shingles travel as packed arrays: a row for each range of hashes that a
batch of documents has, never a row for each shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, binary_rows, mix, partitions, ragged, shingle_sets, small_batches, stored, take_over, text_bytes
from sievework.llm.components import connected_components

#: Shingles in at least this many documents may count as frequent.
HOT_FROM = 32
#: No more than this many are kept for ordering (16 bytes each); beyond that the bar is doubled. Shingles under the
#: bar have lists shorter than the bar, and bundles are dealt by their nodes whether or not a list is known to be long.
HOT_MOST = 1 << 20
#: An inverted list that may be longer than this is dealt out in pairs of blocks.
BLOCK = 8192
#: Least and most nodes in a block of a bundle: a sixteenth of the bundle between these.
NODE_BLOCK = (512, 8192)
#: Tasks over which the entries of one bundle are spread while they meet its number of blocks.
SALTS = 16
#: Elements of the sets of a block, 8 bytes each; only one larger set takes more.
BLOCK_ELEMENTS = 1 << 22
#: 64-bit words of the filter that tells which nodes' sets are wanted.
FILTER_WORDS = 1 << 20

#: Bytes of text that are hashed at once.
SLICE = 2 << 20

_ENTRY = np.dtype([("fp", "<u4"), ("pair", "<u4"), ("group", "<u8")])  # pair: 0, or the pair of blocks of a long list
_U = np.uint64


def _bits(spark: SparkSession) -> int:
    return max(4, (4 * partitions(spark) - 1).bit_length())


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]


def set_keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit keys of sets, two words a row."""
    n = np.diff(at).astype(np.uint64)
    one = mix(_sums(mix(sets ^ _U(0x5BD1E995A5A5A5A5)), at) + n)
    two = mix(_sums(mix(sets + _U(0x27D4EB2F165667C5)), at) ^ n)
    return np.stack((one, two), 1)


def _key_column(keys: np.ndarray, empty: np.ndarray) -> pa.Array:
    rows = binary_rows(np.ascontiguousarray(keys).view(np.uint8).reshape(-1), np.arange(len(keys) + 1) * 16)
    return pc.if_else(pa.array(empty), pa.scalar(None, pa.binary()), rows)


# --- counts of frequent shingles ---------------------------------------------


def frequent_shingles(texts: DataFrame, size: int, least: int = HOT_FROM, most: int = HOT_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Sorted leading bits (32 and some) of the hashes of shingles in at least `least` documents, and how many documents have them.

    All documents count. At most `most` shingles come back: the bar doubles until they fit.
    """
    spark = texts.sparkSession
    bits = _bits(spark)
    blobs = arrow_schema("bucket int, fps binary, more binary")
    found = arrow_schema("shingle long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            held.clear()
            keys = every >> _U(32 - bits)
            heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(np.concatenate((heads, [len(keys)])))
            keys = keys[heads]
            at = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << _U(32))
            rows = np.flatnonzero(np.diff(at))
            fps, more = [], []
            for b in rows.tolist():
                fp = (keys[at[b] : at[b + 1]] & _U(0xFFFFFFFF)).astype("<u4")
                steps = np.diff(fp, prepend=np.uint32(0))  # small numbers, by planes of bytes: they compress
                fps.append(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())
                c = counts[at[b] : at[b + 1]]
                often = np.flatnonzero(c > 1)
                more.append(np.stack((often, c[often]), 1).astype("<u4").tobytes())
            return pa.record_batch([pa.array(rows.astype(np.int32)), pa.array(fps, pa.binary()), pa.array(more, pa.binary())], schema=blobs)

        n = 0
        for big in batches:
            for batch in small_batches(big, "text", SLICE):
                sets, _ = shingle_sets(*text_bytes(batch.column("text")), size)
                held.append(sets)
                n += len(sets)
                if n > 4 << 20:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, fps, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                steps = np.ascontiguousarray(np.frombuffer(fps, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
                fp = np.cumsum(steps, dtype=np.uint32).astype(np.uint64)
                c = np.ones(len(fp), np.uint64)
                pairs = np.frombuffer(more, "<u4").reshape(-1, 2)
                c[pairs[:, 0]] = pairs[:, 1]
                held.setdefault(b, []).append((fp << _U(32)) | c)
        for b, parts in held.items():
            both = np.sort(np.concatenate(parts))
            fp = both >> _U(32)
            heads = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
            total = np.add.reduceat(both & _U(0xFFFFFFFF), heads)
            often = np.flatnonzero(total >= least)
            yield pa.record_batch([pa.array((fp[heads[often]] | (_U(b) << _U(32))).astype(np.int64)), pa.array(total[often].astype(np.int64))], schema=found)

    counted = texts.mapInArrow(count, "bucket int, fps binary, more binary").repartition(partitions(spark), "bucket").mapInArrow(add, "shingle long, n long")
    table, _ = stored(counted, "frequent-shingles")
    by_level = {r["level"]: r["shingles"] for r in table.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("shingles")).collect()}  # at most 64 rows
    bar = least
    while sum(v for k, v in by_level.items() if 2 ** (k + 1) > bar) > most:
        bar *= 2
    top = table.where(F.col("n") >= bar).toArrow()  # `most` rows, or a level more
    keys, counts = top["shingle"].to_numpy().astype(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


class Order:
    """The one order of all shingles: those not known as frequent by hash, then the others by count and hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        self.keys, self.counts, self.bits = keys, counts, bits
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys << _U(32 - bits)) >> _U(42)] = True

    def frequency(self, sets: np.ndarray) -> np.ndarray:
        """Counts of the frequent ones, 0 of the others."""
        out = np.zeros(len(sets), np.int64)
        if not len(self.keys):
            return out
        some = np.flatnonzero(self.maybe[sets >> _U(42)])
        keys = sets[some] >> _U(32 - self.bits)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        out[some[hit]] = self.counts[at[hit]]
        return out

    def prefixes(self, sets: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix shingles of each set, their offsets, and their counts."""
        n = np.diff(at)
        size = np.where(n > 0, n - -(-num * n // den) + 1, 0)
        often = self.frequency(sets)
        ends = np.concatenate(([0], np.cumsum(size)))
        pick = np.repeat(at[:-1] - ends[:-1], size) + np.arange(ends[-1])  # sets are sorted by hash already
        for d in np.flatnonzero(_sums((often > 0).astype(np.uint64), at)).tolist():
            first = np.argsort(often[at[d] : at[d + 1]], kind="stable")[: size[d]]
            pick[ends[d] : ends[d + 1]] = at[d] + first
        return sets[pick], ends, often[pick]


# --- bounds on overlaps ------------------------------------------------------


def sketches(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set, how many elements fall into each of 2^k buckets by their low bits, about two to four a bucket.

    The sum of the lesser counts bounds the overlap of two sets from above. A set with a count that a byte can't
    hold has an empty sketch, which bounds nothing.
    """
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        size = max(16, 1 << max(0, (b - a).bit_length() - 2))
        c = np.bincount((sets[a:b] & _U(size - 1)).astype(np.int64), minlength=size)
        out.append(c.astype(np.uint8).tobytes() if c.max() < 256 else b"")
    return out


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch, or rows of them, with `size` buckets."""
    return sketch.reshape(*sketch.shape[:-1], -1, size).sum(-2, dtype=np.uint16)


# --- inverted lists of groups ------------------------------------------------

NODES = "is_list boolean, bucket long, id long, n int, node binary, grp long, packed binary"
LISTS = "is_entry boolean, id long, n int, node binary, grp long, bundle long, packed binary"


def inverted_lists(texts: DataFrame, size: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Documents (id, n, node, grp, its sketch) and, where is_entry, groups of bundles (grp, bundle)."""
    spark = texts.sparkSession
    bits = _bits(spark)
    keys, counts = frequent_shingles(texts, size)
    known = spark.sparkContext.broadcast((keys, counts))
    nodes_schema, lists_schema = arrow_schema(NODES), arrow_schema(LISTS)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        order, part, row = Order(*known.value, bits), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            tokens, group, often = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            fp, pair = tokens, np.zeros(len(tokens), np.uint32)
            if (long := often > block).any():  # lists that may be long: each pair of blocks is a list of its own
                more, salted, pairs = [np.flatnonzero(~long)], [tokens[~long]], [pair[~long]]
                for t in np.unique(tokens[long]):
                    mine = np.flatnonzero(tokens == t)
                    blocks = 1 << (-(-int(often[mine[0]]) // block) - 1).bit_length()  # lists of like length have the same pairs
                    own = (mix(group[mine]) % _U(blocks)).astype(np.int64)
                    for other in range(blocks):
                        lo, hi = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
                        name = mix(mix(mix(np.full(len(mine), blocks, np.uint64)) + lo) + hi)
                        more.append(mine)
                        salted.append(mix(t + name))
                        pairs.append((name >> _U(32)).astype(np.uint32) | np.uint32(1))
                fp, pair, group = np.concatenate(salted), np.concatenate(pairs), group[np.concatenate(more)]
            by = np.argsort(fp, kind="stable")
            fp, pair, group = fp[by], pair[by], group[by]
            entries = np.empty(len(fp), _ENTRY)
            entries["fp"], entries["pair"], entries["group"] = (fp >> _U(32 - bits)).astype(np.uint32), pair, group
            at = np.searchsorted(fp >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = np.flatnonzero(np.diff(at))
            k = len(rows)
            none = lambda kind: pa.nulls(k, kind)
            return pa.record_batch([pa.array([True] * k), pa.array(rows.astype(np.int64)), none(pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.int64()), pa.array([entries[at[b] : at[b + 1]].tobytes() for b in rows.tolist()], pa.binary())], schema=nodes_schema)

        waiting = 0
        for big in batches:
            for batch in small_batches(big, "text", SLICE):
                sets, at = shingle_sets(*text_bytes(batch.column("text")), size)
                n = np.diff(at)
                tokens, ends, often = order.prefixes(sets, at, num, den)
                group = mix(_sums(mix(tokens ^ _U(0x1F83D9ABFB41BD6B)), ends) + n.astype(np.uint64))
                yield pa.record_batch(
                    [
                        pa.array([False] * len(n)), pa.array((mix(np.arange(row, row + len(n), dtype=np.uint64) + (_U(part) << _U(32))) >> _U(1)).astype(np.int64)),
                        batch.column("id"), pa.array(n.astype(np.int32)), _key_column(set_keys(sets, at), n == 0), pa.array(group.astype(np.int64)), pa.array(sketches(sets, at), pa.binary()),
                    ],
                    schema=nodes_schema,
                )
                row += len(n)
                first = np.zeros(len(n), bool)
                first[np.unique(group, return_index=True)[1]] = True
                once = np.repeat(first, np.diff(ends))
                held.append((tokens[once], np.repeat(group, np.diff(ends))[once], often[once]))
                waiting += int(once.sum())
                if waiting > 1 << 20:
                    yield flush()
                    waiting = 0
        if waiting:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        buckets: dict[int, list[bytes]] = {}
        for batch in batches:
            one = batch.column("is_list").to_numpy(zero_copy_only=False)
            docs = batch.filter(pa.array(~one))
            k = len(docs)
            yield pa.record_batch([pa.array([False] * k), docs.column("id"), docs.column("n"), docs.column("node"), docs.column("grp"), pa.nulls(k, pa.int64()), docs.column("packed")], schema=lists_schema)
            lists = batch.filter(pa.array(one))
            for b, e in zip(lists.column("bucket").to_pylist(), lists.column("packed").to_pylist(), strict=True):
                buckets.setdefault(b, []).append(e)
        found: list[np.ndarray] = []
        while buckets:
            found.append(bundles_of(np.frombuffer(b"".join(buckets.popitem()[1]), _ENTRY)))
        if found:
            both = _distinct(np.concatenate(found))
            for a in range(0, len(both), 100_000):
                some = both[a : a + 100_000].astype(np.int64)
                k = len(some)
                yield pa.record_batch([pa.array([True] * k), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(some[:, 1]), pa.array(some[:, 0]), pa.nulls(k, pa.binary())], schema=lists_schema)

    dealt = texts.mapInArrow(enter, NODES).repartition(partitions(spark), "bucket")
    return stored(dealt.mapInArrow(meet, LISTS), "inverted-lists")[0]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    return np.unique(np.ascontiguousarray(pairs).view([("a", "<u8"), ("b", "<u8")])).view(np.uint64).reshape(-1, 2)


def bundles_of(entries: np.ndarray) -> np.ndarray:
    """Of one bucket: rows of a bundle and a group of a list of two or more. A bundle is named by the least group of the
    list, and for a pair of blocks by that pair too."""
    by = np.lexsort((entries["group"], entries["pair"], entries["fp"]))
    e = entries[by]
    other = np.ones(len(e), bool)
    other[1:] = (e["fp"][1:] != e["fp"][:-1]) | (e["pair"][1:] != e["pair"][:-1])
    fresh = other.copy()
    fresh[1:] |= e["group"][1:] != e["group"][:-1]
    heads = np.flatnonzero(other[fresh])
    pair, group = e["pair"][fresh], e["group"][fresh]
    size = np.diff(np.concatenate((heads, [len(group)])))
    heads, size = heads[size > 1], size[size > 1]
    if not len(heads):
        return np.zeros((0, 2), np.uint64)
    name = np.where(pair[heads] > 0, mix(group[heads] + pair[heads].astype(np.uint64) * _U(0x9E3779B97F4A7C15)), group[heads])
    return _distinct(np.stack((np.repeat(name, size), group[ragged(heads, size)]), 1))


# --- parts of bundles --------------------------------------------------------


def parts_of_bundles(entries: DataFrame, nodes: DataFrame, node_block: tuple[int, int] = NODE_BLOCK) -> DataFrame:
    """bundle, part and the nodes in it (node, n, sketch) of entries (grp, bundle) and nodes (grp, node, n, sketch).

    A bundle of many nodes, or of large sets, is dealt out in blocks, and each pair of blocks is a part: nodes of one
    bundle meet in some part. Of the large bundles there are at most rows / node_block[0].
    """
    least, most = node_block
    weights = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("elements"))
    size = entries.join(weights, "grp").groupBy("bundle").agg(F.sum("k").alias("k"), F.sum("elements").alias("elements"))
    rows = F.least(F.greatest(F.ceil(F.col("k") / 16), F.lit(least)), F.lit(most))
    blocks = F.greatest(F.ceil(F.col("k") / rows), F.ceil(F.col("elements") / F.lit(BLOCK_ELEMENTS))).cast("long")
    large = size.where((F.col("k") > 2 * least) | (F.col("elements") > 2 * BLOCK_ELEMENTS)).select("bundle", F.greatest(blocks, F.lit(2)).alias("blocks"))
    # entries of one bundle meet its number of blocks in several tasks; nodes last: joined by bundle, they would stay together by bundle, parts and all
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    counted = entries.withColumn("salt", F.pmod(F.xxhash64("grp"), F.lit(SALTS))).join(salted, ["bundle", "salt"], "left").drop("salt")
    expanded = counted.join(nodes.select("grp", "node", "n", "sketch"), "grp")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<bigint>"), lambda o: o != own))
    dealt = expanded.withColumn("own", own).select("bundle", "node", "n", "sketch", "own", F.explode(others).alias("other"))
    part = F.when(F.col("other").isNotNull(), F.struct(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    return dealt.select("bundle", part.alias("part"), "node", "n", "sketch")


PART = "struct<lo: bigint, hi: bigint>"

# --- verification ------------------------------------------------------------


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A filter of FILTER_WORDS words with a bit set for each node; of bounded size, however many nodes."""
    h = F.xxhash64("node")
    word = F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS))
    bit = F.expr("shiftleft(1L, cast(xxhash64(node) & 63 as int))")
    rows = nodes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def complete_sets(nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """node and its elements (sorted uint64), of all given nodes and perhaps a few others."""
    wanted = texts.sparkSession.sparkContext.broadcast(_wanted(nodes))
    schema = arrow_schema("node binary, elements binary")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        filter_, given = wanted.value, set()
        for big in batches:
            for batch in small_batches(big, "text", SLICE):
                sets, at = shingle_sets(*text_bytes(batch.column("text")), size)
                keys = set_keys(sets, at)
                h = spark_xxhash64_of_16(keys)
                hit = (filter_[((h >> _U(6)) % _U(FILTER_WORDS)).astype(np.int64)].astype(np.uint64) >> (h & _U(63))) & _U(1)
                rows = []
                for i in np.flatnonzero((hit == 1) & (np.diff(at) > 0)).tolist():
                    name = keys[i].tobytes()
                    if name not in given:
                        if len(given) < 200_000:
                            given.add(name)
                        rows.append((name, sets[at[i] : at[i + 1]].tobytes()))
                if rows:
                    yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], schema=schema)

    return texts.mapInArrow(sets_of, "node binary, elements binary").dropDuplicates(["node"])


def _promising(num: int, den: int):
    span = 2  # sizes of a link differ by den / num at most, so widths by the next power of two
    while span * num < den:
        span *= 2

    def nodes(table: pa.Table) -> pa.Table:
        """Of one bundle: the nodes with a partner whose size and sketch allow a link."""
        take_over(__name__)
        n = table["n"].to_numpy().astype(np.int64)
        by = np.argsort(n, kind="stable")
        n = n[by]
        marks = [table["sketch"][i].as_py() for i in by.tolist()]
        to = np.searchsorted(n, n * den // num, "right")
        width = np.array([len(m) for m in marks])
        stay = np.zeros(len(n), bool)
        for w in np.unique(width).tolist():  # the smaller of a pair sets the width, and the larger one's is up to `span` times that
            first = np.flatnonzero(width == w)
            near = np.flatnonzero((width >= w) & (width <= span * w)) if w else np.arange(len(n))
            rows = np.stack([folded(np.frombuffer(marks[j], np.uint8), w) for j in near.tolist()]) if w else None
            for i, k in zip(first.tolist(), np.searchsorted(near, first).tolist(), strict=True):
                last = int(np.searchsorted(near, to[i]))
                if rows is None:  # an empty sketch bounds nothing
                    stay[i] |= to[i] > i + 1
                    stay[i + 1 : to[i]] = True
                    stay[np.flatnonzero((to > i) & (np.arange(len(n)) < i))] = True
                elif last > k + 1:
                    common = np.minimum(rows[k], rows[k + 1 : last]).sum(1, dtype=np.int64)
                    hit = near[k + 1 : last][(num + den) * common >= num * (n[i] + n[near[k + 1 : last]])]
                    if len(hit):
                        stay[i] = True
                        stay[hit] = True
        if (width == 0).any():
            stay[width == 0] = True
        return table.select(["bundle", "part", "node"]).take(pa.array(by[stay]))

    return nodes


def _linked(num: int, den: int):
    def links(table: pa.Table) -> pa.Table:
        """Of one bundle: verified links, each of which joins two of its components."""
        take_over(__name__)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"]]
        n = np.array([len(x) for x in sets], np.int64)
        by = np.argsort(n, kind="stable")
        n = n[by]
        at = np.concatenate(([0], np.cumsum(n)))
        values, codes = np.unique(np.concatenate([sets[i] for i in by.tolist()]), return_inverse=True)
        to = np.searchsorted(n, n * den // num, "right")
        root = np.arange(len(n))
        has = np.zeros(len(values), bool)
        a, b = [], []
        for i in range(len(n)):
            last = int(to[i])
            if last <= i + 1 or (root[i + 1 : last] == root[i]).all():
                continue
            mine = codes[at[i] : at[i + 1]]
            has[mine] = True
            common = np.add.reduceat(has[codes[at[i + 1] : at[last]]], at[i + 1 : last] - at[i + 1], dtype=np.int64)
            has[mine] = False
            for j in (i + 1 + np.flatnonzero(den * common >= num * (n[i] + n[i + 1 : last] - common))).tolist():
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    a.append(i)
                    b.append(j)
        node = table["node"]
        return pa.table([node.take(pa.array(by[x].astype(np.int64))) if len(x) else pa.array([], pa.binary()) for x in (np.array(a, np.int64), np.array(b, np.int64))], names=["a", "b"])

    return links


def spark_xxhash64_of_16(keys: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for 16-byte values (seed 42), of rows of two little-endian words."""
    p1, p2, p3, p4, p5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << _U(k)) | (x >> _U(64 - k))
    h = np.full(len(keys), _U(42) + p5 + _U(16), np.uint64)
    for i in (0, 1):
        h = turn(h ^ (turn(keys[:, i] * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return h ^ (h >> _U(32))


# --- the join ----------------------------------------------------------------


def ngram_jaccard_join(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, node_block: tuple[int, int] = NODE_BLOCK
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct shingles of `size` words, or with
    fewer words the whole sequence as one; documents without words, null texts included, link with nothing and are
    their own component. Sets link when den * common >= num * union. Ids may repeat or be null: a component's id is
    its smallest, null only if it has no other. Extra columns are ignored; an empty table gives an empty one.
    Very long texts are compared whole, by one set each. Shingles are compared by 64-bit hashes, whole sets are
    known by 128-bit keys. block and node_block bound lists and bundles before they are dealt out; results don't
    depend on them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = inverted_lists(texts.select("id", "text"), size, num, den, block)
    rows = table.where("not is_entry").select("id", "n", "node", "grp")
    named = table.where("not is_entry and node is not null")
    nodes, _ = stored(named.groupBy("node").agg(F.min("grp").alias("grp"), F.min("n").alias("n"), F.min("id").alias("least_id"), F.min("packed").alias("sketch")), "nodes")
    several = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("grp", F.col("grp").alias("bundle"))
    entries = table.where("is_entry").select("grp", "bundle").union(several).distinct()
    parts = parts_of_bundles(stored(entries, "bundles")[0], nodes, node_block)
    promising, _ = stored(parts.groupBy("bundle", "part").applyInArrow(_promising(num, den), f"bundle long, part {PART}, node binary"), "promising")
    sets = complete_sets(promising.select("node"), texts, size)
    links, _ = stored(promising.join(sets, "node").groupBy("bundle", "part").applyInArrow(_linked(num, den), "a binary, b binary"), "links")
    least = nodes.join(connected_components(links), "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node, _ = stored(least.select("node", "root").join(of_root, "root").select("node", "component_id"), "components")
    return rows.join(by_node, "node", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))

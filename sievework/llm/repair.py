"""Token-id files compressed by Re-Pair grammars.

A shard is one row of a Parquet table: the grammar (rules as pairs of symbols, and
the length that each expands to), the compressed symbol sequence, and for each
document its id, its ids' count and its symbols' count, so that any document can be
decoded alone. Symbols below base_ids are token ids; base_ids + k is rule k. Pairs
never cross documents. Shards follow each other in ascending doc_id order: files,
then rows, in order of (part, shard).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, binary_rows, doc_slices, partitions, ragged, small_batches, stored, take_over
from sievework.llm.tokenize import encoder, with_end

SHARDS = (
    "part int, shard int, first long, n_ids long, base_ids int, doc_ids array<bigint>, doc_sizes binary, doc_symbols binary,"
    " rules binary, rule_sizes binary, symbols binary"
)
#: Bytes of text; the more, the fewer chunks are looked up again.
ENCODED_AT_ONCE = 24 << 20
#: Chunks that a worker keeps, about 170 bytes each.
KEPT_CHUNKS = 1_000_000
_SLOTS = 18
_NO_PAIR = np.uint32(0xFFFFFFFF)


@dataclass
class Grammar:
    base: int
    rules: np.ndarray  # (k, 2) symbols
    sizes: np.ndarray  # ids that each rule expands to

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all expansions, and of each symbol its first place and its length there."""
        sizes = np.concatenate((np.ones(self.base, np.int64), self.sizes.astype(np.int64)))
        first = np.cumsum(sizes) - sizes
        pool = np.empty(int(sizes.sum()), np.uint16)
        pool[: self.base] = np.arange(self.base)
        newest = self.rules.max(1).astype(np.int64) - self.base if len(self.rules) else np.zeros(0, np.int64)
        done = 0
        while done < len(self.rules):  # a run of rules of symbols that are expanded already
            later = np.flatnonzero(newest[done:] >= done)
            end = done + (int(later[0]) if len(later) else len(newest) - done)
            left, right = self.rules[done:end, 0].astype(np.int64), self.rules[done:end, 1].astype(np.int64)
            at = first[self.base + done : self.base + end]
            pool[ragged(at, sizes[left])] = pool[ragged(first[left], sizes[left])]
            pool[ragged(at + sizes[left], sizes[right])] = pool[ragged(first[right], sizes[right])]
            done = end
        return pool, first, sizes


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int, per_round: int, least: int) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: each counts all pairs of neighbours, gives up to per_round of the most frequent a new
    symbol, and replaces their occurrences from left to right. ends: places after each document's last id. A rule
    expands to at most 2^rounds ids. Of two pairs that share a slot of the table of chosen pairs the more frequent is
    replaced in this round, the other in a later one. Symbols take 16 bits: a larger base raises ValueError.

    Returns the grammar, the symbols, and how many symbols each document has.
    """
    most = 65535 - base  # symbols stay in 16 bits, and the last is none
    if most < 0 or (len(ids) and int(ids.max()) >= base):
        raise ValueError(f"ids from {base} on don't fit into 16-bit symbols")
    seq, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    for _ in range(rounds):
        room = min(per_round, most - n_rules)
        if room <= 0 or len(seq) < 2:
            break
        keys = (seq[:-1] << np.uint32(16)) | seq[1:]
        keys[last[:-1]] = _NO_PAIR
        found = np.sort(keys)
        found = found[: np.searchsorted(found, _NO_PAIR)]
        if not len(found):
            break
        heads = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        counts = np.diff(np.concatenate((heads, [len(found)])))
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        good = good[np.argsort(-counts[good], kind="stable")][:room]
        chosen = found[heads[good]]
        slot_of = lambda k: (k * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)
        table = np.full(1 << _SLOTS, -1, np.int32)
        table[slot_of(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]  # of two in a slot the more frequent stays
        rule = table[slot_of(keys)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[chosen[rule[hit]] == keys[hit]]
        new_run = np.concatenate(([True], np.diff(hit) != 1)) if len(hit) else np.zeros(0, bool)
        order = np.arange(len(hit))
        run_start = np.maximum.accumulate(np.where(new_run, order, 0)) if len(hit) else order
        hit = hit[((order - run_start) & 1) == 0]  # the left one of two that overlap
        used = np.bincount(rule[hit], minlength=len(chosen))
        kept = np.flatnonzero(used >= least)
        if not len(kept):
            break
        number = np.full(len(chosen), -1, np.int64)
        number[kept] = base + n_rules + np.arange(len(kept))
        hit = hit[number[rule[hit]] >= 0]
        seq[hit] = number[rule[hit]]
        last[hit] = last[hit + 1]
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq, last = seq[stay], last[stay]
        pairs = chosen[kept]
        rules.append(np.stack((pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)), 1))
        n_rules += len(kept)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    sizes = np.ones(base + len(table), np.int64)
    done = base
    for block in rules:  # a round's rules use symbols of earlier rounds only
        sizes[done : done + len(block)] = sizes[block[:, 0]] + sizes[block[:, 1]]
        done += len(block)
    at = np.flatnonzero(last) + 1
    filled = np.diff(np.concatenate(([0], ends))) > 0
    symbols = np.zeros(len(ends), np.int64)
    symbols[filled] = np.diff(np.concatenate(([0], at)))
    return Grammar(base, table, sizes[base:].astype(np.uint32)), seq.astype(np.uint16), symbols


def expand(grammar: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols."""
    pool, first, size = grammar.tables()
    s = symbols.astype(np.int64)
    return pool[ragged(first[s], size[s])].astype(np.uint32)


def write_token_shards(
    docs: DataFrame,
    vocabulary: str | None = None,
    cut: str = "space",
    end_id: int = 2,
    shard_ids: int = 1 << 21,
    rounds: int = 8,
    per_round: int = 1900,
    least: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, str]:
    """Encodes docs, in ascending order of id, into shards of about shard_ids ids; returns the table and its path.

    Null and empty texts are the end id alone. Null ids come first; rows with equal ids are all kept, one after the
    other: by length and text, or where an id fills several partitions by a hash of the text first. Other columns are
    ignored; an empty table gives an empty one. A shard holds whole documents, so a very long one is a shard of its
    own. A vocabulary of 65,536 ids or more raises ValueError: symbols have 16 bits.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    schema = arrow_schema(SHARDS)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        encode, part = encoder(path, cut, KEPT_CHUNKS), TaskContext.get().partitionId()
        base = encode.lib.get_vocab_size()
        if max(base - 1, end_id) > 65534:
            raise ValueError("a vocabulary of 65,536 ids or more doesn't fit into 16-bit symbols")
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        shard = first = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, first, held
            names = [x for h in held for x in h[0]]
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            grammar, symbols, counts = compress(ids, np.cumsum(sizes), base, rounds, per_round, least)
            row = [part, shard, first, len(ids), base, names, sizes.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), grammar.rules.astype("<u2").tobytes(), grammar.sizes.astype("<u4").tobytes(), symbols.astype("<u2").tobytes()]
            shard, first, held = shard + 1, first + len(ids), []
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        n = 0
        for big in batches:
            for batch in small_batches(big, text_col, ENCODED_AT_ONCE):
                ids, at = with_end(*encode(batch.column(text_col)), end_id)
                names, sizes = batch.column(id_col).to_pylist(), np.diff(at)
                for a, b in doc_slices(at, shard_ids):
                    held.append((names[a:b], ids[at[a] : at[b]], sizes[a:b]))
                    n += int(at[b] - at[a])
                    if n >= shard_ids:
                        yield flush()
                        n = 0
        if held:
            yield flush()

    small = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    dealt = in_order(small, id_col, text_col, partitions(docs.sparkSession))
    return stored(dealt.mapInArrow(shards, SHARDS), "token-shards")


def in_order(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """docs in n partitions of ascending ids (null first) with about as many rows each, and sorted inside.

    The bounds come from a scan of the ids alone. An id with more rows than a partition takes is dealt out over as
    many as it fills, by a hash of the text.
    """
    placed = docs.withColumn("_part", order_part(docs, id_col, text_col, n)).repartitionById(n, "_part").drop("_part")
    return placed.sortWithinPartitions(id_col, F.octet_length(text_col), text_col)


def order_part(docs: DataFrame, id_col: str, text_col: str, n: int) -> Column:
    """The partition, 0 to n - 1, in which `in_order` puts a row."""
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)).cast("long"))
    shares = [k / n for k in range(1, n)]
    found = docs.select(F.percentile_approx(key, shares, 20 * n).alias("b")).first()["b"] if shares else None  # n - 1 numbers
    bounds = sorted(found or [])
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    # one literal, looked through by groups: about twice the root of n comparisons a row
    runs = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    firsts = F.transform(runs, lambda r: r[0])

    def passed(test: Callable[[Column], Column]) -> Column:
        """How many bounds the test, which holds up to some bound, holds for."""
        whole = F.size(F.filter(firsts, test))
        return F.when(whole > 0, (whole - 1) * step + F.size(F.filter(F.get(runs, whole - 1), test))).otherwise(0)

    below, upto = passed(lambda b: b < key), passed(lambda b: b <= key)
    return F.when(upto - below < 2, below).otherwise(below + F.pmod(F.xxhash64(text_col), upto - below).cast("int"))


def read_token_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decodes a table of shards: doc_id, start (ids before the document), n_tokens, ids (little-endian uint32)."""
    table = spark.read.schema(SHARDS).parquet(path)
    ddl = f"{id_col} long, part int, start_in_part long, n_tokens long, ids binary"
    schema = arrow_schema(ddl)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(len(batch))):
                x = {f.name: row.column(i)[0] for i, f in enumerate(batch.schema)}
                view = lambda name, kind, x=x: np.frombuffer(x[name].as_buffer(), kind)
                grammar = Grammar(x["base_ids"].as_py(), view("rules", "<u2").reshape(-1, 2), view("rule_sizes", "<u4"))
                ids = expand(grammar, view("symbols", "<u2"))
                sizes = view("doc_sizes", "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                yield pa.record_batch(
                    [x["doc_ids"].values, pa.array(np.full(len(sizes), x["part"].as_py(), np.int32)), pa.array(x["first"].as_py() + ends - sizes), pa.array(sizes), binary_rows(ids, np.concatenate(([0], ends)))],
                    schema=schema,
                )

    # one row per part: as many as the write had partitions
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("ids_in_part"))
    before = totals.select("part", (F.sum("ids_in_part").over(Window.orderBy("part")) - F.col("ids_in_part")).alias("ids_before"))
    return (
        table.select([f.name for f in table.schema if f.name not in ("n_ids", "shard")])
        .mapInArrow(decode, ddl)
        .join(F.broadcast(before), "part")
        .select(id_col, (F.col("start_in_part") + F.col("ids_before")).alias("start"), "n_tokens", "ids")
    )


def read_document(row: dict, n: int) -> np.ndarray:
    """Ids of document n of one shard (a Row as dict), from its own symbols alone."""
    grammar = Grammar(row["base_ids"], np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["rule_sizes"], "<u4"))
    ends = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))
    symbols = np.frombuffer(row["symbols"], "<u2")
    return expand(grammar, symbols[ends[n - 1] if n else 0 : ends[n]])

"""Secret scan: three patterns, and a token-efficiency test for random strings.

A vocabulary learned from natural text needs few tokens for words and many for random
strings: a run of key characters that yields few characters per token is a finding,
unless it is a known digest (hex of a digest's length, UUID) or reads as an identifier.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, release_with_owner, small_batches, take_over, text_bytes

#: In this order spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Lengths in hex digits of common digests (fixed values: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DATE = re.compile(rb"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_.-]?[0-9]{2}(?:[-._]?[0-9]{2}){0,2}(?:[-._+][0-9]{1,9})*)?Z?")
_IDENTIFIER = re.compile(rb"[_./=+-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_./=+-]+|\Z))+|(?:[A-Z]{0,4}+[a-z]{3,}+)+|[0-9_./=+-]+")
_WORD = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+")
#: What a run is taken apart into: UUIDs, stretches without separators, separators.
_PART = re.compile(rb"(?<![0-9a-fA-F])" + _UUID.pattern + rb"(?![0-9a-fA-F])|[A-Za-z0-9]+|[+/_.=-]+")

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer runs are encoded in pieces of so many characters; a piece's edge costs a token at most.
PIECE = 2_000
_vocabularies: dict[str, object] = {}
release_with_owner(_vocabularies.clear)


def _vocabulary(path: str):
    if path not in _vocabularies:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _vocabularies[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def _digest(body: bytes) -> bool:
    hexed = re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", body)
    return bool((hexed and len(body) in _DIGEST_LENGTHS) or _UUID.fullmatch(body))


def _in_order(body: bytes) -> bool:
    """Whether four in five characters are neighbours of the one before them, as in an alphabet or a count."""
    return len(body) > 1 and float((np.abs(np.diff(np.frombuffer(body, np.uint8).astype(np.int16))) == 1).mean()) >= 0.8


def known(run: bytes, vocabulary: str | None = None, most: float = 2.0) -> bool:
    """Whether a run is a digest of a known length, a UUID, a date, characters in order, or an identifier of words and short numbers.

    A word of an identifier has at most three letters, or at least `most` characters a token.
    """
    body = run.strip(b"=+/._-")
    if _digest(body) or _DATE.fullmatch(body) or _in_order(body):
        return True
    if not _IDENTIFIER.fullmatch(body):
        return False
    vocab = _vocabulary(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return all(len(w) <= 3 or len(w) >= most * _tokens(vocab, w) for w in _WORD.findall(body))


def _tokens(vocab, run: bytes) -> int:
    text = run.decode("ascii")
    return sum(len(vocab.encode_ordinary(text[k : k + PIECE])) for k in range(0, len(text), PIECE))


def _stretches(vocab, run: bytes, least: int, most: float) -> Iterator[tuple[int, int]]:
    """Start and end of what may be random in a run: parts that cost more than a token for `most` characters, together with their like.

    A digest, a UUID or a part that saves three characters or more, as a word does, ends a stretch; of what is between two
    such parts, the stretch of the largest cost counts (of equal ones the first to end, then the shortest), and any other part of `least` characters.
    """
    between: list[tuple[int, int, float]] = []

    def best() -> Iterator[tuple[int, int]]:
        total = top = 0.0
        start = lo = hi = 0
        for a, b, cost in between:
            if total <= 0:
                start, total = a, 0.0
            total += cost
            if total > top:
                lo, hi, top = start, b, total
        found = [(lo, hi)] if hi - lo >= least else []
        found += [(a, b) for a, b, cost in between if b - a >= least and cost > 0 and not (found and lo <= a < hi)]
        return iter(sorted(found))

    for m in _PART.finditer(run):
        part = m[0]
        cost = most * _tokens(vocab, part) - len(part) if part[:1].isalnum() else 0.0
        if cost <= -3 or _digest(part):
            yield from best()
            between = []
        else:
            between.append((*m.span(), cost))
    yield from best()


def _find(text: bytes, word: bytes) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def find_secrets(
    docs: DataFrame,
    vocabulary: str | None = None,
    least_run: int = 20,
    most_chars_per_token: float = 2.0,
    allowed: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, spans array<struct<kind, start, end, chars_per_token>> in order of start, then kind.

    Offsets are code points, ends exclusive. kinds: assign, access, hex by pattern; random: a run of at least
    least_run of [A-Za-z0-9+/_.=-] with fewer characters per token than most_chars_per_token, or else a stretch of its
    parts between separators with so few (a key behind a path or a name), that isn't known() or in `allowed` (digests
    and identifiers of one's own). A null or empty text has no spans; ids may be null or
    repeat; other columns are ignored; an empty table gives an empty one. One narrow pass over whole texts.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spared = {a.encode() for a in allowed}
    ddl = f"{id_col} long, spans array<struct<kind: string, start: long, end: long, chars_per_token: double>>"
    schema = arrow_schema(ddl)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        vocab = _vocabulary(path)

        def in_run(run: bytes, at: int) -> Iterator[tuple[int, int, int, float | None]]:
            for m in _ACCESS.finditer(run):
                if m.end() - m.start() >= 18:
                    yield at + m.start(), 1, at + m.end(), None
            for m in _HEX.finditer(run):
                if m.end() - m.start() >= 16:
                    yield at + m.start(), 2, at + m.end(), None
            if len(run) >= least_run and run not in spared and not known(run, path, most_chars_per_token):
                ratio = len(run) / _tokens(vocab, run)
                if ratio < most_chars_per_token:
                    yield at, 3, at + len(run), ratio
                    return
                for a, b in _stretches(vocab, run, least_run, most_chars_per_token):
                    part = run[a:b]
                    ratio = len(part) / _tokens(vocab, part)
                    if ratio < most_chars_per_token and part not in spared and not known(part, path, most_chars_per_token):
                        yield at + a, 3, at + b, ratio

        for big in batches:
            for batch in small_batches(big, text_col):
                data, at = text_bytes(batch.column(text_col))
                found: list[tuple[int, int, int, float | None]] = []
                inside = np.zeros(len(data) + 2, bool)
                inside[1:-1] = _RUN[data]
                edge = np.diff(inside.astype(np.int8))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for a, b in _cut(starts, ends, at, 16):
                    found += in_run(data[a:b].tobytes(), a)
                low = _LOWER[data].tobytes()
                named = np.unique([x for w in _WORDS for x in _find(low, w)]).astype(np.int64)
                for d in np.unique(np.searchsorted(at, named, "right") - 1).tolist():
                    for m in _ASSIGN.finditer(data[at[d] : at[d + 1]].tobytes()):
                        if m.end(2) - m.start(2) >= 12:
                            found.append((int(at[d]) + m.start(), 0, int(at[d]) + m.end(), None))
                found.sort(key=lambda x: x[:3])
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                spot = np.array([x[0] for x in found], np.int64)
                doc = np.searchsorted(at, spot, "right") - 1
                base = points[at[doc]] if len(found) else spot
                end = np.array([x[2] for x in found], np.int64)
                structs = pa.StructArray.from_arrays(
                    [pa.array([KINDS[x[1]] for x in found], pa.string()), pa.array(points[spot] - base), pa.array(points[end] - base), pa.array([x[3] for x in found], pa.float64())],
                    fields=list(schema.field("spans").type.value_type),
                )
                offsets = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
                yield pa.record_batch([batch.column(id_col).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs, type=schema.field("spans").type)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(scan, ddl)


def _cut(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Spans of at least `least` bytes, cut where a document ends."""
    long = ends - starts >= least
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        lo, hi = np.searchsorted(at, a, "right"), np.searchsorted(at, b, "left")
        cuts = [a, *at[lo:hi].tolist(), b]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x >= least:
                yield x, y

"""Exact token ids of whole text columns, with each distinct chunk encoded once.

Byte-level and word-end vocabularies never merge across the place where a text is
cut here, so a column is cut into chunks, the library encodes the distinct chunks,
and the ids are gathered back. Texts for which a cut isn't provably neutral, and those
that hold the string of an added token, are encoded whole. The library is used as it
is: the string of an added token in a text is that token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sievework.llm.common import ragged, release_with_owner, text_bytes

#: Chunks kept from batch to batch in a worker (about 170 bytes each).
CACHE_CHUNKS = 600_000
_MET_MASK = (1 << 24) - 1
#: Stands between chunks that are encoded in one call; no vocabulary entry joins it with another byte.
MARK = "\x01"
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_encoders: dict[tuple[str, str], ChunkEncoder] = {}
release_with_owner(_encoders.clear)


class ChunkEncoder:
    """cut "space": chunks start at each single space, which stays with the word after it (byte-level, GPT-2 pattern).
    cut "words": chunks are what white space separates, which the vocabulary drops (word-end BPE)."""

    def __init__(self, path: str, cut: str, room: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.cut, self.room = cut, room
        self.cache: dict[str, bytes] = {}
        self.met = bytearray(_MET_MASK + 1)

        self.joint = MARK if cut == "space" else f" {MARK} "
        mark = self._ids([MARK])[0]
        name = self.lib.id_to_token(int(mark[0])).removesuffix("</w>")
        alone = len(mark) == 1 and sum(name in t for t in self.lib.get_vocab(with_added_tokens=False)) <= 2
        self.mark = int(mark[0]) if alone else None

    def _keep(self, found: Iterable[tuple[str, bytes]]) -> None:
        """Keeps what was met in an earlier batch too: most rare words never come again."""
        cache, met = self.cache, self.met
        room = self.room - len(cache)
        for chunk, ids in found:
            slot = hash(chunk) & _MET_MASK
            if not met[slot]:
                met[slot] = 1
            elif room > 0:
                cache[chunk] = ids
                room -= 1

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Most are joined by marks and encoded together; a mark beside the others could change their ids."""
        out: list[bytes] = [b""] * len(chunks)
        joint = [i for i, c in enumerate(chunks) if c and c[0] != "'" and not c[-1].isspace() and MARK not in c] if self.mark is not None else []
        if len(joint) < len(chunks):
            apart = sorted(set(range(len(chunks))).difference(joint))
            for i, ids in zip(apart, self._ids([chunks[i] for i in apart]), strict=True):
                out[i] = ids.tobytes()
        for a in range(0, len(joint), 4_000):
            some = joint[a : a + 4_000]
            ids = self._ids([self.joint.join([chunks[i] for i in some])])[0]
            cuts = np.flatnonzero(ids == self.mark)
            raw, at = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
            for k, i in enumerate(some):
                out[i] = raw[4 * at[k] + 4 : 4 * at[k + 1]]
        return out

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and len + 1 offsets; null counts as empty."""
        col = pc.fill_null(col, "").cast(pa.large_string())
        apart = np.zeros(len(col), bool)
        for token in self.added:
            apart |= pc.match_substring(col, token).to_numpy(zero_copy_only=False)
        if self.cut == "space":
            odd = pc.match_substring_regex(col, r"\s[ ](?:\s|\z)|[^\x00-\x7f\pL\pN\pP\pS] ?")
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False) & ~apart).tolist():
                apart[i] = bool(_UNSAFE.search(col[i].as_py()))
        whole: dict[int, np.ndarray] = {}
        if apart.any():
            at = np.flatnonzero(apart).tolist()
            whole = dict(zip(at, self._ids([col[i].as_py() for i in at]), strict=True))
            col = pc.if_else(pa.array(apart), pa.scalar("", pa.large_string()), col)
        if self.cut == "words":
            col = pc.replace_substring(col, "\n", " ")
        parts = pc.split_pattern(col, " ")
        flat, at = parts.values, np.asarray(parts.offsets)
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = strings(coded.dictionary, " " if self.cut == "space" else "")
        first = np.zeros(len(flat), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        if self.cut == "space":  # the first chunk of a text has no space before it: coded apart
            heads = np.flatnonzero(first)
            index[heads] = len(keys) + np.arange(len(heads))
            keys += flat.take(pa.array(heads)).to_pylist()
        cache = self.cache
        got = list(map(cache.get, keys))
        plain: list[int] = []
        split: dict[int, list[str]] = {}
        for i, g in enumerate(got):
            if g is None:
                k = keys[i]
                if k[-1:].isalpha() and "\n" not in k:
                    plain.append(i)
                else:
                    split[i] = parts_of(k)
        new = [keys[i] for i in plain]
        new += set(p for ps in split.values() for p in ps if p not in cache).difference(new)
        done = dict(zip(new, self._encode(new), strict=True))
        for i in plain:
            got[i] = done[keys[i]]
        for i, ps in split.items():
            got[i] = b"".join([done[p] if p in done else cache[p] for p in ps])
        self._keep(done.items())
        self._keep((keys[i], got[i]) for i, ps in split.items() if len(ps) > 1)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        pool, pool_at = np.frombuffer(b"".join(got), np.uint32), np.cumsum(sizes) - sizes
        ids = pool[ragged(pool_at[index], sizes[index])]
        ends = np.concatenate(([0], np.cumsum(sizes[index])))
        offsets = ends[at]
        if whole:
            pieces, lengths, last = [], np.diff(offsets), 0
            for i in sorted(whole):
                pieces += [ids[last : offsets[i]], whole[i]]
                last, lengths[i] = offsets[i + 1], len(whole[i])
            ids = np.concatenate([*pieces, ids[last:]])
            offsets = np.concatenate(([0], np.cumsum(lengths)))
        return ids, offsets


_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def parts_of(chunk: str) -> list[str]:
    """Parts of a chunk that both patterns keep apart: at single line feeds, and before marks that follow a Latin letter.

    A letter whose lower case has more than one character (a dotted capital I) ends in a mark there, which joins those after it.
    """
    lines = chunk.split("\n")
    if len(lines) > 1 and any(not x or x[-1].isspace() or (i and x[0].isspace()) for i, x in enumerate(lines)):
        return [chunk]
    out = []
    for i, x in enumerate(lines):
        if i:
            out.append("\n")
        core = x.rstrip(_MARKS)
        if len(core) < len(x) and core and core[-1] < "\u0250" and core[-1].lower().isalpha():
            out += (core, x[len(core) :])
        else:
            out.append(x)
    return out


def strings(words: pa.Array, before: str) -> list[str]:
    """The words, each with `before` in front; one split of one string where that is possible."""
    if len(words):
        one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
        joint = pc.binary_join(one, "\x02" + before)[0].as_py()
        out = (before + joint).split("\x02")
        if len(out) == len(words):
            return out
    return [before + w for w in words.to_pylist()]


def encoder(path: str, cut: str, room: int = CACHE_CHUNKS) -> ChunkEncoder:
    """One per worker and vocabulary; room: chunks that it may keep."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = ChunkEncoder(path, cut, room)
    return _encoders[path, cut]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id `end` to each document."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(n + 1)


__all__ = ["ChunkEncoder", "encoder", "text_bytes", "with_end"]

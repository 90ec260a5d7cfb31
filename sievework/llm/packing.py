"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two: as many of the
largest length as fit, then the binary digits of the rest, longest first. A piece
is a sequence of its own, so no sequence crosses documents and nothing is padded;
sequences of equal length form a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sievework.llm.common import arrow_schema, binary_rows, small_batches, take_over
from sievework.llm.tokenize import encoder, with_end

#: Bits of a sequence_id: partition, then bucket, then place in that bucket.
BUCKET_SHIFT, PART_SHIFT = 36, 41


def binary_pieces(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and length of each piece, in document order and longest first."""
    docs = [np.repeat(np.arange(len(lengths)), lengths // longest)]
    sizes = [np.full(len(docs[0]), longest, np.int64)]
    size = longest >> 1
    while size:
        has = np.flatnonzero(lengths & size)
        docs.append(has)
        sizes.append(np.full(len(has), size, np.int64))
        size >>= 1
    doc, size = np.concatenate(docs), np.concatenate(sizes)
    order = np.argsort(doc, kind="stable")
    return doc[order], size[order]


def pack_power_of_two(
    docs: DataFrame,
    vocabulary: str | None = None,
    cut: str = "words",
    end_id: int = 1,
    longest: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, bucket.

    Each row of docs is a document, repeated ids included: its pieces carry row_no, a number of the row in
    its partition, so that repeated documents stay apart. A null or empty text is the end id alone, one piece
    of length 1. A null id stays null. Other columns are ignored. longest must be a power of two. An empty
    table gives an empty table. One narrow pass: no shuffle, memory for a batch of texts.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    ddl = f"{id_col} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int, row_no long"
    schema = arrow_schema(ddl)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        encode, part = encoder(path, cut), TaskContext.get().partitionId()
        used, rows = np.zeros(longest.bit_length(), np.int64), 0
        for big in batches:
            for batch in small_batches(big, text_col):
                ids, at = with_end(*encode(batch.column(text_col)), end_id)
                doc, length = binary_pieces(np.diff(at), longest)
                ends = np.cumsum(length)
                start = ends - length - at[doc]
                bucket = np.round(np.log2(length)).astype(np.int64)
                place = np.empty(len(doc), np.int64)
                for b in range(len(used)):
                    mine = np.flatnonzero(bucket == b)
                    place[mine] = used[b] + np.arange(len(mine))
                    used[b] += len(mine)
                yield pa.record_batch(
                    [
                        batch.column(id_col).cast(pa.int64()).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length),
                        binary_rows(ids, np.concatenate(([0], ends))),
                        pa.array(np.diff(at)[doc]),
                        pa.array((np.int64(part) << PART_SHIFT) + (bucket << BUCKET_SHIFT) + place),
                        pa.array(np.zeros(len(doc), np.int64)),
                        pa.array(bucket.astype(np.int32)),
                        pa.array(rows + doc),
                    ],
                    schema=schema,
                )
                rows += len(batch)

    return docs.select(id_col, text_col).mapInArrow(pieces, ddl)

"""Packing by concatenate and cut.

Pass one tokenises each partition, keeps the ids in a table of the shared
folder and counts the ids of every partition. The prefix sums of these
totals (one number per partition) give each partition its global offset; the
running sums inside a partition were written beside the ids. Pass two cuts
the one long id stream at every multiple of the window. A document that
crosses a cut becomes several pieces; the pieces of a window that several
partitions share are its boundary records and need no exchange, since the
global offset alone names window and place. Only the last window can be
short: it is padded, unless its length is a power of two.

Defined results: a null or empty text is the end id alone; null ids and rows
that share an id are packed as any other; an empty table gives no rows;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import byte_slices, map_arrow, store, text_bytes
from sinter.llm.tokenfile import with_end
from sinter.llm.tokens import default_path, encoder

ROWS_BYTES = 8 << 20


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of documents: partition, place in it, and the ids."""
    path = tokenizer or default_path()

    def runs(batches):
        enc, part, begun = encoder(path), TaskContext.get().partitionId(), 0
        small = np.uint16 if len(enc.n_bytes) <= 1 << 16 else np.uint32
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1)
            _, off = text_bytes(texts)
            rows = []
            for a, b in byte_slices(off, ROWS_BYTES):
                ids, n = with_end(*enc.encode(texts.slice(a, b - a)), end_id)
                rows.append((part, begun, len(ids), small().itemsize, doc.slice(a, b - a).to_pylist(),
                             n.tolist(), ids.astype(small).tobytes()))
                begun += len(ids)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                names=["part", "local_start", "n_ids", "width", "doc_ids", "lengths", "ids"])

    return map_arrow(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), runs,
        "part int, local_start long, n_ids long, width int, doc_ids array<long>, "
        "lengths array<long>, ids binary")


def partition_offsets(runs: DataFrame) -> dict[int, int]:
    """Global offset of each partition; one number per partition is read."""
    totals = runs.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = at
        at += r["n"]
    return base


def cut_pieces(first: int, lengths: np.ndarray, window: int):
    """Cut documents that lie one after the other from global place ``first``.
    Returns (document index, start in document, length, window, place)."""
    end = first + np.cumsum(lengths)
    begin = end - lengths
    n = (end - 1) // window - begin // window + 1
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    seq = begin[doc] // window + k
    lo = np.maximum(begin[doc], seq * window)
    hi = np.minimum(end[doc], (seq + 1) * window)
    return doc, lo - begin[doc], hi - lo, seq, lo - seq * window


def pack(runs: DataFrame, window: int = 1024) -> DataFrame:
    """Pieces of all documents of a written ``tokenised`` table."""
    base = partition_offsets(runs)

    def pieces(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for part, local, width, doc_ids, lengths, raw in zip(*cols):
                ids = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32)
                n = np.array(lengths, np.int64)
                doc, start, size, seq, place = cut_pieces(base[part] + local, n, window)
                at = (np.cumsum(n) - n)[doc] + start
                wide = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * x:4 * (x + y)]) for x, y in zip(at.tolist(), size.tolist())]
                out = [pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(size),
                       pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(place)]
                yield pa.RecordBatch.from_arrays(out, names=[
                    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return map_arrow(
        runs.select("part", "local_start", "width", "doc_ids", "lengths", "ids"), pieces,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long")


def packed_sequences(docs: DataFrame, window: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``docs`` packed into windows of ``window`` ids."""
    return pack(store(tokenised(docs, tokenizer), "packing-ids"), window)

"""Token files: frequency-ranked ids in byte-aligned variable-length code.

A file is a sequence of blocks in document order, stored one per row of a
Parquet table so that any Hadoop file system can hold it. The bytes of a
block are self-contained (little-endian):

    magic "FRV2" | n_docs u32 | n_ids u64 | n_table u32
    docs    i64[n_docs]    doc_id of each document
    known   u8[ceil(n_docs / 8)]  a bit per document: it has a doc_id
    table   u32[n_table]   the block's ids, most frequent first
    lengths u32[n_docs]    ids of each document, the end id included
    control u8[ceil(n_ids / 4)]   2 bits per id: bytes of its code, less one
    data    1 to 4 bytes per id: its rank in the table

The control bytes lie apart from the data, so a reader finds the length and
place of every code by a 256-row table and a running sum, without a loop.

Encoding sorts the texts by (doc_id, hash of text) with one range exchange,
whose ranges may also end between equal rows, so that rows repeated very often
are spread; each task then tokenises and writes its blocks and counts from where in the
partition they begin. Partition totals, one number per partition, turn these
into global starts when the files are read.

Defined results: a null or empty text is the end id alone; null doc_ids sort
first; rows that share a doc_id keep a start each; an empty table gives a
table without rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinter.llm.common import byte_slices, map_arrow, store, text_bytes
from sinter.llm.tokens import default_path, encoder, ragged

MAGIC = b"FRV2"
_HEAD = struct.Struct("<4sIQI")
BLOCK_BYTES = 8 << 20  # text bytes of a block, one document at least
# lengths of the four codes of each control byte
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def pack_block(ids: np.ndarray, lengths: np.ndarray, docs: pa.Array) -> bytes:
    """Bytes of one block from the ids of its documents, their counts and
    their doc_ids."""
    uniq, inv, n = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((uniq, -n))
    rank = np.empty(len(uniq), np.uint32)
    rank[order] = np.arange(len(uniq), dtype=np.uint32)
    code = rank[inv]
    size = 1 + (code > 0xFF).astype(np.uint8) + (code > 0xFFFF) + (code > 0xFFFFFF)
    two = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    two[:len(code)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    keep = np.arange(4)[None, :] < size[:, None]
    data = code.astype("<u4").view(np.uint8).reshape(-1, 4)[keep]
    named = docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    known = np.packbits(docs.is_valid().to_numpy(zero_copy_only=False))
    return b"".join([_HEAD.pack(MAGIC, len(lengths), len(ids), len(uniq)), named.tobytes(), known.tobytes(),
                     uniq[order].astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
                     control.astype(np.uint8).tobytes(), data.tobytes()])


def unpack_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, lengths, doc_ids) of a block; raises ValueError on a damaged one."""
    magic, n_docs, n_ids, n_table = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    named = np.frombuffer(blob, "<i8", n_docs, at)
    at += 8 * n_docs
    known = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n_docs // 8), at), count=n_docs).astype(bool)
    at += -(-n_docs // 8)
    docs = pa.array(named, pa.int64(), mask=~known)
    tab = np.frombuffer(blob, "<u4", n_table, at)
    at += 4 * n_table
    lengths = np.frombuffer(blob, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    control = np.frombuffer(blob, np.uint8, -(-n_ids // 4), at)
    at += len(control)
    data = np.frombuffer(blob, np.uint8, -1, at)
    size = _LENGTHS[control].ravel()[:n_ids]
    ends = np.cumsum(size, dtype=np.int64)
    if lengths.sum() != n_ids or (ends[-1] if n_ids else 0) != len(data):
        raise ValueError("damaged token block")
    pos = ends - size
    code = data[pos].astype(np.uint32)
    for more in (1, 2, 3):
        has = np.flatnonzero(size > more)
        if not len(has):
            break
        code[has] |= data[pos[has] + more].astype(np.uint32) << np.uint32(8 * more)
    return tab[code], lengths, docs


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the new counts."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    begin = np.cumsum(counts + 1) - (counts + 1)
    out[ragged(begin, counts)] = ids
    return out, counts + 1


BLOCK_SCHEMA = "part int, local_start long, n_ids long, block binary"


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token file of ``docs``, one row per block, in ascending id order."""
    path = tokenizer or default_path()

    def blocks(batches):
        enc, part, begun = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            _, off = text_bytes(texts)
            rows = []
            for a, b in byte_slices(off, BLOCK_BYTES):
                ids, n = with_end(*enc.encode(texts.slice(a, b - a)), end_id)
                rows.append((part, begun, len(ids), pack_block(ids, n, ids_col.slice(a, b - a))))
                begun += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["part", "local_start", "n_ids", "block"])

    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows of one id and text are interchangeable, so any tie-break will do
    ordered = (two.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
               .repartitionByRange("id", "h", "tie")
               .sortWithinPartitions("id", "h").select("id", "text"))
    return map_arrow(ordered, blocks, BLOCK_SCHEMA)


def decode_documents(file: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from a token file."""
    totals = file.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a partition
    base, run = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = run
        run += r["n"]

    def rows(batches):
        for batch in batches:
            for part, local, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, n, docs = unpack_block(blob)
                end = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(end.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(base[part] + local + end - n),
                     pa.array(n), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(
        file.select("part", "local_start", "block"), rows,
        "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token file of ``docs`` to the shared folder and read it back."""
    return decode_documents(store(encode_documents(docs, tokenizer), "token-file"))

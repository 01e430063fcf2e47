"""Token-ID output: documents as packed id chunks in doc_id order or one that is asked for, with random access."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm import pfor, tokenizing
from pageloom.llm.common import new_path, slices, text_or_empty, tidy, to_batch

END_ID, CHUNK_IDS = 1, 1 << 18
CHUNKS = "part int, seq int, local_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def _writer(tokenizer: str, end_id: int, chunk_ids: int, remembered: int | None):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        encoder = tokenizing.encoder(tokenizer, remembered)
        docs, held, size = [], [], 0

        def chunk():
            ids = np.frombuffer(b"".join(held), "<u4")
            return to_batch(_SCHEMA, [[part], [seq], [start], [len(ids)], [docs], [[len(h) // 4 for h in held]], [pfor.encode(ids)]])

        for b in batches:
            text = b.column(1)
            for s, e in slices(text):
                for doc, ids in zip(b.column(0).slice(s, e - s).to_pylist(), encoder.encode(text.slice(s, e - s).to_pylist()), strict=True):
                    docs.append(doc)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= chunk_ids:
                        yield chunk()
                        seq, start, docs, held, size = seq + 1, start + size, [], [], 0
        if docs:
            yield chunk()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, order: tuple[str, ...] = ("doc_id", "text"), remembered: int | None = None) -> None:
    """Write the ids of every text (null: none), each with end_id after it, in ascending order of the columns of order.

    One row of the table at path is a chunk of whole documents: its place (part, seq, ids before it in its part), the
    documents' ids and lengths, and the packed ids. By default rows without doc_id come first and rows with the same
    doc_id follow each other by text. A document of any length is one entry. A worker remembers the ids of so many words
    (tokenizing.REMEMBERED if not said): more of its memory for less of its time.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"), *(c for c in order if c not in ("doc_id", "text")))
    ordered = rows.repartitionByRange(order[0]).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(tidy(_writer(tokenizer, end_id, chunk_ids, remembered)), CHUNKS).write.parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks with start, the ids of all documents before them."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    # one row a range partition, so its size is that of the partitions
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(earlier, F.lit(0)).cast("long").alias("before"))
    return chunks.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        for r in range(b.num_rows):
            docs, lengths, payload, start = (b.column(i)[r].as_py() for i in range(4))
            raw = pfor.decode(payload).astype("<u4").tobytes()
            ends = np.cumsum(lengths, dtype=np.int64)
            begins = ends - np.array(lengths, np.int64)
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield to_batch(schema, [pa.array(docs, pa.int64()), begins + start, pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its decoded ids."""
    return read_chunks(spark, path).select("doc_ids", "lengths", "payload", "start").mapInArrow(tidy(_digests), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids (end id last), decoded."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for b in batches:
            for r in range(b.num_rows):
                docs, lengths, payload = (b.column(i)[r].as_py() for i in range(3))
                cut = np.split(pfor.decode(payload).astype(np.int64), np.cumsum(lengths)[:-1])
                yield to_batch(schema, [pa.array(docs, pa.int64()), pa.array([c.tolist() for c in cut], pa.list_(pa.int64()))])

    return read_chunks(spark, path).select("doc_ids", "lengths", "payload").mapInArrow(tidy(run), "doc_id long, ids array<long>")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, order: tuple[str, ...] = ("doc_id", "text"), remembered: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs (doc_id, text), read back from the files that are written to path.

    Without a path they go to the shared folder. Null and empty texts are their end id alone; repeated rows are entries of
    their own; other columns of docs don't matter. An empty table gives no rows.
    """
    path = path or new_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, tokenizer, order=order, remembered=remembered)
    return read_digests(docs.sparkSession, path)

"""Line dedup: keep bitmaps from a range-partitioned stream of line hashes.

Line keys are hashed to 128 bits, range-partitioned by (hash, document, position)
and sorted; each partition streams once and marks every line whose key began in
another document. A key that spans partitions is settled from one or two summary
rows per partition. What comes back per document is a compressed bitmap of the
lines to keep; texts meet it only in apply_keep().
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import stored, text_or_empty, tidy, to_batch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
_MARKS = "k1 long, k2 long, doc_id long, version long, pos int, kind int"
_DROPPED, _OPEN, _SUMMARY = 0, 1, 2


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, version (hash of the text), pos and the two hash halves of each key of at least min_chars code points."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.xxhash64(text_or_empty()).alias("version"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)
    keyed = lines.select("doc_id", "version", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), F.reverse("key")).alias("k2"), "doc_id", "version", "pos")


def _stream(batches):
    """Marks of one sorted partition. Rows of its first key stay open; its first and last keys are summed up."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("kind", pa.int32())])
    last = head = None  # (k1, k2, first doc)
    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, doc, version, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        if last is not None:
            new[0] = (k1[0], k2[0]) != last[:2]
        group = np.cumsum(new) - (1 if new[0] else 0)
        firsts = doc[new] if new[0] else np.concatenate([[last[2]], doc[new]])
        if head is None:
            head = (k1[0], k2[0], doc[0])
        is_open = (k1 == head[0]) & (k2 == head[1])
        drop = ~is_open & (doc != firsts[group])
        for rows, kind in ((drop, _DROPPED), (is_open, _OPEN)):
            if rows.any():
                yield to_batch(schema, [k1[rows], k2[rows], doc[rows], version[rows], pos[rows], np.full(rows.sum(), kind, np.int32)])
        last = (k1[-1], k2[-1], firsts[-1])
    if head is not None:
        ends = [head] + ([last] if last[:2] != head[:2] else [])
        yield to_batch(schema, [[int(e[0]) for e in ends], [int(e[1]) for e in ends], [int(e[2]) for e in ends], [0] * len(ends), [0] * len(ends), [_SUMMARY] * len(ends)])


def _to_bitmaps(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("keep", pa.binary())])
    for b in batches:
        out = []
        for dropped in b.column(2):
            at = np.array(dropped.as_py(), np.int64)
            bits = np.ones((at.max() // 8 + 1) * 8, np.uint8)
            bits[at] = 0
            out.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield to_batch(schema, [b.column(0), b.column(1), pa.array(out, pa.binary())])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, version, keep (zlib of packed bits, 1 = keep; lines past its end are kept) for documents that lose lines.

    A line goes if its key also stands in a document with a smaller id. Rows that share a doc_id are one document; rows
    without doc_id hold no keys and lose nothing. Shorter keys never count.
    """
    keys = stored(line_keys(docs, min_chars), "line-keys")  # range bounds are sampled from them, so they would be made twice
    order = ["k1", "k2", "doc_id", "pos"]
    marks = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_stream), _MARKS), "line-marks")
    # two rows a range partition at most, so their number is that of the partitions
    ends = marks.filter(F.col("kind") == _SUMMARY).groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    late = marks.filter(F.col("kind") == _OPEN).join(F.broadcast(ends), ["k1", "k2"]).filter("doc_id > first")
    dropped = marks.filter(F.col("kind") == _DROPPED).select("doc_id", "version", "pos").unionByName(late.select("doc_id", "version", "pos"))
    return dropped.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("p")).mapInArrow(tidy(_to_bitmaps), "doc_id long, version long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = text.split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def with_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and keep of every row of docs."""
    whole = docs.select("doc_id", text_or_empty().alias("text")).withColumn("version", F.xxhash64("text"))
    return whole.join(bitmaps, ["doc_id", "version"], "left").select("doc_id", "text", "keep")


def apply_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id and the text of its kept lines."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for b in batches:
            yield to_batch(schema, [b.column(0), pa.array(["\n".join(kept_lines(t.as_py(), k.as_py())[0]) for t, k in zip(b.column(1), b.column(2), strict=True)], pa.string())])

    return with_keep(docs, bitmaps).mapInArrow(tidy(run), "doc_id long, text string")


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
        for b in batches:
            rows = []
            for t, k in zip(b.column(1), b.column(2), strict=True):
                text, keep = t.as_py(), k.as_py()
                if keep is None:
                    rows.append((text.count("\n") + 1, 0, hashlib.sha256(text.encode()).hexdigest()))
                    continue
                stay, n = kept_lines(text, keep)
                rows.append((n, n - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
            yield to_batch(schema, [b.column(0), *(list(x) for x in zip(*rows, strict=True))] if rows else [b.column(0), [], [], []])

    return with_keep(docs, bitmaps).mapInArrow(tidy(run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

"""Token counts through a digest cache.

Content digests are joined to stored counts of the same tokenizer version; each
distinct miss is encoded once and appended to the cache.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import tokenizing
from pageloom.llm.common import narrowed, new_path, slices, stored, text_or_empty, tidy, to_batch

CACHE = "digest binary, tokenizer string, n_tokens long"


def _counter(path: str):
    def run(batches):
        schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
        counter = tokenizing.counter(path)
        for b in batches:
            text = b.column(1)
            for s, e in slices(text):
                yield to_batch(schema, [b.column(0).slice(s, e - s), pa.array(counter.count(text.slice(s, e - s).to_pylist()), pa.int64())])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text") -> DataFrame:
    """Add n_bytes and n_tokens to every row of docs. Extra columns stay; the operator's own have a leading underscore.

    Normalised content is the UTF-8 text itself (byte-level counts depend on every byte) with null as empty. cache is a
    folder of digest, tokenizer, n_tokens that other runs may have filled; new counts are appended to it. Copies, empty
    texts and repeated rows share one entry; a digest that stands there twice counts once. Columns of docs named n_bytes or
    n_tokens are replaced. Two runs must not fill one cache at the same time.
    """
    spark = docs.sparkSession
    cache, version = cache or new_path(spark, "token-cache"), tokenizing.version_of(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored_counts = lambda: spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    known = lambda: stored_counts().groupBy(F.col("digest").alias("_digest")).agg(F.min("n_tokens").alias("_count"))
    content = text_or_empty(text)
    keyed = docs.drop("n_bytes", "n_tokens").withColumn("_digest", F.unhex(F.sha2(content, 256)))
    # digests alone are compared with the cache; a filter then keeps the texts of those known from being moved
    missing = stored(keyed.select("_digest").distinct().join(known(), "_digest", "left_anti").select("_digest"), "token-misses")
    few = narrowed(keyed.select("_digest", content.alias("_text")), "_digest", missing, missing.count())
    misses = few.groupBy("_digest").agg(F.first("_text").alias("_text")).join(missing, "_digest", "left_semi").select("_digest", "_text")
    made = misses.mapInArrow(tidy(_counter(tokenizer)), "digest binary, n_tokens long")
    made.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    rows = keyed.select(*[c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")], F.octet_length(content).cast("long").alias("n_bytes"), "_digest")
    return rows.join(known(), "_digest").select(*rows.columns[:-1], F.col("_count").alias("n_tokens"))

"""Sources and sinks: tables, page requests, images, vocabularies, JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = (
    "image string, dpr double, cropRect struct<left:double,top:double,width:double,height:double>,"
    " readingDirection string, voice string, speed double, requestId string, _bad string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_requests(df: DataFrame, column: str = "body") -> DataFrame:
    """JSON bodies as columns; status 400 where the image is missing or the body is no JSON."""
    req = F.from_json(F.col(column), REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = df.withColumn("req", req)
    bad = F.col("req").isNull() | F.col("req._bad").isNotNull() | F.coalesce(F.col("req.image") == "", F.lit(True))
    return df.select(*[c for c in df.columns if c != "req"], "req.*", F.when(bad, 400).otherwise(200).alias("status")).drop("_bad")


def image_bytes(image: Column) -> Column:
    """Bytes of a base64 text with or without a data: header, null if it is no base64."""
    payload = F.when(image.startswith("data:"), F.regexp_extract(image, "(?s)^[^,]*,(.*)$", 1)).otherwise(image)
    return F.try_to_binary(payload, F.lit("base64"))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct upper-case words of a line file (column word): no blank lines, no lines that start with #."""
    word = F.upper(F.trim(F.col(column)))
    return lines.filter(~F.col(column).startswith("#")).select(word.alias("word")).filter("word <> ''").distinct()


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return vocabulary(spark.read.text(path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term and freq from a file of "term count" lines."""
    return spark.read.csv(path, sep=" ", schema="term string, freq long")


def protected(words: DataFrame, vocab: DataFrame, column: str = "word") -> DataFrame:
    """Words that the vocabulary holds, whatever their case."""
    return words.join(vocab.select(F.col("word").alias("_w")), F.upper(F.col(column)) == F.col("_w"), "left_semi")


def envelope(regions: DataFrame, page: str = "page_id", name: str = "bubbles") -> DataFrame:
    """One JSON reply per page: its regions in rank order and counts."""
    fields = [c for c in regions.columns if c not in (page, "rank")]
    items = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    plain = F.transform(items, lambda r: F.struct(*(r[f].alias(f) for f in fields)))
    reply = F.to_json(F.struct(plain.alias(name), F.struct(F.size(items).alias("returned")).alias("timing")))
    return regions.groupBy(page).agg(reply.alias("body"))


def write_clips(clips: DataFrame, path: str) -> None:
    """Audio clips (key, idx, wav binary) as Parquet."""
    clips.write.mode("append").parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table that comes as fewer splits than there are cores is dealt out anew, any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Defaults of the settings that a client keeps.
SETTINGS = {"voice": "default", "speed": "1.0", "overlay": "true", "autoRead": "false", "showMarks": "true", "freeText": "false"}


def settings(spark: SparkSession, prefix: str = "pageloom.") -> dict[str, str]:
    """The settings as the session has them, defaults where it has none."""
    return {k: spark.conf.get(prefix + k, v) for k, v in SETTINGS.items()}


def write_log(path: str):
    """foreachBatch writer of log lines (column msg) as text, a folder for each micro-batch, so a repeated batch isn't doubled."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.select(F.col("msg").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return write


def stage_times(spark: SparkSession) -> DataFrame:
    """stage_id, name and ms of the finished stages of this application, from Spark's own status store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    rows = []
    for i in range(found.size()):
        s = found.apply(i)
        if s.completionTime().isDefined() and s.submissionTime().isDefined():
            rows.append((s.stageId(), s.name(), s.completionTime().get().getTime() - s.submissionTime().get().getTime()))
    return spark.createDataFrame(rows, "stage_id int, name string, ms long")

"""Caches, late upgrades, runs and sessions over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: str, seq: str, n: int, within: str | None = None) -> DataFrame:
    """The n keys inserted last, first in first out: reads don't refresh a key and overwriting keeps its slot.

    Returns key, slot (first insert) and the value columns of the key's last write.
    """
    part = [within] if within else []
    value = F.max_by(F.struct(*[c for c in df.columns if c not in (key, *part)]), F.col(seq)).alias("v")
    slots = df.groupBy(*part, key).agg(F.min(seq).alias("slot"), value)
    if not part:
        return slots.orderBy(F.desc("slot")).limit(n).select(key, "slot", "v.*")
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("slot")))
    return slots.withColumn("age", rank).filter(F.col("age") <= n).select(*part, key, "slot", "v.*")


def cached(requests: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Requests with the cached value where there is one, and hit."""
    return requests.join(cache.select(*keys, value), keys, "left").withColumn("hit", F.col(value).isNotNull())


def merge_upgrades(base: DataFrame, upgrades: DataFrame, keys=("page_id", "bubble_idx"), after: Column | None = None) -> DataFrame:
    """Base rows with text and score of their upgrade, joined by key; only where the text differs and after holds."""
    up = upgrades.select(*keys, F.col("text").alias("new_text"), F.col("score").alias("new_score"))
    both = base.join(up, list(keys), "left")
    use = F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text"))
    use = F.coalesce(use & after if after is not None else use, F.lit(False))
    pick = lambda c: F.when(use, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    rest = [c for c in base.columns if c not in (*keys, "text", "score")]
    return both.select(*keys, *rest, pick("text"), pick("score"), use.alias("upgraded"))


def merge_by_position(base: DataFrame, upgrades: DataFrame, page: str, base_order: str, up_order: str) -> DataFrame:
    """For parity tests only: the i-th upgrade of a page goes to its i-th row, whatever it was made from."""
    pos = lambda order: F.row_number().over(Window.partitionBy(page).orderBy(order))
    up = upgrades.withColumn("pos", pos(up_order)).select(page, "pos", F.col("text").alias("new_text"))
    return base.withColumn("pos", pos(base_order)).join(up, [page, "pos"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text", "pos")


def empty_runs(df: DataFrame, seq: str, n_items: str, within: str, limit: int = 2) -> DataFrame:
    """Add run (empty pages in a row so far) and action: read, advance while run <= limit, then stop and start anew."""
    w = Window.partitionBy(within).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    empty = F.col(n_items) == 0
    df = df.withColumn("_island", F.sum(F.when(empty, 0).otherwise(1)).over(w))
    inside = Window.partitionBy(within, "_island").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(empty, 1).otherwise(0)).over(inside)
    run = F.when(empty, (run - 1) % (limit + 1) + 1).otherwise(0)
    df = df.withColumn("run", run.cast("int"))
    action = F.when(~empty, "read").when(F.col("run") <= limit, "advance").otherwise("stop")
    return df.withColumn("action", action).drop("_island")


def sessions(df: DataFrame, key: str, ts: str, gap: str = "10 minutes") -> DataFrame:
    """Sessions that end after gap without activity: started, ended (last activity plus gap), n. Works on streams too."""
    out = df.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def changed(df: DataFrame, within: str, seq: str, columns: list[str]) -> DataFrame:
    """Add changed: any column differs from the row before (false on the first row)."""
    w = Window.partitionBy(within).orderBy(seq)
    now = F.struct(*columns)
    before = F.lag(now).over(w)
    return df.withColumn("changed", F.coalesce(before != now, F.lit(False)))


def chapter_changed(df: DataFrame, within: str, seq: str) -> DataFrame:
    """Add changed: url or title differ from the row before, or a chapter number or page total that both rows have."""
    w = Window.partitionBy(within).orderBy(seq)
    differs = F.lit(False)
    for c, none in (("chapter_num", ""), ("dom_chapter", ""), ("script_chapter", ""), ("total_pages", "?"), ("url", None), ("title", None)):
        before = F.lag(c).over(w)
        d = before != F.col(c)
        differs = differs | F.coalesce(d if none is None else d & (before != none) & (F.col(c) != none), F.lit(False))
    return df.withColumn("changed", differs)


def skip(df: DataFrame, within: str, seq: str, value: str) -> DataFrame:
    """Add back and forward: value of the neighbours, held at the ends."""
    w = Window.partitionBy(within).orderBy(seq)
    return df.withColumn("back", F.coalesce(F.lag(value).over(w), F.col(value))).withColumn("forward", F.coalesce(F.lead(value).over(w), F.col(value)))


def latest_request(df: DataFrame, session: str, seq: str) -> DataFrame:
    """The newest request of each session; older ones are superseded."""
    return df.groupBy(session).agg(F.max_by(F.struct(*[c for c in df.columns if c != session]), seq).alias("r")).select(session, "r.*")


def clip_status(requests: DataFrame, clips: DataFrame, audio: DataFrame, key: str = "audio_id") -> DataFrame:
    """Answer to each (audio_id, index): 404 unknown, 400 out of range, 200 ready, 204 empty clip, 202 not made yet.

    Clips carry idx and n_bytes, audio carries total. A negative index is out of range.
    """
    made = clips.groupBy(key).agg(F.count("*").alias("generated"))
    r = requests.join(audio.select(key, "total"), key, "left").join(made, key, "left")
    r = r.join(clips.select(key, F.col("idx").alias("index"), "n_bytes"), [key, "index"], "left")
    status = (
        F.when(F.col("total").isNull(), 404)
        .when((F.col("index") < 0) | (F.col("index") >= F.col("total")), 400)
        .when(F.col("n_bytes").isNull(), 202)
        .when(F.col("n_bytes") == 0, 204)
        .otherwise(200)
    )
    return r.select(*requests.columns, status.alias("status"), F.coalesce("generated", F.lit(0)).alias("generated"), "total")


def best_split(words: DataFrame, vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """Split each unknown word in two known ones where the rarer half is most frequent; the first such place wins.

    vocabulary has term and freq. Every place is one row, joined twice by term. Words without a split don't return.
    """
    cut = words.select(column, F.explode(F.sequence(F.lit(2), F.length(column) - 2)).alias("at")).filter(F.length(column) >= 4)
    cut = cut.withColumn("l", F.expr(f"substring({column}, 1, at)")).withColumn("r", F.expr(f"substring({column}, at + 1)"))
    half = lambda side: vocabulary.select(F.col("term").alias(side), F.col("freq").alias(f"{side}_freq"))
    both = cut.join(half("l"), "l").join(half("r"), "r").withColumn("score", F.least("l_freq", "r_freq"))
    best = F.max_by(F.struct("l", "r", "score"), F.struct(F.col("score"), -F.col("at")))
    return both.groupBy(column).agg(best.alias("b")).select(column, F.col("b.l").alias("left_word"), F.col("b.r").alias("right_word"), F.col("b.score").alias("score"))

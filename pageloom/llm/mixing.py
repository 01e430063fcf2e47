"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source of weight w must run its k-th block (from 0) in the slots from floor(k/w)
to ceil((k+1)/w) - 1. Weights are multiples of 1/PERIOD, so the schedule repeats
every PERIOD slots and one period, found by earliest deadline first among the
released blocks, is the schedule of any number of blocks. Many sources have a longer
period, SLOTS_EACH slots a source at least.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import stored

PERIOD, BLOCK_DOCS, ALPHA, ID_BITS = 1000, 16, 0.9, 10
SLOTS_EACH = 32


def whole_period(n_sources: int, period: int = PERIOD) -> int:
    """The least multiple of period with SLOTS_EACH slots a source: the slot that each gets at least bends no weight by more than 1/SLOTS_EACH of it."""
    return period * max(1, -(-n_sources * SLOTS_EACH // period))


def target_weights(sizes: DataFrame, period: int = PERIOD, alpha: float = ALPHA) -> DataFrame:
    """source, n, share: slots of each source in a period, in proportion to n^alpha by largest remainder, one at least.

    sizes has a row per source (column n); sources are configuration, not data, so they fit one array.
    """
    rows = F.array_sort(F.collect_list(F.struct("source", "n")))
    one = sizes.agg(rows.alias("s")).select("s", F.aggregate("s", F.lit(0.0), lambda a, x: a + F.pow(x["n"].cast("double"), F.lit(alpha))).alias("total"))
    quota = F.transform("s", lambda x, i: F.struct(i.alias("i"), x["source"].alias("source"), x["n"].alias("n"), (F.pow(x["n"].cast("double"), F.lit(alpha)) / F.col("total") * (period - F.size("s"))).alias("q")))
    one = one.select(quota.alias("q"))
    floors = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + F.floor(x["q"]) + 1)
    by_rest = F.array_sort(F.transform("q", lambda x: F.struct((F.floor(x["q"]) - F.round(x["q"], 9)).alias("rest"), x["i"].alias("i"))))
    one = one.select("q", F.transform(F.slice(by_rest, F.lit(1), F.greatest(F.lit(0), (F.lit(period) - floors).cast("int"))), lambda x: x["i"]).alias("plus"))
    each = F.transform("q", lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"), (F.floor(x["q"]) + 1 + F.array_contains("plus", x["i"]).cast("long")).alias("share")))
    return one.select(F.explode(each).alias("w")).select("w.*")


def period_schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """source, share, slot, k: the k-th block of source in a period goes to slot. Earliest deadline first, ties by name.

    The k-th blocks of sources with equal shares have one release and one deadline and run in order of name, so a step
    looks at one candidate for each distinct share. Slots are gathered in runs, as appending copies.
    """
    arr = weights.agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("w"))
    same = arr.select(F.posexplode("w").alias("i", "x")).groupBy(F.col("x.share").alias("share")).agg(F.array_sort(F.collect_list("i")).alias("m"))
    arr = arr.join(same.agg(F.array_sort(F.collect_list(F.struct("share", "m"))).alias("g")))
    run = math.isqrt(period) + 1
    due = f"""array_min(filter(transform(g, (x, j) -> struct(ceil((acc.done[j] div size(x.m) + 1) * {period} / x.share) as deadline, x.m[acc.done[j] % size(x.m)] as i, j as j,
          floor(acc.done[j] div size(x.m) * {period} / x.share) as release, acc.done[j] div size(x.m) < x.share as left)), y -> y.release <= t and y.left))"""
    steps = f"""aggregate(sequence(t0, least(t0 + {run}, {period}) - 1), struct(all.done as done, cast(array() as array<int>) as out), (acc, t) -> transform(array({due}),
        p -> struct(transform(acc.done, (n, j) -> if(j = p.j, n + 1, n)) as done, concat(acc.out, array(p.i)) as out))[0])"""
    step = f"""flatten(aggregate(sequence(0, {period} - 1, {run}), struct(transform(g, x -> 0L) as done, cast(array() as array<array<int>>) as out), (all, t0) -> transform(array({steps}),
        r -> struct(r.done as done, concat(all.out, array(r.out)) as out))[0]).out)"""
    slots = arr.select("w", F.posexplode(F.expr(step)).alias("slot", "p")).filter("p is not null")
    k = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    named = slots.select(F.expr("w[p].source").alias("source"), F.expr("w[p].share").alias("share"), F.col("slot").cast("long").alias("slot"))
    return named.withColumn("k", k.cast("long"))


def ranked(docs: DataFrame) -> DataFrame:
    """docs with place: the rank of a row in its source by doc_id, from 0, without a window over a whole source.

    Ranges of 2**ID_BITS ids are counted first; only their counts are summed along a source.
    """
    docs = docs.withColumn("_range", F.shiftright("doc_id", ID_BITS))
    counts = docs.groupBy("source", "_range").agg(F.count("*").alias("_n"))
    # two levels, so that no window sees more than a fraction of a source's ranges
    counts = counts.withColumn("_top", F.floor(F.col("_range") / 64))
    tops = counts.groupBy("source", "_top").agg(F.sum("_n").alias("_tn"))
    before = F.coalesce(F.sum("_tn").over(Window.partitionBy("source").orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.withColumn("_tb", before)
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("source", "_top").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_in", inner).join(tops.select("source", "_top", "_tb"), ["source", "_top"])
    starts = stored(starts.select("source", "_range", (F.col("_in") + F.col("_tb")).alias("_before")), "mix-ranges")
    local = F.row_number().over(Window.partitionBy("source", "_range").orderBy("doc_id", "_tie")) - 1
    rows = docs.withColumn("_local", local).join(starts, ["source", "_range"])
    return rows.withColumn("place", (F.col("_before") + F.col("_local")).cast("long")).drop("_range", "_local", "_before")


def schedule(docs: DataFrame, period: int = PERIOD, block_docs: int = BLOCK_DOCS, alpha: float = ALPHA, carry: bool = False) -> DataFrame:
    """doc_id, source, place, block, epoch, slot for every time that a document is drawn.

    Blocks of block_docs documents of a source, by doc_id, run in its slots. The mix ends with the slot in which the last
    source has run all its blocks once; sources done earlier start over (epoch 1, 2 ...), so every row is in the mix and
    each source's count of slots stays within one block of its weight. A null source is a source named ''. Rows without
    doc_id come first in their source, in the order of a hash of their columns, which also orders rows of one doc_id (a
    column _tie of docs does instead if there is one); repeated rows are rows of their own. With carry, row holds all
    columns of docs. The period is whole_period's, so no source is without slots.
    """
    whole = F.struct(*docs.columns).alias("row") if carry else None
    if "_tie" not in docs.columns:
        docs = docs.withColumn("_tie", F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind)))
    # rows without an id get numbers below all ids, spread so that no range holds them all
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.pmod(F.xxhash64("_tie"), F.lit(1 << 40)) - F.lit(1 << 62)).alias("doc_id"), F.col("doc_id").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("source"), "_tie", *([whole] if carry else []))
    sizes = stored(docs.groupBy("source").agg(F.count("*").alias("n")), "mix-sizes")
    period = whole_period(sizes.count(), period)
    weights = target_weights(sizes, period, alpha)
    plan = period_schedule(weights, period)
    blocks = sizes.withColumn("blocks", F.ceil(F.col("n") / block_docs)).drop("n")
    plan = plan.join(blocks, "source")
    last = F.floor((F.col("blocks") - 1) / F.col("share")) * period + F.col("slot")
    end = F.max(F.when((F.col("blocks") - 1) % F.col("share") == F.col("k"), last))
    plan = stored(plan.join(plan.agg(end.alias("end"))), "mix-plan")  # a row per slot of one period
    # draws of a source: its slots up to the end
    runs = F.floor((F.col("end") - F.col("slot")) / period) + 1
    drawn = plan.groupBy("source").agg(F.sum(F.when(F.col("slot") <= F.col("end"), runs).otherwise(0)).alias("draws"), F.first("blocks").alias("blocks"), F.first("share").alias("share"))
    drawn = stored(drawn, "mix-draws")
    rows = ranked(docs).withColumn("block", F.floor(F.col("place") / block_docs))
    rows = rows.join(F.broadcast(drawn), "source")  # a row per source
    epochs = F.ceil((F.col("draws") - F.col("block")) / F.col("blocks")).cast("long")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
    turn = F.col("epoch") * F.col("blocks") + F.col("block")
    rows = rows.withColumn("k", turn % F.col("share")).withColumn("cycle", F.floor(turn / F.col("share")))
    rows = rows.join(F.broadcast(plan.select("source", "k", "slot")), ["source", "k"])
    return rows.select(F.when(~F.col("_null"), F.col("doc_id")).alias("doc_id"), "source", "place", "block", "epoch", (F.col("cycle") * period + F.col("slot")).alias("slot"), *(["row"] if carry else []))

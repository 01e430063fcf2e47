"""Operators over the boxes of a page. Rows carry a page key and x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.geometry import contains_sql, iou_sql, overlaps


def _ranked(rows: list[str]) -> list[Column]:
    return [F.col(c) for c in rows]


def nms(df: DataFrame, page: str = "page_id", threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy non-maximum suppression, class-blind: a box stays unless it overlaps a better box that stayed.

    Order is score descending, then the whole box, so results don't depend on row order. One shuffle by page; the fold
    runs in the JVM. A page's boxes form one array, so a page is the unit of work.
    """
    fields = ["score", "x", "y", "w", "h", *carry]
    box = F.struct((-F.col("score")).alias("order"), *_ranked(fields[1:]), F.col("score").alias("score"))
    fold = f"aggregate(boxes, filter(boxes, b -> false), (acc, d) -> if(exists(acc, k -> {iou_sql('k', 'd')} > {threshold}D), acc, concat(acc, array(d))))"
    kept = df.groupBy(page).agg(F.array_sort(F.collect_list(box)).alias("boxes")).select(page, F.expr(fold).alias("kept"))
    return kept.select(page, F.posexplode("kept").alias("rank", "b")).select(page, "rank", *(F.col(f"b.{f}").alias(f) for f in fields))


def ocr_targets(df: DataFrame, page: str = "page_id", tol: int = 10) -> DataFrame:
    """Text boxes, and each bubble that holds no region already chosen, in rank order (columns rank, cls, x, y, w, h).

    The list grows while it is read, so a bubble chosen early blocks a later one around it.
    """
    fields = ["rank", "cls", "x", "y", "w", "h"]
    arr = F.array_sort(F.collect_list(F.struct(*_ranked(fields))))
    fold = (
        "aggregate(filter(boxes, b -> b.cls = 0), filter(boxes, b -> b.cls = 1),"
        f" (acc, b) -> if(exists(acc, t -> {contains_sql('b', 't', tol)}), acc, concat(acc, array(b))))"
    )
    picked = df.filter(F.col("cls").isin(0, 1)).groupBy(page).agg(arr.alias("boxes")).select(page, F.explode(F.expr(fold)).alias("b"))
    return picked.select(page, *(F.col(f"b.{f}").alias(f) for f in fields))


def exclude_overlapping(regions: DataFrame, taken: DataFrame, page: str = "page_id", margin: int = 20) -> DataFrame:
    """Regions that no taken box of the same page meets."""
    a, b = regions.alias("a"), taken.alias("b")
    near = (F.col(f"a.{page}") == F.col(f"b.{page}")) & overlaps(_Box("a"), _Box("b"), margin)
    return a.join(b, near, "left_anti")


class _Box:
    def __init__(self, alias: str):
        self.x, self.y, self.w, self.h = (F.col(f"{alias}.{f}") for f in "xywh")


ADJACENT = (
    "({b}.y - ({a}.y + {a}.h) <= 1.5D * {a}.h and ("
    "least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x) > 0.3D * least({a}.w, {b}.w)"
    " or abs(({a}.x + {a}.w / 2D) - ({b}.x + {b}.w / 2D)) < 0.7D * greatest({a}.w, {b}.w)))"
)


def group_lines(df: DataFrame, page: str = "page_id") -> DataFrame:
    """Merge neighbouring lines of a page: connected components of closeness, as one region each.

    Input: idx, text, conf, x, y, w, h. Output: group (smallest idx), n, text in top-down order, box, mean conf. A line
    joins every group that holds a line above it that is near; those groups become one.
    """
    item = F.struct(*_ranked(["y", "idx", "x", "w", "h", "text", "conf"]))
    near = f"exists(g, m -> {ADJACENT.format(a='m', b='l')})"
    fold = (
        "aggregate(lines, filter(array(lines), g -> false), (acc, l) ->"
        f" concat(filter(acc, g -> not {near}), array(array_sort(concat(flatten(filter(acc, g -> {near})), array(l))))))"
    )
    groups = df.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("lines")).select(page, F.explode(F.expr(fold)).alias("g"))
    low = lambda f: F.array_min(F.transform("g", lambda m: m[f]))
    high = lambda f, s: F.array_max(F.transform("g", lambda m: m[f] + m[s]))
    total = F.aggregate("g", F.lit(0.0), lambda acc, m: acc + m["conf"])
    return groups.select(
        page,
        low("idx").alias("group"),
        F.size("g").alias("n"),
        F.array_join(F.transform("g", lambda m: m["text"]), " ").alias("text"),
        low("x").alias("x"),
        low("y").alias("y"),
        (high("x", "w") - low("x")).alias("w"),
        (high("y", "h") - low("y")).alias("h"),
        (total / F.size("g")).alias("conf"),
    )


def reading_order(df: DataFrame, page: str = "page_id", band: Column | int = 200, direction: Column | str = "rtl", tie: str = "idx") -> DataFrame:
    """Add rank from 1: by band of top, then left (descending for rtl, ascending for all else), then tie.

    band is the height of a row of regions, in the unit of top times dpr.
    """
    rtl = (F.lit(direction) if isinstance(direction, str) else direction) == "rtl"
    dpr = F.col("dpr") if "dpr" in df.columns else F.lit(1.0)
    side = F.when(rtl, -F.col("left")).otherwise(F.col("left"))
    order = [F.floor(F.col("top") * dpr / band), side, F.col(tie)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(*order)))


def infer_crop(images: DataFrame, page: str = "page_id", view_w: int = 1280, view_h: int = 800) -> DataFrame:
    """Crop around the largest visible image and those in its column (columns left, top, width, height; none if too small).

    Images need left, top, width, height, dx, dy (see geometry.object_fit_offset) and el_idx.
    """
    c = F.col
    seen = images.filter((c("width") >= 100) & (c("height") >= 100) & (c("left") + c("width") >= 0) & (c("top") + c("height") >= 0) & (c("left") <= view_w) & (c("top") <= view_h))
    seen = seen.select(
        page, "el_idx", (c("width") * c("height")).alias("area"),
        (c("left") + c("dx")).alias("x1"), (c("left") + c("width") - c("dx")).alias("x2"),
        (c("top") + c("dy")).alias("y1"), (c("top") + c("height") - c("dy")).alias("y2"),
    )
    main = F.max_by(F.struct("x1", "x2", "y1", "y2"), F.struct(c("area"), -c("el_idx"))).over(Window.partitionBy(page))
    both = seen.withColumn("m", main)
    shared = F.greatest(F.lit(0.0), F.least(c("x2"), c("m.x2")) - F.greatest(c("x1"), c("m.x1")))
    column = both.withColumn("near", shared > 0.5 * F.least(c("x2") - c("x1"), c("m.x2") - c("m.x1")))
    pick = lambda f, agg: F.coalesce(agg(F.when(c("near"), c(f))), F.first(c(f"m.{f}")))
    out = column.groupBy(page).agg(pick("x1", F.min).alias("x1"), pick("y1", F.min).alias("y1"), pick("x2", F.max).alias("x2"), pick("y2", F.max).alias("y2"))
    out = out.withColumn("width", F.ceil(c("x2") - c("x1")) + 10).withColumn("height", F.ceil(c("y2") - c("y1")) + 10)
    out = out.filter((c("width") >= view_w * 0.2) & (c("height") >= view_h * 0.2))
    edge = lambda f: F.greatest(F.lit(0), F.floor(c(f)) - 5)
    return out.select(page, edge("x1").alias("left"), edge("y1").alias("top"), "width", "height")


def crop_lines(df: DataFrame, key: str = "crop_id", min_conf: float = 0.3, edge: float = 0.12) -> DataFrame:
    """One text per crop from its lines (text, conf, x, y, w, h in 0-1, origin at the bottom left).

    Dropped: single characters of low confidence, and fragments of up to three letters centred near an edge.
    """
    n_alpha = F.length(F.regexp_replace("text", "[^a-zA-Z]", ""))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    near = (cx < edge) | (cx > 1 - edge) | (cy < edge) | (cy > 1 - edge)
    noise = ((F.length("text") <= 1) & (F.col("conf") < min_conf)) | (near & (n_alpha <= 3))
    kept = df.filter((F.trim("text") != "") & ~noise)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("o"), F.col("x"), F.col("text"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(lines, lambda r: r["text"]), " ").alias("text"))

"""Composite plans: bubbles, free text, quality pass, page audio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom import models
from pageloom.functions import text as T
from pageloom.functions.geometry import is_dark, px_to_css, roi_pad
from pageloom.operators import boxes, pixels
from pageloom.operators.clean import clean_text
from pageloom.operators.state import cached


def placed(df: DataFrame) -> DataFrame:
    """left, top, width, height in CSS pixels and conf at three places, from x, y, w, h, score, dpr, off_x, off_y."""
    c = F.col
    return df.select(
        "page_id", "idx", "text", F.bround("score", 3).alias("conf"),
        px_to_css(c("x"), c("off_x"), c("dpr")).alias("left"), px_to_css(c("y"), c("off_y"), c("dpr")).alias("top"),
        px_to_css(c("w"), F.lit(0), c("dpr")).alias("width"), px_to_css(c("h"), F.lit(0), c("dpr")).alias("height"), "dpr",
    )


def bubbles(detections: DataFrame, texts: DataFrame, direction: str = "rtl", band: int = 200, min_score: float = 0.4) -> DataFrame:
    """Detections (page_id, cls, score, x, y, w, h) with their recognised texts, cleaned, judged and put in reading order.

    texts has page_id, x, y, w, h, text; the box is the key. A column logit there is the dialogue classifier's and drops
    what it rejects; without one, and where it is null, all stay. dpr 1 and no crop offset unless columns say so.
    """
    texts = texts.filter(models.is_dialogue(F.col("logit"))).drop("logit") if "logit" in texts.columns else texts
    kept = boxes.nms(detections.filter(F.col("score") >= min_score), carry=("cls",))
    targets = boxes.ocr_targets(kept).withColumnRenamed("rank", "idx")
    targets = targets.join(kept.select("page_id", F.col("rank").alias("idx"), "score"), ["page_id", "idx"])
    read = clean_text(targets.join(texts, ["page_id", "x", "y", "w", "h"]))
    judged = read.withColumn("quality", T.ocr_score(F.col("clean"))).filter(~((F.length("clean") > 4) & (F.col("quality") < 0)))
    judged = judged.filter("clean <> ''").withColumn("text", models.grammar_fix(F.col("clean")))
    for name, default in (("dpr", 1.0), ("off_x", 0), ("off_y", 0)):
        if name not in judged.columns:
            judged = judged.withColumn(name, F.lit(default))
    return boxes.reading_order(placed(judged), band=band, direction=direction)


def free_text(lines: DataFrame, taken: DataFrame, direction: str = "rtl", band: int = 200) -> DataFrame:
    """Recognised lines grouped to regions, less those over bubbles or junk, cleaned and put in reading order."""
    groups = boxes.group_lines(lines.filter((F.trim("text") != "") & (F.col("conf") >= 0.3)))
    free = boxes.exclude_overlapping(groups, taken).filter(~T.is_free_text_junk(F.col("text")))
    read = clean_text(free).withColumn("quality", T.ocr_score(F.col("clean")))
    kept = read.filter((F.col("quality") >= 0) & ~T.is_free_text_junk(F.col("clean")))
    out = kept.select("page_id", F.col("group").alias("idx"), F.col("clean").alias("text"), F.col("x").alias("left"), F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"), F.bround("conf", 3).alias("conf"))
    return boxes.reading_order(out, band=band, direction=direction)


def quality_pass(regions: DataFrame, second: DataFrame) -> DataFrame:
    """Regions that need a second look, with the second text where it is accepted.

    regions has page_id, idx, text, score; second has page_id, idx, text. Counts come from the column decision.
    """
    again = clean_text(second).select("page_id", "idx", F.col("clean").alias("new_text"))
    both = regions.join(again, ["page_id", "idx"], "left").withColumn("new_score", T.ocr_score(F.col("new_text")))
    need = T.needs_reocr(F.col("text"), F.col("score"))
    take = need & T.accept_upgrade(F.col("text"), F.col("score"), F.col("new_text"), F.col("new_score"))
    return both.select(
        "page_id", "idx", F.when(take, F.col("new_text")).otherwise(F.col("text")).alias("text"),
        F.when(take, "improved").when(need, "rerun").otherwise("skipped").alias("decision"),
    )


def page_audio(requests: DataFrame, cache: DataFrame, factory=None) -> DataFrame:
    """Spoken text and clip per request (text, voice, speed): cached clips are reused, each distinct miss is made once."""
    spoken = T.tts_prepare(requests).withColumn("speed", F.bround("speed", 4))
    keys = ["spoken", "voice", "speed"]
    known = cached(spoken, cache, keys, "wav")
    missing = known.filter("not hit").select(*keys).distinct().withColumn("made", models.speak(F.col("spoken"), factory))
    return known.join(missing, keys, "left").withColumn("wav", F.coalesce("wav", "made")).drop("made")


def region_crops(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (page_id, x, y, w, h) with their crop: cut from the page (page_id, page: grey crop), masked by its bubble where the column mask has one, black on white.

    dark says that the interior is dark. A target outside its page has a null crop.
    """

    def cut(page: pd.DataFrame, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for pix, pw, ph, a, b, c, d in zip(page["pixels"], page["w"], page["h"], x, y, w, h, strict=True):
            image = pixels.as_array(pix, pw, ph)
            part = None if image is None else image[max(0, b) : max(0, b + d), max(0, a) : max(0, a + c)]
            out.append((None, None, None) if part is None or not part.size else (part.tobytes(), part.shape[1], part.shape[0]))
        return pd.DataFrame(out, columns=["pixels", "w", "h"]).astype({"w": "Int32", "h": "Int32"})

    cut.__annotations__ = {"page": pd.DataFrame, "x": pd.Series, "y": pd.Series, "w": pd.Series, "h": pd.Series, "return": pd.DataFrame}
    c = F.col
    out = targets.join(pages.select("page_id", "page"), "page_id").withColumn("crop", F.pandas_udf(cut, pixels.CROP)("page", "x", "y", "w", "h")).drop("page")
    dark = is_dark(pixels.interior_intensity(c("crop"), F.floor(c("w") / 2).cast("int"), F.floor(c("h") / 2).cast("int")))
    out = out.withColumn("dark", dark)
    if "mask" in targets.columns:  # in the frame of the padded region
        pad = roi_pad(c("w"), c("h"))
        out = out.withColumn("crop", pixels.masked(c("crop"), c("mask"), F.least(c("x"), pad), F.least(c("y"), pad), c("dark"))).drop("mask")
    return out.withColumn("crop", pixels.inverted(c("crop"), c("dark")))


def free_text_due(pages: DataFrame, bubbles_found: DataFrame, wanted: bool = True) -> DataFrame:
    """Pages (page_id) that get a free-text pass: those without a bubble, if it is wanted at all."""
    return pages.join(bubbles_found.select("page_id"), "page_id", "left_anti").filter(F.lit(wanted))


def quality_counts(passed: DataFrame) -> DataFrame:
    """improved, rerun (all that were looked at again) and skipped of each page of quality_pass."""
    is_ = lambda d: F.count_if(F.col("decision") == d)
    return passed.groupBy("page_id").agg(is_("improved").alias("improved"), (is_("improved") + is_("rerun")).alias("rerun"), is_("skipped").alias("skipped"))


def single_speech(requests: DataFrame, cache: DataFrame, factory=None) -> DataFrame:
    """One clip a request (text, voice, speed), from the cache or made; the cache isn't filled, and a cached empty clip counts."""
    spoken = T.tts_prepare(requests).withColumn("speed", F.bround("speed", 4))
    known = cached(spoken, cache, ["spoken", "voice", "speed"], "wav")
    return known.withColumn("wav", F.when(F.col("hit"), F.col("wav")).otherwise(models.speak(F.col("spoken"), factory)))


def best_hypothesis(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The recogniser's best reading (text, conf) of each line; the first by text on a tie."""
    return candidates.groupBy(*keys).agg(F.min_by(F.struct("text", "conf"), F.struct(-F.col("conf"), F.col("text"))).alias("b")).select(*keys, "b.*")


def prefetch(clips: DataFrame, playing: DataFrame, ahead: int = 1, first: int = 2) -> DataFrame:
    """Clips (audio_id, idx, total) to fetch: the first ones before anything plays (current null), later the next ones."""
    p = clips.join(playing.select("audio_id", "current"), "audio_id", "left")
    wanted = F.when(F.col("current").isNull(), F.col("idx") < F.least(F.lit(first), F.col("total"))).otherwise(F.col("idx").between(F.col("current") + 1, F.col("current") + ahead))
    return p.filter(wanted).select("audio_id", "idx")

"""Crops, model boundary and the smaller operators, with stub models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom import models
from pageloom.functions import geometry as G
from pageloom.functions import text as T
from pageloom.operators import pixels, state
from pageloom.plans import pipelines
from pageloom.sources import readers

SCHEMA = f"i int, crop {pixels.CROP}"


def crops(spark, arrays):
    return spark.createDataFrame([(i, None if x is None else (bytearray(x.tobytes()), x.shape[1], x.shape[0])) for i, x in enumerate(arrays)], SCHEMA)


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_interior_and_inversion(spark):
    dark, light = np.full((60, 80), 20, np.uint8), np.full((60, 80), 240, np.uint8)
    light[25:35, 30:50] = 0  # text in the middle doesn't count
    df = crops(spark, [dark, light, None, np.zeros((1, 1), np.uint8)])
    df = df.withColumn("level", pixels.interior_intensity(F.col("crop"), F.lit(40), F.lit(30)))
    assert values(df, "level")[:3] == [20.0, 240.0, 230.0]
    flipped = values(df.withColumn("o", pixels.inverted(F.col("crop"), G.is_dark(F.col("level")))), "o")
    assert set(flipped[0].pixels) == {235} and bytes(flipped[1].pixels) == light.tobytes() and flipped[2] is None or flipped[2].pixels is None
    assert values(df.withColumn("g", pixels.mean_grey(F.col("crop"))), "g")[0] == 20.0


@pytest.mark.parametrize(("dx", "dy"), [(0, 0), (2, 1), (-3, -2), (50, 50)])
def test_mask_against_force(spark, dx, dy):
    r = np.random.default_rng(1)
    x, m = r.integers(1, 255, (7, 9), dtype=np.uint8), r.integers(0, 2, (8, 10), dtype=np.uint8)
    want = np.array([[x[i, j] if 0 <= i + dy < 8 and 0 <= j + dx < 10 and m[i + dy, j + dx] else 255 for j in range(9)] for i in range(7)], np.uint8)
    assert (pixels.on_background(x, m, dx, dy, 255) == want).all()
    df = crops(spark, [x]).withColumn("mask", F.struct(F.lit(bytearray(m.tobytes())).alias("pixels"), F.lit(10).alias("w"), F.lit(8).alias("h")))
    got = values(df.withColumn("o", pixels.masked(F.col("crop"), F.col("mask"), F.lit(dx), F.lit(dy), F.lit(False))), "o")[0]
    assert bytes(got.pixels) == want.tobytes()


def test_enhance():
    r = np.random.default_rng(2)
    for shape, side in (((40, 100), 330), ((350, 100), 555), ((500, 20), 530), ((3, 2), 330)):
        out = pixels.enhance(r.integers(90, 160, shape, dtype=np.uint8))
        assert max(out.shape) == side and (out[:15] == 255).all() and (out[:, -15:] == 255).all()
    flat = r.integers(100, 140, (320, 420), dtype=np.uint8)
    assert pixels.equalised(flat).std() > 1.3 * flat.std()
    grid = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (pixels.resized(grid, 3, 4) == grid).all()
    two = np.where(np.arange(40)[:, None] < 20, 30, 220) * np.ones((1, 30))
    assert set(np.unique(pixels.binarised(two.astype(np.uint8)))) == {0, 255}


def test_models(spark):
    page = np.full((50, 100), 200, np.uint8)
    df = crops(spark, [page, None])
    found = values(df.withColumn("d", models.detect(F.col("crop"), lambda: lambda x, w, h: [(1, 0, 0, w, h, float(x.shape == (3, 640, 640)))])), "d")
    assert [tuple(r) for r in found[0]] == [(1, 0.0, 0.0, 100.0, 50.0, 1.0)] and found[1] == []
    logit = models.classify(F.col("crop"), lambda: lambda x: float(x.mean() * 10) if x.shape == (1, 1, 128, 128) else None)
    assert values(df.withColumn("l", logit), "l")[0] == pytest.approx(2000 / 255, abs=1e-4)
    assert values(df.withColumn("k", models.is_dialogue(logit)), "k") == [True, True]

    def broken():
        def fail(_):
            raise ValueError

        return fail

    assert values(df.withColumn("k", models.is_dialogue(models.classify(F.col("crop"), broken))), "k") == [True, True]
    sides = values(df.withColumn("l", models.read_lines(F.col("crop"), lambda: lambda x: [("A", 0.5, 0.0, 0.0, float(x.shape[1]), float(x.shape[0]))])), "l")
    assert (sides[0][0].w, sides[0][0].h) == (150.0, 75.0)
    assert values(df.withColumn("t", models.read_fallback(F.col("crop"), lambda: lambda x: f" {x.shape[1]} ")), "t") == ["330", ""]
    assert values(df.withColumn("t", models.read_again(F.col("crop"), lambda: lambda x: [5, 6, 2, 9])), "t")[0] == [5, 6]
    assert models.health({"detector": False})["status"] == "loading" and models.health({"detector": True, "tts": False})["status"] == "ok"


def test_crops_of_a_page(spark):
    page = np.full((100, 200), 240, np.uint8)
    page[:, 100:] = 10
    pages = crops(spark, [page]).select(F.col("i").cast("long").alias("page_id"), F.col("crop").alias("page"))
    targets = spark.createDataFrame([(0, 10, 10, 60, 40), (0, 120, 10, 60, 40), (0, 500, 500, 10, 10)], "page_id long, x int, y int, w int, h int")
    got = {r.x: r for r in pipelines.region_crops(pages, targets).collect()}
    assert not got[10].dark and set(got[10].crop.pixels) == {240} and got[120].dark and set(got[120].crop.pixels) == {245}
    assert got[500].crop is None or got[500].crop.pixels is None


def test_plans(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    assert [r.page_id for r in pipelines.free_text_due(pages, pages.limit(1)).collect()] == [2] and pipelines.free_text_due(pages, pages.limit(0), False).count() == 0
    passed = spark.createDataFrame([(1, "improved"), (1, "rerun"), (1, "skipped"), (2, "skipped")], "page_id long, decision string")
    assert {tuple(r) for r in pipelines.quality_counts(passed).collect()} == {(1, 1, 2, 1), (2, 0, 0, 1)}
    c = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.1)], "line int, text string, conf double")
    assert [tuple(r) for r in pipelines.best_hypothesis(c, ["line"]).collect()] == [(1, "a", 0.5)]
    req = spark.createDataFrame([("HELLO", "v", 1.0), ("OTHER", "v", 1.0)], "text string, voice string, speed double")
    cache = spark.createDataFrame([("Hello", "v", 1.0, bytearray())], "spoken string, voice string, speed double, wav binary")
    got = {r.text: bytes(r.wav) for r in pipelines.single_speech(req, cache, lambda: lambda texts: [t.encode() for t in texts]).collect()}
    assert got == {"HELLO": b"", "OTHER": b"Other"}
    clips = spark.createDataFrame([(a, i, 4) for a in (1, 2) for i in range(4)], "audio_id int, idx int, total int")
    assert {tuple(r) for r in pipelines.prefetch(clips, spark.createDataFrame([(2, 1)], "audio_id int, current int")).collect()} == {(1, 0), (1, 1), (2, 2)}
    det = spark.createDataFrame([(1, 0, 0.9, 0, 0, 50, 50), (1, 0, 0.8, 200, 0, 50, 50)], "page_id long, cls int, score double, x int, y int, w int, h int")
    texts = spark.createDataFrame([(1, 0, 0, 50, 50, "HELLO THERE", -6.0), (1, 200, 0, 50, 50, "GO AWAY NOW", None)], "page_id long, x int, y int, w int, h int, text string, logit double")
    assert [r.text for r in pipelines.bubbles(det, texts).collect()] == ["GO AWAY NOW"]


def test_small_functions(spark, tmp_path):
    df = spark.createDataFrame([(0, "ab" * 60, bytearray(range(100)))], "i int, t string, w binary")
    import base64

    assert values(df.select("i", T.shown(F.col("t")).alias("o")), "o") == ["ab" * 40]
    assert values(df.select("i", T.audio_text(F.col("w")).alias("o")), "o") == [base64.b64encode(bytes(range(100))).decode()]
    one = lambda col: spark.range(1).select(col.alias("o")).first().o
    assert (one(T.length_scale(F.lit(2.0))), one(T.length_scale(F.lit(0.1)))) == (0.5, 2.0)
    assert (one(T.progress(F.lit(1), F.lit(3))), one(T.progress(F.lit(1), F.lit(0)))) == (33, None)
    assert one(T.numbered_listing(F.array(F.lit("a"), F.lit("b")))) == "[0] a\n[1] b"
    box = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))

    class Box:
        def __init__(self, c):
            self.c = c

        def __getattr__(self, f):
            return self.c[f]

        def __getitem__(self, f):
            return self.c[f]

        def isNotNull(self):
            return self.c.isNotNull()

    b = lambda *v: Box(box(*v))
    assert tuple(one(G.padded(b(2, 3, 10, 10), F.lit(5), F.lit(5), F.lit(14), F.lit(100)))) == (0, 0, 14, 18)
    assert tuple(one(G.aligned_overlap(b(0, 0, 10, 10), b(5, 6, 10, 10)))) == (5, 6, 5, 4) and one(G.aligned_overlap(b(0, 0, 5, 5), b(5, 0, 5, 5))) is None
    assert tuple(one(G.refined(b(0, 0, 10, 10), b(2, 2, 20, 6), F.lit(False)))) == (2, 2, 8, 6)
    assert tuple(one(G.refined(b(0, 0, 10, 10), b(2, 2, 3, 3), F.lit(False)))) == (0, 0, 10, 10)
    assert readers.settings(spark)["speed"] == "1.0"
    readers.write_log(str(tmp_path / "log"))(spark.createDataFrame([("hi",)], "msg string"), 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "log" / "batch=3")).collect()] == ["hi"]
    (tmp_path / "d.txt").write_text("the 5\ncat 2\n")
    assert {tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "d.txt")).collect()} == {("the", 5), ("cat", 2)}
    readers.write_clips(spark.createDataFrame([("k", 0, bytearray(b"x"))], "key string, idx int, wav binary"), str(tmp_path / "clips"))
    assert spark.read.parquet(str(tmp_path / "clips")).count() == 1
    assert readers.stage_times(spark).filter("ms >= 0").count() > 0
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "page_id int, idx int, text string")
    assert state.cached(old, old.limit(1).select("idx", F.lit("w").alias("wav")), ["idx"], "wav").filter("hit").count() == 1

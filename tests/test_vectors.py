"""Hand-traced vectors for the text and box operators."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import text as T
from pageloom.operators import boxes, state
from pageloom.operators.clean import cleaned
from pageloom.sources.readers import image_bytes, page_requests, vocabulary


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select(fn(F.col("t")).alias("o"), "i").orderBy("i").collect()]


def test_clean_text(spark):
    cases = {
        "DON ' T STOP NOW": "DON'T STOP NOW", "DON’T GO THERE": "DON'T GO THERE", "SOOO GOOD": "SOO GOOD", "- GUESS SO": "GUESS SO",
        "L, PERHAPS WE SHOULD": "PERHAPS WE SHOULD", "040120 THAT BRINGS": "THAT BRINGS", "BAKU- SAN IS HERE": "BAKUSAN IS HERE", "WAAAA": "",
        "HUH?!": "", "2212222": "", "1,200,000": "1,200,000", "READ THIS ONLY AT FOO": "", "WAIT 10 MINUTES": "WAIT 10 MINUTES",
        "I WANT 10 GO HOME": "", "A QUIET TOWN": "A QUIET TOWN", "": "", "HEH HEH": "", "GABA BA BA BA": "", "漢字 HELLO": "",
    }
    assert dict(zip(cases, run(spark, list(cases), cleaned), strict=True)) == cases
    assert run(spark, [None], cleaned) == [""]


def test_clean_text_is_ascii(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split("text", "\n")).alias("t"))
    assert lines.select(cleaned(F.col("t")).alias("o")).filter("o rlike '[^\\\\x00-\\\\x7F]'").count() == 0


def test_tts(spark):
    cases = {"6000": "six thousand", "1,200,000": "one million two hundred thousand", "2.50": "two.fifty", "THE 22nd DAY!!!": "The twenty-twoth day!", "WHAT?!": "What?"}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.spoken for r in T.tts_prepare(df).collect()} == cases


def test_emotion(spark):
    cases = {"STOP!": "shout", "what?!": "surprise", "well...": "trailing", "go?": "question", "Go!": "exclaim", "hello": "normal", "123!": "shout", "": "normal"}
    assert run(spark, list(cases), T.detect_emotion) == list(cases.values())


def test_ocr_score(spark):
    cases = {" ": -1.0, "1,200,000": 7.0, "NO!": -4.5, "HELLO THERE": 13.0, "A": -17.5}
    assert run(spark, list(cases), T.ocr_score) == list(cases.values())


@pytest.mark.parametrize(("n", "words"), [(0, "zero"), (13, "thirteen"), (21, "twenty-one"), (100, "one hundred"), (1005, "one thousand five"), (-7, "negative seven"), (999999999, "nine hundred ninety-nine million nine hundred ninety-nine thousand nine hundred ninety-nine")])
def test_num_to_words(spark, n, words):
    assert spark.range(1).select(T.num_to_words(F.lit(n))).first()[0] == words


def test_nms_counts_only_kept_boxes(spark):
    df = spark.createDataFrame([(1, 3, 0, 0, 10, 10), (1, 2, 5, 0, 10, 10), (1, 1, 9, 0, 10, 10)], "page_id long, score int, x int, y int, w int, h int")
    assert [r.x for r in boxes.nms(df).orderBy("rank").collect()] == [0, 9]


def test_targets_depend_on_rank(spark):
    schema = "page_id long, rank int, cls int, x int, y int, w int, h int"
    small, big = (0, 100, 100, 20, 20), (0, 90, 90, 100, 100)
    first = spark.createDataFrame([(1, 0, *small), (1, 1, *big), (2, 0, *big), (2, 1, *small)], schema)
    got = boxes.ocr_targets(first).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in got} == {1: 1, 2: 2}


def test_reading_order(spark):
    rows = [("a", 10.0, 50.0), ("b", 300.0, 60.0), ("c", 20.0, 250.0)]
    df = spark.createDataFrame([(1, i, n, x, y) for i, (n, x, y) in enumerate(rows)], "page_id long, idx int, name string, left double, top double")
    order = lambda d: "".join(r.name for r in boxes.reading_order(df, direction=d).orderBy("rank").collect())
    assert (order("rtl"), order("ltr"), order("vertical")) == ("bac", "abc", "abc")


def test_empty_runs(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 0, 0, 5, 0, 0, 0])], "k int, seq int, n int")
    got = state.empty_runs(df, "seq", "n", "k").orderBy("seq").collect()
    assert [r.run for r in got] == [0, 1, 2, 0, 1, 2, 3] and got[-1].action == "stop"


def test_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00"), (1, "2024-01-01 00:05"), (1, "2024-01-01 00:40")], "k int, t string").withColumn("ts", F.to_timestamp("t"))
    got = [(str(r.started)[11:16], str(r.ended)[11:16], r.n) for r in state.sessions(df, "k", "ts").orderBy("started").collect()]
    assert got == [("00:00", "00:15", 2), ("00:40", "00:50", 1)]


def test_keep_last_is_fifo(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "k string, seq int")
    assert {r.k for r in state.keep_last(df, "k", "seq", 2).collect()} == {"b", "c"}


def test_sources(spark):
    body = spark.createDataFrame([('{"image": "aGk="}',), ("{}",), ("no json",)], "body string")
    assert sorted(r.status for r in page_requests(body).collect()) == [200, 400, 400]
    got = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",)], "i string").select(image_bytes(F.col("i"))).collect()
    assert [bytes(r[0]) for r in got] == [b"hi", b"hi"]
    words = vocabulary(spark.createDataFrame([("# no",), (" a ",), ("A",), ("",)], "value string"))
    assert [r.word for r in words.collect()] == ["A"]


def test_dpr(spark):
    df = spark.createDataFrame([(None,), (0.5,), (3.0,)], "d double")
    assert [r[0] for r in df.select(G.sane_dpr(F.col("d"))).collect()] == [2.0, 2.0, 3.0]

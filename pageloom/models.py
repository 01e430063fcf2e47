"""Model boundary: detector, recognisers, classifier, grammar and speech as pandas UDFs.

A model is a function from a list of inputs to a list of outputs, made once per Python worker by a factory that the
caller gives. Without a factory an operator degrades: text stays as it is, every crop counts as dialogue, no clip is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from pageloom.operators import pixels


def model_udf(factory: Callable[[], Callable[[list], list]], returns: DataType | str) -> Callable[..., Column]:
    """A pandas UDF that calls factory() once per worker and then the model once per batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(model(batch.tolist()), index=batch.index)

    return F.pandas_udf(run, returns)


def recognise(crop: Column, primary: Callable[[], Callable], fallback: Callable[[], Callable] | None = None) -> Column:
    """Text by the primary model; by the fallback where that gives none."""
    text = F.nullif(F.trim(model_udf(primary, "string")(crop)), F.lit(""))
    return F.coalesce(text, F.trim(model_udf(fallback, "string")(crop)), F.lit("")) if fallback else F.coalesce(text, F.lit(""))


def is_dialogue(logit: Column, least: float = -5.0) -> Column:
    """Classifier decision; a missing logit keeps the crop."""
    return F.coalesce(logit > least, F.lit(True))


def grammar_fix(text: Column, factory: Callable[[], Callable] | None = None) -> Column:
    return F.coalesce(F.nullif(model_udf(factory, "string")(text), F.lit("")), text) if factory else text


def speak(text: Column, factory: Callable[[], Callable] | None = None) -> Column:
    return model_udf(factory, "binary")(text) if factory else F.lit(None).cast("binary")


#: Channel means and deviations of the detector's input.
DETECTOR_MEAN, DETECTOR_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
DETECTOR_SIDE, CLASSIFIER_SIDE, READER_SIDE = 640, 128, 768


def detector_input(grey: np.ndarray) -> np.ndarray:
    """A page as the detector takes it: 3 x 640 x 640, scaled to 0-1 and normalised by channel."""
    x = pixels.resized(grey, DETECTOR_SIDE, DETECTOR_SIDE).astype(np.float32) / 255
    return np.stack([(x - m) / d for m, d in zip(DETECTOR_MEAN, DETECTOR_STD, strict=True)])


def detect(crop: Column, factory: Callable[[], Callable]) -> Column:
    """Array of struct cls, x1, y1, x2, y2, score for each page; the model maps (input, width, height) to such rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = factory()
        for pdf in batches:
            pages = [pixels.as_array(*x) for x in zip(pdf["pixels"], pdf["w"], pdf["h"], strict=True)]
            names = ("cls", "x1", "y1", "x2", "y2", "score")
            yield pd.Series([[] if x is None else [dict(zip(names, (int(r[0]), *map(float, r[1:])), strict=True)) for r in model(detector_input(x), x.shape[1], x.shape[0])] for x in pages])

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<cls: int, x1: double, y1: double, x2: double, y2: double, score: double>>")(crop)


def crop_model(crop: Column, factory: Callable[[], Callable], returns: str, prepare: Callable[[np.ndarray], np.ndarray]) -> Column:
    """model(prepare(crop)) for each crop; null where there is none or the model fails on it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = factory()

        def one(x):
            try:
                return None if x is None else model(prepare(x))
            except Exception:  # a model that fails counts as missing for that crop
                return None

        for pdf in batches:
            yield pd.Series([one(pixels.as_array(*x)) for x in zip(pdf["pixels"], pdf["w"], pdf["h"], strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns)(crop)


def classify(crop: Column, factory: Callable[[], Callable]) -> Column:
    """Logit that a crop is dialogue, from 128 x 128 grey in 0-1."""
    return crop_model(crop, factory, "double", lambda x: (pixels.resized(x, CLASSIFIER_SIDE, CLASSIFIER_SIDE).astype(np.float32) / 255)[None, None])


def read_lines(crop: Column, factory: Callable[[], Callable], least_side: int = 150) -> Column:
    """Recognised lines (text, conf, x, y, w, h in 0-1 from the bottom left); a crop under least_side is made larger first."""

    def prepare(x):
        scale = least_side / max(x.shape)
        return pixels.resized(x, max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))) if scale > 1 else x

    return crop_model(crop, factory, "array<struct<text: string, conf: double, x: double, y: double, w: double, h: double>>", prepare)


def read_fallback(crop: Column, factory: Callable[[], Callable]) -> Column:
    """Text from the enhanced crop in black and white."""
    return F.trim(F.coalesce(crop_model(crop, factory, "string", lambda x: pixels.binarised(pixels.enhance(x))), F.lit("")))


def read_again(crop: Column, factory: Callable[[], Callable], max_tokens: int = 64, stop_id: int = 2) -> Column:
    """Ids of a slower reader on 768 x 768, at most max_tokens and none from the stop id on."""
    ids = crop_model(crop, factory, "array<int>", lambda x: pixels.resized(x, READER_SIDE, READER_SIDE))
    stop = F.array_position(ids, stop_id).cast("int")
    return F.slice(ids, F.lit(1), F.least(F.lit(max_tokens), F.when(stop > 0, stop - 1).otherwise(F.size(ids))))


def health(loaded: dict[str, bool]) -> dict[str, object]:
    """Status and which models are there: ok once the detector is, loading before."""
    return {"status": "ok" if loaded.get("detector") else "loading", "models": dict(sorted(loaded.items()))}

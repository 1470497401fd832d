"""Plug-in points for models: detectors, key-point detectors and embedders run over frames in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.schema import DETECTIONS, KEYPOINTS


class Detector(Protocol):
    def __call__(self, frames: pd.DataFrame) -> pd.DataFrame:
        """Frames (match_id, frame, image) to rows of DETECTIONS or KEYPOINTS."""


class Embedder(Protocol):
    def __call__(self, crops: pd.DataFrame) -> pd.Series:
        """Crops to one list of floats each."""


def _apply(frames: DataFrame, load: Callable[[], Detector], schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()  # once a task
        for part in parts:
            yield model(part)

    return frames.mapInPandas(run, schema)


def detect(frames: DataFrame, load: Callable[[], Detector], confidence: float = 0.3) -> DataFrame:
    return _apply(frames, load, DETECTIONS).filter(F.col("confidence") >= confidence)


def detect_keypoints(frames: DataFrame, load: Callable[[], Detector]) -> DataFrame:
    return _apply(frames, load, KEYPOINTS)


def embed(crops: DataFrame, load: Callable[[], Embedder], column: str = "embedding") -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*crops.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            yield part.assign(**{column: model(part)})

    return crops.mapInPandas(run, schema)

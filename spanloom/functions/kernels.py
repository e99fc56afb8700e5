"""Pixel kernels over frames in binary columns (numpy in Arrow batches) and pluggable classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAT_MIN, UNIFORM_MIN, BANDS, EDGE = 0.55, 0.70, (5, 12), 42.0
LAP_MIN, SMOOTH_MAX, MAD_MIN, NCC_MAX, TILE, SMOOTH_STD = 500.0, 0.10, 20.0, 0.12, 16, 12.0


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def bars_kernel(frame: np.ndarray) -> tuple[float, float, int, bool]:
    """Saturation, vertical uniformity, bands and verdict of a BGR frame (its upper 65 %)."""
    top = frame[: max(1, int(frame.shape[0] * 0.65))].astype(np.float32)
    high, low = top.max(axis=2), top.min(axis=2)
    s = np.where(high > 0, (high - low) / np.maximum(high, 1), 0)
    v = high / 255
    sat = float(s.mean())
    uniform = max(0.0, 1 - 2.5 * float((v.std(axis=0) + s.std(axis=0)).mean()))
    jumps = np.flatnonzero(np.abs(np.diff(top.mean(axis=0), axis=0)).sum(axis=1) > EDGE)
    bands = 2 + int((np.diff(jumps) > 2).sum()) if len(jumps) else 1
    return round(sat, 3), round(uniform, 3), bands, bool(sat >= SAT_MIN and uniform >= UNIFORM_MIN and BANDS[0] <= bands <= BANDS[1])


def snow_kernel(before: np.ndarray | None, frame: np.ndarray) -> tuple[float, float, float, float, bool]:
    """Laplacian variance, share of smooth tiles, mean difference, correlation and verdict of a gray pair."""
    g = np.pad(frame.astype(np.float64), 1, mode="reflect")
    lap = float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())
    h, w = frame.shape
    tiles = [frame[y : y + TILE, x : x + TILE].std() for y in range(0, h - TILE, TILE) for x in range(0, w - TILE, TILE)]
    smooth = sum(t < SMOOTH_STD for t in tiles) / max(1, len(tiles))
    mad, ncc = 0.0, 1.0
    if before is not None:
        a, b = before.astype(np.float64), frame.astype(np.float64)
        mad = float(np.abs(a - b).mean())
        a, b = a - a.mean(), b - b.mean()
        ncc = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()) + 1e-6))
    return round(lap, 1), round(smooth, 3), round(mad, 1), round(ncc, 3), bool(lap > LAP_MIN and smooth < SMOOTH_MAX and mad > MAD_MIN and ncc < NCC_MAX)


@F.pandas_udf(_struct(sat=T.DoubleType(), vert_uniform=T.DoubleType(), bands=T.IntegerType(), is_bars=T.BooleanType()))
def bars_score(frame: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if f is None else bars_kernel(np.frombuffer(f, np.uint8).reshape(h, w, 3)) for f, h, w in zip(frame, height, width)]
    return pd.DataFrame(rows, columns=["sat", "vert_uniform", "bands", "is_bars"])


@F.pandas_udf(_struct(lap=T.DoubleType(), smooth=T.DoubleType(), mad=T.DoubleType(), ncc=T.DoubleType(), is_snow=T.BooleanType()))
def snow_score(before: pd.Series, frame: pd.Series, size: pd.Series) -> pd.DataFrame:
    gray = lambda f, s: None if f is None else np.frombuffer(f, np.uint8).reshape(s, s)
    rows = [(None,) * 5 if f is None else snow_kernel(gray(b, s), gray(f, s)) for b, f, s in zip(before, frame, size)]
    return pd.DataFrame(rows, columns=["lap", "smooth", "mad", "ncc", "is_snow"])


def stub_classifier(pdf: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model: every row is ``other``."""
    return pdf.assign(label="other", description="")


def classify(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] = stub_classifier) -> DataFrame:
    """Rows labelled by a model in Arrow batches; a batch that the model fails on gets the defaults."""

    def run(batches):
        for pdf in batches:
            try:
                yield model(pdf)
            except Exception:  # a model's failure must not fail the job; rows keep default labels
                yield stub_classifier(pdf)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, label string, description string")

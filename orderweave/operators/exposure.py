"""Exposure of cameras, steered by the brightness of their frames.

A clamped recurrence: each frame's mean brightness says by which factor a camera's light should change, at most by `step`
either way. Longer exposure goes before gain, which counts in dB; what is darkened takes from the exposure first. Within
`tolerance` of the target nothing changes, nor where too much of the picture is bright (or dark) already to be made brighter (darker).

Input: camera, frame, mean, bright, dark (shares of values at either end). Output: camera, frame, exposure, gain, change
(steady, guarded, exposure, gain). The batch form walks through sorted cameras with `advance`, the stream keeps two numbers a camera.
A null mean changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "camera long, frame long, exposure double, gain double, change string"


@dataclass(frozen=True)
class Control:
    """Exposures in microseconds; a camera begins with `start` and `start_gain`. most_bright, most_dark: shares, or None for no guard."""

    target: float
    tolerance: float = 3.0
    step: float = 2.0
    least: float = 100.0
    most: float = 56_000.0
    least_gain: float = 0.0
    most_gain: float = 20.0
    start: float = 10_000.0
    start_gain: float = 0.0
    most_bright: float | None = None
    most_dark: float | None = None


def _within(value: float, least: float, most: float) -> float:
    return min(max(value, least), most)


def advance(c: Control, exposure: float, gain: float, mean: float | None, bright: float | None, dark: float | None) -> tuple[float, float, str]:
    """Exposure and gain after a frame, and what changed."""
    if mean is None or abs(c.target - mean) <= c.tolerance:
        return exposure, gain, "steady"
    guard, share = (c.most_bright, bright) if mean < c.target else (c.most_dark, dark)
    if guard and share is not None and share > guard:
        return exposure, gain, "guarded"
    ratio = _within(c.target / max(mean, 1e-3), 1 / c.step, c.step)
    longer = _within(exposure * ratio, c.least, c.most)
    if ratio > 1 and (exposure >= c.most or longer == exposure):
        return exposure, _within(gain + 20 * math.log10(ratio), c.least_gain, c.most_gain), "gain"
    return longer, gain, "exposure"


def _rows(frames: DataFrame) -> DataFrame:
    kinds = {"camera": "long", "frame": "long", "mean": "double", "bright": "double", "dark": "double"}
    return frames.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def steered(frames: DataFrame, control: Control) -> DataFrame:
    types = T.StructType.fromDDL(OUT)
    arrow = to_arrow_schema(types)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, exposure, gain = None, control.start, control.start_gain
        for batch in batches:
            out = []
            for camera, frame, *seen in zip(*(batch[c].to_pylist() for c in ("camera", "frame", "mean", "bright", "dark")), strict=True):
                if camera != now:
                    now, exposure, gain = camera, control.start, control.start_gain
                exposure, gain, change = advance(control, exposure, gain, *seen)
                out.append((camera, frame, exposure, gain, change))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return _rows(frames).repartition("camera").sortWithinPartitions("camera", "frame").mapInArrow(walked, types)


class _Steering(StatefulProcessor):
    def __init__(self, control: Control):
        self.control, self.names = control, T.StructType.fromDDL(OUT).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("steering", "exposure double, gain double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        exposure, gain = self.state.get() if self.state.exists() else (self.control.start, self.control.start_gain)
        out, row = [], Row(*self.names)
        for r in sorted(rows, key=lambda r: r["frame"]):
            exposure, gain, change = advance(self.control, exposure, gain, r["mean"], r["bright"], r["dark"])
            out.append(row(key[0], r["frame"], exposure, gain, change))
        self.state.update((exposure, gain))
        return iter(out)


def stream_steered(frames: DataFrame, control: Control) -> DataFrame:
    """The same over a stream; within a batch frames are put in order, batches follow each other. Needs streaming/runner.several_states."""
    return _rows(frames).groupBy("camera").transformWithState(_Steering(control), OUT, "append", "None")

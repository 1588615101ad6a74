"""Voice detection against a floor that adapts on quiet frames only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from loomline.operators.folds import Fold, folded

SEED, ALPHA, FACTOR = 50.0, 0.05, 2.5


def _detect(floor: float, frames: Iterator[tuple]) -> tuple[list[tuple], float]:
    out = []
    for key, level in frames:
        loud = level > floor * FACTOR
        if not loud:
            floor = (1 - ALPHA) * floor + ALPHA * level
        out.append((key, loud, floor))
    return out, floor


_FOLD = Fold("channel long, frame_id long, is_speech boolean, floor double", lambda: SEED, _detect)


def detect(frames: DataFrame) -> DataFrame:
    """``frames(frame_id, channel, at, level)``: speech and floor of each frame that has a level. The state of a channel is one number."""
    heard = frames.where("level is not null")
    return folded(heard, "channel", ["at", "frame_id"], ["frame_id", "level"], _FOLD).select("frame_id", "channel", "is_speech", "floor")

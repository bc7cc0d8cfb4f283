"""Choice among candidate masks by their scores and a motion model, and of the frames that a tracker remembers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.stateful import BoxFilter

# Fixed values of the published motion-aware tracker.
MOTION_WEIGHT, STABLE_FRAMES, STABLE_SCORE = 0.15, 15, 0.3
MEMORY_SCORE, MEMORY_OBJECT, MEMORY_MOTION = 0.5, 0.0, 0.0
MEMORIES = 6


def overlap(box: list[float], other: list[float]) -> float:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where both are empty."""
    inter = max(min(box[2], other[2]) - max(box[0], other[0]), 0.0) * max(min(box[3], other[3]) - max(box[1], other[1]), 0.0)
    both = max(0.0, (box[2] - box[0]) * (box[3] - box[1])) + max(other[2] - other[0], 0.0) * max(other[3] - other[1], 0.0) - inter
    return inter / both if both > 0 else 0.0


def centred(box: list[float]) -> list[float]:
    """x1, y1, x2, y2 as centre, aspect and height; a box without height has the aspect 0."""
    w, h = box[2] - box[0], box[3] - box[1]
    return [box[0] + w / 2, box[1] + h / 2, w / h if h else 0.0, h]


def best_of(scores: list[float]) -> int:
    """The first of the greatest scores; one that is NaN goes before all others, as in an array."""
    unknown = [i for i, s in enumerate(scores) if s != s]
    return unknown[0] if unknown else scores.index(max(scores))


def follow(frames: list[tuple[np.ndarray, np.ndarray]], weight: float = MOTION_WEIGHT, stable_frames: int = STABLE_FRAMES, least: float = STABLE_SCORE) -> list[tuple[int, float, int]]:
    """For each frame (scores, boxes of its candidates) the chosen one, its overlap with the prediction (NaN until it counts) and the stable frames so far.

    The best score wins until so many frames were stable, that is scored above ``least``; from then on the overlap with
    the motion model's prediction has its weight in the choice. A weak choice ends stability, and the
    next frame starts the model anew.
    """
    state, stable, out = None, 0, []
    for scores, boxes in frames:
        scores, boxes = np.asarray(scores, float).tolist(), np.asarray(boxes, float).tolist()
        motion = float("nan")
        if state is None or stable == 0:
            best, state, update = best_of(scores), BoxFilter(), True
            stable += 1
        else:
            state.predict()
            if stable < stable_frames:
                best = best_of(scores)
                update = scores[best] > least
                stable = stable + 1 if update else 0
            else:
                cx, cy, aspect, h = state.value
                expected = [cx - aspect * h / 2, cy - h / 2, cx + aspect * h / 2, cy + h / 2]
                motions = [overlap(expected, box) for box in boxes]
                best = best_of([weight * m + (1 - weight) * s for m, s in zip(motions, scores, strict=True)])
                motion, update = motions[best], scores[best] >= least
                stable = stable if update else 0
        if update and state.live:
            state.update(centred(boxes[best]))
        elif update:
            state.start(centred(boxes[best]))
        out.append((best, motion, stable))
    return out


def choose_masks(candidates: DataFrame, keys: list[str], **options) -> DataFrame:
    """keys, frame, nth, score, motion, stable: the candidate chosen in each frame of a series (follow()).

    candidates: keys, frame, nth, score, x1, y1, x2, y2; an empty mask has nulls for its box. Ties go to the first. A series is one group.
    """
    box = ["x1", "y1", "x2", "y2"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["frame", "nth"])
        at = frame["frame"].to_numpy()
        starts = np.nonzero(np.diff(at, prepend=at[0] - 1))[0]
        ends = np.append(starts[1:], len(at))
        scores, boxes = frame["score"].to_numpy(float), np.nan_to_num(frame[box].to_numpy(float))
        found = follow([(scores[a:b], boxes[a:b]) for a, b in zip(starts, ends, strict=True)], **options)
        rows = starts + np.array([best for best, _, _ in found])
        out = frame.iloc[rows][[*keys, "frame", "nth", "score"]].copy()
        out["motion"] = [motion for _, motion, _ in found]
        out["stable"] = [stable for _, _, stable in found]
        return out

    kinds = [f"{c} {candidates.schema[c].dataType.simpleString()}" for c in (*keys, "frame", "nth")]
    return candidates.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "score double, motion double, stable int"]))


def memory_frames(scores: DataFrame, keys: list[str], most: int = MEMORIES) -> DataFrame:
    """keys, frame, place, memory: the frames remembered at each frame, place 1 the latest.

    scores: keys, frame (from 0, without gaps), score, object, motion (null where there is none). Remembered are the last frames from
    the third on that were good by all their scores, and the one right before, whatever its scores; ``most`` in all.
    """
    good = (F.col("frame") > 1) & (F.col("score") > MEMORY_SCORE) & (F.col("object") > MEMORY_OBJECT) & (F.col("motion").isNull() | (F.col("motion") > MEMORY_MOTION))
    before = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    marked = scores.select(*keys, "frame", good.alias("__good"))
    marked = marked.withColumn("__upto", F.coalesce(F.count_if("__good").over(before), F.lit(0)))
    last = F.coalesce(F.lag("__good").over(Window.partitionBy(*keys).orderBy("frame")), F.lit(False))
    asked = marked.withColumn("__last", last).where("frame > 0")
    right_before = asked.select(*keys, "frame", F.lit(1).alias("place"), (F.col("frame") - 1).alias("memory"))
    number = F.col("__upto") - F.col("__last").cast("int")  # good frames before the one right before
    wanted = asked.withColumn("place", F.explode(F.sequence(F.lit(2), F.lit(most)))).withColumn("__n", number - F.col("place") + 1)
    kept = marked.where("__good").select(*keys, F.col("frame").alias("memory"), F.col("__upto").alias("__n"))
    return right_before.unionByName(wanted.where("__n >= 0").join(kept, [*keys, "__n"]).select(*keys, "frame", "place", "memory"))

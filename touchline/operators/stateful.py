"""Steps that fold over the frames of a session: possession, tracking, Kalman, spline and homography fits.

Each runs as one group for a session and segment, in frame order, because its state
carries over from frame to frame. Segments bound the size of a group.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Radii of possession, and below the noise weights of the published motion model.
CONTROL_METRES, CONTROL_HEIGHTS, CONTESTED_PIXELS, FLY_RADIUS = 2.5, 3.0, 80.0, 300.0

MOST_BOXES = 1 << 16  # boxes filtered at once


def possession_of(frames: list[tuple], scale: float) -> list[tuple[int, str, float, bool]]:
    """(player, state, confidence, has_ball) of each frame.

    frames: (ball, players) in order; ball is (x, y, tx, ty) or None, players a list of
    (track_id, foot x, foot y, box height, tx, ty), tx and ty NaN where unknown. A frame
    without ball or players has no player and leaves the state as it is.
    """
    steps, places, owners = deque(maxlen=5), deque(maxlen=10), deque(maxlen=3)
    current, stable, state = -1, 0, "controlled"
    out = []
    for ball, players in frames:
        places.append(ball[:2] if ball else None)
        owner = -1
        if ball and players:
            speed = 0.0
            if len(places) > 1 and places[-1] is not None and places[-2] is not None:
                steps.append(float(np.hypot(places[-1][0] - places[-2][0], places[-1][1] - places[-2][1])))
                speed = sum(steps) / len(steps)
            gaps = [(float(np.hypot(p[1] - ball[0], p[2] - ball[1])), p) for p in players]
            if speed > 30 * scale:
                state, best = "flying", 0.0
                if len(places) >= 3 and places[-3] is not None:
                    vx, vy = places[-1][0] - places[-3][0], places[-1][1] - places[-3][1]
                    length = float(np.hypot(vx, vy))
                    for gap, p in gaps:
                        if length >= 5 * scale and gap <= FLY_RADIUS * scale:
                            cos = (vx * (p[1] - ball[0]) + vy * (p[2] - ball[1])) / (length * gap) if gap else 0.0
                            score = cos * 1000 / (gap + 1)
                            if cos > 0.5 and score > best:
                                best, owner = score, p[0]
            elif speed > 15 * scale:
                state = "contested"
                near = [g for g in gaps if g[0] < int(CONTESTED_PIXELS * scale)]
                owner = min(near, key=lambda g: g[0])[1][0] if near else -1
            else:
                state, best = "controlled", 0.0
                for gap, p in gaps:
                    if not any(np.isnan([ball[2], ball[3], p[4], p[5]])):
                        metres = float(np.hypot(p[4] - ball[2], p[5] - ball[3]))
                        score = 100 / (metres + 0.01) if metres <= CONTROL_METRES else 0.0
                    else:
                        score = 100 / (gap + 1) if gap <= CONTROL_HEIGHTS * max(p[3], 1.0) else 0.0
                    if score > best:
                        best, owner = score, p[0]
                if owner == -1:
                    state = "loose_ball"
            owners.append(owner)
            if owner != -1 and len(owners) == 3 and len(set(owners)) == 1:
                stable = stable + 1 if owner == current else 3
                current = owner
            else:
                stable = stable + 1 if owner == current else 0
        confidence = 0.3 if stable < 3 else {"flying": 0.5, "controlled": 0.9}.get(state, 0.6)
        player = owner if not (ball and players) else current if current != -1 else owner
        has_ball = player != -1 and confidence > 0.3 and state == "controlled" and any(p[0] == player for p in players)
        out.append((player, state, confidence, has_ball))
    return out


def possession(tracks: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """keys, frame, player, state, confidence, has_ball, team (in control, 0 for none) of every frame of tracks.

    tracks: obj (ball or player), track_id, px, py, tx, ty, y1, y2, team.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = [frame[k].iloc[0] for k in keys]
        frames, numbers, teams = [], [], []
        for number, rows in frame.groupby("frame", sort=True):
            ball = rows[rows["obj"] == "ball"]
            people = rows[rows["obj"] == "player"].sort_values("track_id")
            spot = tuple(ball[["px", "py", "tx", "ty"]].iloc[0].astype(float)) if len(ball) else None
            height = (people["y2"] - people["y1"]).astype(float)
            frames.append((spot, list(zip(people["track_id"].astype(int), people["px"], people["py"], height, people["tx"], people["ty"], strict=True))))
            teams.append(dict(zip(people["track_id"].astype(int), people["team"].fillna(0).astype(int), strict=True)))
            numbers.append(number)
        found = possession_of(frames, scale)
        out = pd.DataFrame(found, columns=["player", "state", "confidence", "has_ball"])
        out["team"] = [t.get(p, 0) if held else 0 for t, (p, _, _, held) in zip(teams, found, strict=True)]
        out.insert(0, "frame", numbers)
        for at, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(at, name, value)
        return out

    kinds = [f"{k} {tracks.schema[k].dataType.simpleString()}" for k in keys]
    fields = [*kinds, "frame int", "player long", "state string", "confidence double", "has_ball boolean", "team int"]
    return tracks.groupBy(*keys).applyInPandas(run, ", ".join(fields))


def natural_fill(at: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Cubic spline through known points with not-a-knot ends; constant beyond them, linear for under four.

    Second derivatives come from one sweep over a tridiagonal system: the not-a-knot ends
    give the outer two from the next ones, so only the inner ones are unknown.
    """
    if len(known) < 4:
        return np.interp(at, known, values)
    h = np.diff(known)
    n = len(known)
    slope = np.diff(values) / h
    low, mid, high, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    high[0] -= h[0] * h[0] / h[1]
    mid[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    low[-1] -= h[-1] * h[-1] / h[-2]
    for i in range(1, n - 2):
        share = low[i] / mid[i - 1]
        mid[i] -= share * high[i - 1]
        rhs[i] -= share * rhs[i - 1]
    second = np.zeros(n)
    for i in range(n - 3, -1, -1):
        second[i + 1] = (rhs[i] - (high[i] * second[i + 2] if i < n - 3 else 0.0)) / mid[i]
    second[0] = ((h[0] + h[1]) * second[1] - h[0] * second[2]) / h[1]
    second[-1] = ((h[-2] + h[-1]) * second[-2] - h[-1] * second[-3]) / h[-2]
    x = np.clip(at, known[0], known[-1])
    k = np.clip(np.searchsorted(known, x, side="right") - 1, 0, n - 2)
    left, right, width = x - known[k], known[k + 1] - x, h[k]
    return (
        (second[k] * right**3 + second[k + 1] * left**3) / (6 * width)
        + (values[k] / width - second[k] * width / 6) * right
        + (values[k + 1] / width - second[k + 1] * width / 6) * left
    )


def spline_fill(ball: DataFrame, keys: list[str], columns: list[str], longest: int = 30) -> DataFrame:
    """Every frame of each series: gaps of at most ``longest`` frames by the spline, longer ones linearly, ends by the nearest.

    A short gap at an end takes the spline too, held at its last known value, which is the nearest as well.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame")
        at = np.arange(frame["frame"].min(), frame["frame"].max() + 1)
        out = pd.DataFrame({"frame": at})
        for c in columns:
            some = frame[frame[c].notna()]
            known, values = some["frame"].to_numpy(float), some[c].to_numpy(float)
            if not len(known):
                out[c] = np.nan
                continue
            line, curve = np.interp(at, known, values), natural_fill(at.astype(float), known, values)
            k = np.clip(np.searchsorted(known, at, side="right"), 1, max(1, len(known) - 1))
            gap = known[k] - known[k - 1] - 1 if len(known) > 1 else np.full(len(at), longest + 1.0)
            out[c] = np.where(gap <= longest, curve, line)
        for i, k in enumerate(keys):
            out.insert(i, k, frame[k].iloc[0])
        return out

    kinds = [f"{k} {ball.schema[k].dataType.simpleString()}" for k in keys]
    return ball.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "frame int", *(f"{c} double" for c in columns)]))


def kalman_path(boxes: np.ndarray, position: float = 1 / 20, velocity: float = 1 / 160) -> tuple[np.ndarray, np.ndarray]:
    """kalman_paths() of one series."""
    path, gate = kalman_paths(boxes[None], position, velocity)
    return path[0], gate[0]


def kalman_paths(boxes: np.ndarray, position: float = 1 / 20, velocity: float = 1 / 160) -> tuple[np.ndarray, np.ndarray]:
    """Filtered (cx, cy, aspect, height) of measured boxes (series, frames, 4), and squared Mahalanobis distances.

    Missing boxes are NaN. Constant velocity with noise in proportion to the height, as in
    SORT-type trackers. All series take a step at once.
    """
    return filter_boxes(boxes, None, position, velocity)[:2]


def filter_boxes(boxes: np.ndarray, state: tuple | None = None, position: float = 1 / 20, velocity: float = 1 / 160) -> tuple[np.ndarray, np.ndarray, tuple]:
    """kalman_paths() from a state (means, covariances, whether a box has been seen) on, and the state after it."""
    n, frames, _ = boxes.shape
    move = np.eye(8)
    move[:4, 4:] = np.eye(4)
    out, gate = np.full((n, frames, 4), np.nan), np.full((n, frames), np.nan)
    mean, cov, live = (x.copy() for x in state) if state else (np.zeros((n, 8)), np.zeros((n, 8, 8)), np.zeros(n, bool))
    diagonal = np.arange(8)

    def spread(h: np.ndarray, at: float, of: float, aspect: float, turn: float) -> np.ndarray:
        one = np.ones_like(h)
        return np.square(np.stack([at * h, at * h, aspect * one, at * h, of * h, of * h, turn * one, of * h], axis=1))

    for i in range(frames):
        seen = ~np.isnan(boxes[:, i]).any(axis=1)
        own = np.nonzero(live)[0]
        if len(own):
            noise = spread(mean[own, 3], position, velocity, 1e-2, 1e-5)
            mean[own] = mean[own] @ move.T
            moved = move @ cov[own] @ move.T
            moved[:, diagonal, diagonal] += noise
            cov[own] = moved
        own = np.nonzero(live & seen)[0]
        if len(own):
            z, m, p = boxes[own, i], mean[own], cov[own]
            s = p[:, :4, :4].copy()
            s[:, diagonal[:4], diagonal[:4]] += spread(m[:, 3], position, velocity, 1e-1, 1e-5)[:, :4]
            gain = np.linalg.solve(s, p[:, :4]).transpose(0, 2, 1)
            off = z - m[:, :4]
            gate[own, i] = (off * np.linalg.solve(s, off[:, :, None])[:, :, 0]).sum(axis=1)
            mean[own] = m + (gain @ off[:, :, None])[:, :, 0]
            cov[own] = p - gain @ s @ gain.transpose(0, 2, 1)
        new = np.nonzero(~live & seen)[0]
        if len(new):
            z = boxes[new, i]
            mean[new, :4], mean[new, 4:] = z, 0.0
            cov[new] = 0.0
            first = spread(z[:, 3], 2 * position, 10 * velocity, 1e-2, 1e-5)
            cov[new[:, None], diagonal, diagonal] = first
            gate[new, i], live[new] = 0.0, True
        out[live, i] = mean[live, :4]
    return out, gate, (mean, cov, live)


HEIGHT_NOISE = (True, True, False, True)  # which measures have noise in proportion to the height


class BoxFilter:
    """filter_boxes() of one series, a step at a time and in plain numbers, which are faster than arrays of eight.

    All noise is diagonal, so the four measures never mix: each has its value, velocity and own covariance (of the value, of both, of the velocity).
    """

    def __init__(self, position: float = 1 / 20, velocity: float = 1 / 160):
        self.position, self.velocity = position, velocity
        self.value: list[float] = []
        self.speed, self.cov = [0.0] * 4, [(0.0, 0.0, 0.0)] * 4

    @property
    def live(self) -> bool:
        """Whether a box has been seen."""
        return len(self.value) > 0

    def _noise(self, h: float, position: float, velocity: float, aspect: float) -> list[tuple[float, float]]:
        """Variances of value and velocity of each measure."""
        tall, flat = ((position * h) ** 2, (velocity * h) ** 2), (aspect**2, 1e-5**2)
        return [tall if by_height else flat for by_height in HEIGHT_NOISE]

    def predict(self) -> None:
        noise = self._noise(self.value[3], self.position, self.velocity, 1e-2)
        self.value = [x + v for x, v in zip(self.value, self.speed, strict=True)]
        self.cov = [((a + b) + (b + c) + p, b + c, c + q) for (a, b, c), (p, q) in zip(self.cov, noise, strict=True)]

    def start(self, box: list[float]) -> None:
        self.value, self.speed = list(box), [0.0] * 4
        self.cov = [(p, 0.0, q) for p, q in self._noise(box[3], 2 * self.position, 10 * self.velocity, 1e-2)]

    def update(self, box: list[float]) -> float:
        """The squared Mahalanobis distance of the box, which the filter takes in. A measure that is certain and has no noise moves by nothing, nor does it count."""
        noise, gate = self._noise(self.value[3], self.position, self.velocity, 1e-1), 0.0
        for i, (z, (a, b, c), (r, _)) in enumerate(zip(box, self.cov, noise, strict=True)):
            s = a + r
            if s == 0:
                continue
            off, k, g = z - self.value[i], a / s, b / s
            gate += off * (off / s)
            self.value[i] += k * off
            self.speed[i] += g * off
            self.cov[i] = (a - k * s * k, b - k * s * g, c - g * s * g)
        return gate

    def step(self, box: list[float]) -> float:
        """predict() and update(), or start() at the first box; a box with NaN is none. The distance, NaN without a box."""
        if self.live:
            self.predict()
        if any(z != z for z in box):
            return float("nan")
        if self.live:
            return self.update(box)
        self.start(box)
        return 0.0


NUMBERS = 20  # of a filter: four values, four velocities, four times three of covariance


class KalmanSeries:
    """kalman_paths() of one series, a part of its frames at a time; frame and numbers() are all it remembers."""

    def __init__(self):
        self.frame, self.own = -1, BoxFilter()

    @staticmethod
    def of(frame: int, numbers: list[float]) -> KalmanSeries:
        """The series that had this frame and numbers()."""
        series = KalmanSeries()
        series.frame = frame
        if numbers[0] == numbers[0]:
            series.own.value, series.own.speed = list(numbers[:4]), list(numbers[4:8])
            series.own.cov = [tuple(numbers[k : k + 3]) for k in range(8, NUMBERS, 3)]
        return series

    def numbers(self) -> list[float]:
        """The filter's numbers; NaN before a box has been seen."""
        own = self.own
        return [*own.value, *own.speed, *(x for cov in own.cov for x in cov)] if own.live else [float("nan")] * NUMBERS

    def follow(self, frames: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered boxes and distances at ascending frames after the last one; frames between them are steps without a box."""
        own, path, gate, nothing = self.own, [], [], [float("nan")] * 4
        for frame, box in zip(np.asarray(frames).tolist(), np.asarray(boxes, float).tolist(), strict=True):
            for _ in range(frame - self.frame - 1 if own.live else 0):
                own.predict()
            gate.append(own.step(box))
            path.append(own.value[:] if own.live else nothing)
            self.frame = frame
        return np.array(path, float).reshape(-1, 4), np.array(gate, float)


def kalman_track(measures: DataFrame, keys: list[str], group_rows: int = 1 << 18) -> DataFrame:
    """keys, frame, cx, cy, aspect, h filtered, gate, for dense series of measures with nulls where there is none.

    Series are dealt by hash into groups of about group_rows rows, as many as the rows ask for, and those
    of a group of like length filtered together, a bounded number of boxes at once.
    """
    groups = max(int(measures.sparkSession.conf.get("spark.sql.shuffle.partitions")), measures.count() // group_rows)
    columns = ["cx", "cy", "aspect", "h"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*keys, "frame"]).reset_index(drop=True)
        number = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        starts = np.nonzero(np.diff(number, prepend=-1))[0]
        lengths = np.diff(np.append(starts, len(frame)))
        values = frame[columns].to_numpy(float)
        path, gate = np.full((len(frame), 4), np.nan), np.full(len(frame), np.nan)
        order, low = np.argsort(lengths, kind="stable"), 0
        while low < len(order):
            high = low + 1
            while high < len(order) and lengths[order[high]] * (high + 1 - low) <= MOST_BOXES:
                high += 1
            own = order[low:high]
            stack = np.full((len(own), lengths[own[-1]], 4), np.nan)
            for k, j in enumerate(own):
                stack[k, : lengths[j]] = values[starts[j] : starts[j] + lengths[j]]
            found, gates = kalman_paths(stack)
            for k, j in enumerate(own):
                rows = slice(starts[j], starts[j] + lengths[j])
                path[rows], gate[rows] = found[k, : lengths[j]], gates[k, : lengths[j]]
            low = high
        out = frame[[*keys, "frame"]].copy()
        for i, c in enumerate(columns):
            out[c] = path[:, i]
        out["gate"] = gate
        return out

    kinds = [f"{k} {measures.schema[k].dataType.simpleString()}" for k in keys]
    dealt = measures.withColumn("__deal", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    fields = ", ".join([*kinds, "frame int", *(f"{c} double" for c in columns), "gate double"])
    return dealt.groupBy("__deal").applyInPandas(lambda frame: run(frame.drop(columns="__deal")), fields)


def greedy_tracks(detections: DataFrame, keys: list[str], least_iou: float = 0.3, patience: int = 30) -> DataFrame:
    """detections (frame, x1, y1, x2, y2, conf) with a track_id from greedy overlap with the tracks of earlier frames."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["frame"].notna()].sort_values(["frame", "conf", "x1", "y1"], ascending=[True, False, True, True]).reset_index(drop=True)
        numbers, places = frame["frame"].to_numpy(), frame[["x1", "y1", "x2", "y2"]].to_numpy(float)
        starts = np.append(np.nonzero(np.append(True, numbers[1:] != numbers[:-1]))[0], len(numbers)) if len(numbers) else np.zeros(1, int)
        # The live tracks, by number: where each was last seen, and when.
        tracks, last, seen = np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros(0, numbers.dtype)
        found, next_id = np.zeros(len(frame), np.int64), 1
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            stay = numbers[low] - seen <= patience
            tracks, last, seen, boxes = tracks[stay], last[stay], seen[stay], places[low:high]
            size = np.minimum(boxes[:, None, 2:], last[:, 2:]) - np.maximum(boxes[:, None, :2], last[:, :2])
            both = np.maximum(size[..., 0], 0.0) * np.maximum(size[..., 1], 0.0)
            i, j = np.nonzero(both > 0 if least_iou > 0 else both >= 0)  # most do not meet
            own, other, both = boxes[i], last[j], both[i, j]
            whole = (own[:, 2] - own[:, 0]) * (own[:, 3] - own[:, 1]) + (other[:, 2] - other[:, 0]) * (other[:, 3] - other[:, 1]) - both
            share = both / np.where(whole > 0, whole, 1.0)
            near = (whole > 0) & (share >= least_iou)
            i, j, share = i[near], j[near], share[near]
            best = np.lexsort((tracks[j], i, -share))
            ids, used = np.zeros(len(boxes), np.int64), set()
            for box, track in zip(i[best].tolist(), j[best].tolist(), strict=True):
                if not ids[box] and track not in used:
                    ids[box] = tracks[track]
                    used.add(track)
                    last[track], seen[track] = boxes[box], numbers[low]
            new = np.nonzero(ids == 0)[0]
            ids[new] = np.arange(next_id, next_id + len(new))
            next_id += len(new)
            tracks, last = np.append(tracks, ids[new]), np.concatenate([last, boxes[new]])
            seen = np.append(seen, np.full(len(new), numbers[low]))
            found[low:high] = ids
        return frame.assign(track_id=found)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in detections.schema if f.name != "track_id"]
    return detections.groupBy(*keys).applyInPandas(run, ", ".join([*fields, "track_id long"]))


def fit_homography(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Plane mapping (x, y) to (u, v), nine entries, the last 1, by least squares on normalised points."""

    def norm(a, b):
        scale = np.sqrt(2) / max(1e-9, float(np.hypot(a - a.mean(), b - b.mean()).mean()))
        return np.array([[scale, 0, -scale * a.mean()], [0, scale, -scale * b.mean()], [0, 0, 1]])

    s, t = norm(x, y), norm(u, v)
    p, q = s @ np.stack([x, y, np.ones_like(x)]), t @ np.stack([u, v, np.ones_like(u)])
    rows = []
    for (a, b, _), (c, d, _) in zip(p.T, q.T, strict=True):
        rows += [[a, b, 1, 0, 0, 0, -c * a, -c * b, -c], [0, 0, 0, a, b, 1, -d * a, -d * b, -d]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    h = np.linalg.inv(t) @ h @ s
    return (h / h[2, 2]).ravel()


def homographies(points: DataFrame, keys: list[str], least: int = 6, error: float = 500.0, inliers: float = 0.5, order: str = "frame") -> DataFrame:
    """keys, order, h0 to h8 for each frame with enough spread-out keypoints (x, y to u, v in centimetres), by seeded consensus."""

    def one(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray | None:
        if len(x) < least or np.ptp(u) <= 3000 or np.ptp(v) <= 1500:
            return None
        rng, best = np.random.default_rng(42), np.zeros(len(x), bool)
        for _ in range(50):
            four = rng.choice(len(x), 4, replace=False)
            h = fit_homography(x[four], y[four], u[four], v[four]).reshape(3, 3)
            mapped = h @ np.stack([x, y, np.ones_like(x)])
            off = np.hypot(mapped[0] / mapped[2] - u, mapped[1] / mapped[2] - v)
            if (off < error).sum() > best.sum():
                best = off < error
            if best.all():  # no other four can agree with more
                break
        if best.mean() < inliers or best.sum() < 4:
            return None
        return fit_homography(x[best], y[best], u[best], v[best])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        numbers = frame[order].to_numpy()
        starts = np.append(np.nonzero(np.diff(numbers, prepend=numbers[0] - 1))[0], len(frame))
        columns = [frame[c].to_numpy(float) for c in ("x", "y", "u", "v")]
        found = [(low, one(*(c[low:high] for c in columns))) for low, high in zip(starts[:-1], starts[1:], strict=True)]
        found = [(low, h) for low, h in found if h is not None]
        out = frame.loc[[low for low, _ in found], [*keys, order]].reset_index(drop=True)
        held = np.array([h for _, h in found]).reshape(-1, 9)
        return out.assign(**{f"h{i}": held[:, i] for i in range(9)})

    kinds = [f"{k} {points.schema[k].dataType.simpleString()}" for k in (*keys, order)]
    return points.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, *(f"h{i} double" for i in range(9))]))

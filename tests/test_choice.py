"""The motion-aware choice of masks against a textbook filter, step by step."""

import numpy as np

from touchline.operators import choice


class Textbook:
    """The eight-dimensional constant velocity filter, one matrix equation a line."""

    def __init__(self, z):
        h = z[3]
        self.x = np.r_[z, 0, 0, 0, 0].astype(float)
        self.p = np.diag(np.square([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]))

    def predict(self):
        a, h = np.eye(8) + np.eye(8, k=4), self.x[3]
        self.p = a @ self.p @ a.T + np.diag(np.square([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]))
        self.x = a @ self.x

    def update(self, z):
        c, h = np.eye(4, 8), self.x[3]
        s = c @ self.p @ c.T + np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))
        k = self.p @ c.T @ np.linalg.inv(s)
        self.x, self.p = self.x + k @ (z - c @ self.x), self.p - k @ s @ k.T


def textbook(frames, weight, needed, least):
    model, stable, out = None, 0, []
    for scores, boxes in frames:
        z = [[(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]] for b in boxes]
        if stable == 0:
            best = int(np.argmax(scores))
            model, stable = Textbook(np.array(z[best])), 1
        else:
            model.predict()
            if stable < needed:
                best = int(np.argmax(scores))
                if scores[best] > least:
                    model.update(np.array(z[best]))
                    stable += 1
                else:
                    stable = 0
            else:
                cx, cy, a, h = model.x[:4]
                p = [cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2]
                both = []
                for b, s in zip(boxes, scores, strict=True):
                    w, t = min(p[2], b[2]) - max(p[0], b[0]), min(p[3], b[3]) - max(p[1], b[1])
                    inter = max(w, 0) * max(t, 0)
                    union = (p[2] - p[0]) * (p[3] - p[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
                    both.append(weight * inter / union + (1 - weight) * s)
                best = int(np.argmax(both))
                if scores[best] < least:
                    stable = 0
                else:
                    model.update(np.array(z[best]))
        out.append((best, stable))
    return out


def test_choice_follows_the_motion():
    rng = np.random.default_rng(4)
    seen = set()
    for _ in range(20):
        frames = []
        for k in range(60):
            at = np.array([3.0 * k, 50, 3.0 * k + 20, 90]) + rng.normal(0, 1, 4)
            frames.append((rng.uniform(0.1, 1, 3), np.stack([at, at + [40, 0, 40, 0], at + rng.uniform(-15, 15)])))
        got = choice.follow(frames, 0.25, 5, 0.3)
        assert [(b, s) for b, _, s in got] == textbook(frames, 0.25, 5, 0.3)
        seen |= {b != int(np.argmax(f[0])) for f, (b, _, _) in zip(frames, got, strict=True)}
    assert seen == {True, False}  # the motion decides some frames


def test_empty_masks_and_single_candidates(spark):
    rows = [(1, f, n, 0.9 - 0.2 * n, None if n == 0 and f == 3 else 10.0 + f, 5.0, 20.0 + f, 30.0) for f in range(8) for n in range(2 if f else 1)]
    table = spark.createDataFrame(rows, "session_id long, frame int, nth int, score double, x1 double, y1 double, x2 double, y2 double")
    found = choice.choose_masks(table, ["session_id"], stable_frames=3).orderBy("frame").collect()
    assert [r["frame"] for r in found] == list(range(8)) and all(r["nth"] == 0 for r in found)
    assert choice.choose_masks(table.limit(0), ["session_id"]).count() == 0


def test_an_empty_first_mask_is_no_error():
    """A box without height has no noise either, so its filter is certain; the frame after a weak one starts it anew."""
    box = np.array([[10.0, 5, 30, 55]])
    frames = [(np.array([0.9]), np.zeros((1, 4)))] + [(np.array([0.9 if k != 3 else 0.1]), box) for k in range(9)]
    assert [(b, s) for b, _, s in choice.follow(frames, stable_frames=3)] == [(0, s) for s in (1, 2, 3, 3, 0, 1, 2, 3, 3, 3)]

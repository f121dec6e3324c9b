"""Motion of subjects in clips: flow between neighbouring grey frames, less what the camera does.

Points with texture are followed from frame to frame by pyramidal least-squares matching (Lucas and Kanade), all points of a pair side by side in numpy. The camera is the
shift, turn and scale that most points agree on, found over sampled pairs of points and refitted on those that agree. What the points that deviate most, a quarter of
them, deviate by on average is the pair's residual in pixels: a shaky pan over a still scene comes out near 0, a subject that crosses it doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .media import next_frames


@dataclass(frozen=True)
class Flow:
    points: int = 150
    #: Least texture as a share of the strongest, pixels between points, half a matching window, halvings, and steps at each.
    texture: float = 0.01
    spacing: int = 8
    reach: int = 7
    halvings: int = 3
    steps: int = 12
    #: Grey levels by which a followed point's window may differ on average; more is a point lost, as when it is covered.
    alike: float = 16.0
    #: Points a pair needs, tried camera motions, and the deviation up to which a point agrees with one.
    least: int = 6
    tries: int = 256
    agrees: float = 3.0


def _halved(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
    return (x[:h:2, :w:2] + x[1:h:2, :w:2] + x[:h:2, 1:w:2] + x[1:h:2, 1:w:2]) / 4


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over windows of 2 r + 1."""
    s = np.pad(np.pad(x, r).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]


def textured(image: np.ndarray, p: Flow = Flow()) -> np.ndarray:
    """(y, x) of points whose surroundings vary in both directions: the best of each square of `spacing`, the best of those first."""
    gy, gx = np.gradient(image)
    a, b, c = _box(gx * gx, 3), _box(gx * gy, 3), _box(gy * gy, 3)
    least = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    s = p.spacing
    h, w = image.shape[0] // s, image.shape[1] // s
    if not h or not w:
        return np.zeros((0, 2))
    squares = least[: h * s, : w * s].reshape(h, s, w, s).transpose(0, 2, 1, 3).reshape(h * w, s * s)
    at, best = squares.argmax(1), squares.max(1)
    good = np.flatnonzero(best > max(p.texture * best.max(), 1e-9))
    good = good[np.argsort(-best[good], kind="stable")][: p.points]
    return np.stack([good // w * s + at[good] // s, good % w * s + at[good] % s], 1).astype(float)


def _sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels; the border goes on beyond itself."""
    y, x = np.clip(y, 0, image.shape[0] - 1.001), np.clip(x, 0, image.shape[1] - 1.001)
    i, j = y.astype(np.int64), x.astype(np.int64)
    fy, fx = y - i, x - j
    return (image[i, j] * (1 - fx) + image[i, j + 1] * fx) * (1 - fy) + (image[i + 1, j] * (1 - fx) + image[i + 1, j + 1] * fx) * fy


def follow(before: np.ndarray, after: np.ndarray, points: np.ndarray, p: Flow = Flow()) -> tuple[np.ndarray, np.ndarray]:
    """Where points (y, x) of one image lie in the next, and which of them were found."""
    pairs = [(before, after)]
    while len(pairs) <= p.halvings and min(pairs[-1][0].shape) >= 8 * p.reach:
        pairs.append(tuple(_halved(x) for x in pairs[-1]))
    oy, ox = (o.ravel() for o in np.mgrid[-p.reach : p.reach + 1, -p.reach : p.reach + 1])
    move, ok = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(pairs) - 1, -1, -1):
        a, b = pairs[level]
        y, x = (points[:, [i]] / 2**level + o for i, o in ((0, oy), (1, ox)))
        gy, gx = np.gradient(a)
        here, gy, gx = _sample(a, y, x), _sample(gy, y, x), _sample(gx, y, x)
        yy, xy, xx = (gy * gy).sum(1), (gy * gx).sum(1), (gx * gx).sum(1)
        det = yy * xx - xy * xy
        flat = det <= 1e-9
        ok &= ~flat | (level > 0)
        det = np.where(flat, 1, det)
        own = move / 2**level
        for _ in range(p.steps):
            gap = here - _sample(b, y + own[:, [0]], x + own[:, [1]])
            ey, ex = (gap * gy).sum(1), (gap * gx).sum(1)
            step = np.stack([(xx * ey - xy * ex) / det, (yy * ex - xy * ey) / det], 1)
            step[flat] = 0
            own += np.clip(step, -p.reach, p.reach)
            if np.abs(step).max(initial=0) < 0.01:
                break
        move = own * 2**level
    to, edge = points + move, np.array(before.shape) - 1 - p.reach
    for at in (points, to):  # windows that reach over the border match what isn't there
        ok &= ((at >= p.reach) & (at <= edge)).all(1)
    return to, ok & (np.abs(gap).mean(1) <= p.alike)


def deviations(a: np.ndarray, b: np.ndarray, p: Flow = Flow()) -> np.ndarray:
    """How far points a -> b are from the camera's shift, turn and scale; their whole way where no two points agree on one. Points are complex numbers here, so
    a camera is w = s z + t."""
    z, w = a[:, 1] + 1j * a[:, 0], b[:, 1] + 1j * b[:, 0]
    rng = np.random.default_rng(0)  # the same for every pair, so a task that runs again gives the same
    i = rng.integers(0, len(z), p.tries)
    j = (i + rng.integers(1, len(z), p.tries)) % len(z)
    apart = np.abs(z[i] - z[j]) > 1
    i, j = i[apart], j[apart]
    if not len(i):
        return np.abs(w - z)
    s = (w[i] - w[j]) / (z[i] - z[j])
    t = w[i] - s * z[i]
    agree = np.abs(s[:, None] * z + t[:, None] - w) <= p.agrees
    best = agree[agree.sum(1).argmax()]
    for _ in range(3):
        if best.sum() < 3:
            return np.abs(w - z)
        zc, wc = z[best].mean(), w[best].mean()
        spread = (np.abs(z[best] - zc) ** 2).sum()
        s = ((w[best] - wc) * np.conj(z[best] - zc)).sum() / spread if spread > 0 else 1.0
        gap = np.abs(s * (z - zc) + wc - w)
        best = gap <= p.agrees
    return gap


def residual(before: np.ndarray, after: np.ndarray, p: Flow = Flow()) -> float:
    """Pixels that subjects move by between two grey images; 0 where too few points can be followed."""
    before, after = before.astype(float), after.astype(float)
    points = textured(before, p)
    if len(points) < p.least:
        return 0.0
    to, ok = follow(before, after, points, p)
    if ok.sum() < p.least:
        return 0.0
    gap = np.sort(deviations(points[ok], to[ok], p))
    return float(gap[-max(1, len(gap) // 4) :].mean())


def motion(frames: DataFrame, p: Flow = Flow()) -> DataFrame:
    """(path, t, px) of each grey frame but a clip's first: frames(path, t, h, w, pixels) -> the residual from the frame before. A frame of
    another size than the one before, or whose bytes aren't h x w, gives 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = []
            for h, w, old, new in zip(b["h"], b["w"], b["before"], b["pixels"], strict=True):
                same = old is not None and new is not None and len(old) == len(new) == h * w
                px.append(residual(*(np.frombuffer(x, np.uint8).reshape(h, w) for x in (old, new)), p) if same else 0.0)
            yield pd.DataFrame({"path": b["path"], "t": b["t"], "px": px})

    return next_frames(frames, size=True).repartition("path", "t").mapInPandas(run, "path string, t double, px double")

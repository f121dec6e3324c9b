"""Flow on images whose motion is known, and from a stub tool's clip to its energy."""

import numpy as np
import pytest
from lumenreel.operators import energy
from lumenreel.sources import media, motion


def scene(h, w, seed=0):
    """Smooth noise, so that shifts by fractions of a pixel can be drawn."""
    rng = np.random.default_rng(seed)
    f = np.fft.fft2(rng.normal(size=(h, w)))
    y, x = np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij")
    return np.fft.ifft2(f * np.exp(-((y * y + x * x) * 400))).real, (f * np.exp(-((y * y + x * x) * 400)), y, x)


def shifted(spectrum, dy, dx):
    f, y, x = spectrum
    return np.fft.ifft2(f * np.exp(-2j * np.pi * (y * dy + x * dx))).real


def grey(x, low, high):
    return np.clip((x - low) / (high - low) * 255, 0, 255)


@pytest.mark.parametrize("dy, dx", [(0, 0), (0.4, -0.7), (3, 5), (-11, 8.5)])
def test_known_shifts_are_recovered(dy, dx):
    a, f = scene(160, 220)
    b = shifted(f, dy, dx)
    lo, hi = a.min(), a.max()
    a, b = grey(a, lo, hi), grey(b, lo, hi)
    points = motion.textured(a)
    inner = (points[:, 0] > 30) & (points[:, 0] < 130) & (points[:, 1] > 30) & (points[:, 1] < 190)
    to, ok = motion.follow(a, b, points[inner])
    assert ok.sum() > 20
    off = np.abs(to[ok] - points[inner][ok] - [dy, dx]).max(1)
    assert np.median(off) < 0.1 and (off < 0.5).mean() > 0.9
    assert motion.residual(a, b) < 1.5  # a pan is the camera's


def test_a_subject_stands_out():
    a, f = scene(160, 220)
    subject, g = scene(160, 220, 1)
    lo, hi = a.min(), a.max()

    def frame(step):
        out = grey(shifted(f, 1.0 * step, 2.0 * step), lo, hi)
        at = 60 + 9 * step
        out[50:110, at : at + 70] = grey(subject, lo, hi)[50:110, 60:130]
        return out

    still, moving = motion.residual(grey(a, lo, hi), grey(shifted(f, 1, 2), lo, hi)), motion.residual(frame(0), frame(1))
    assert moving > 3 and moving > 5 * still


def test_camera_of_turn_and_scale():
    rng = np.random.default_rng(3)
    a = rng.random((80, 2)) * 200
    z = (a[:, 1] + 1j * a[:, 0]) * 1.05 * np.exp(0.1j) + (7 - 3j)
    b = np.stack([z.imag, z.real], 1)
    b[:20] += 40
    gap = motion.deviations(a, b)
    assert gap[20:].max() < 1e-6 and np.allclose(gap[:20], 40 * 2**0.5)


def test_nothing_to_follow():
    assert motion.residual(np.full((64, 64), 9), np.full((64, 64), 200)) == 0.0
    assert motion.residual(np.zeros((4, 4)), np.zeros((4, 4))) == 0.0


PROBE = """#!{python}
import json
print(json.dumps({{"streams": [{{"width": 220, "height": 160}}], "format": {{"duration": "1.0"}}}}))
"""
DECODE = """#!{python}
import sys
with open({path!r}, "rb") as f:
    sys.stdout.buffer.write(f.read())
"""


def test_from_clip_to_energy(spark, tmp_path):
    import sys

    a, f = scene(160, 220)
    lo, hi = a.min(), a.max()
    subject = grey(scene(160, 220, 1)[0], lo, hi)
    frames = []
    for step in range(5):
        out = grey(shifted(f, step, 2 * step), lo, hi)
        out[50:110, 40 + 9 * step : 110 + 9 * step] = subject[50:110, 60:130]
        frames.append(out.astype(np.uint8).tobytes())
    (tmp_path / "raw").write_bytes(b"".join(frames))
    for name, text in (("ffprobe", PROBE), ("ffmpeg", DECODE)):
        (tmp_path / name).write_text(text.format(python=sys.executable, path=str(tmp_path / "raw")))
        (tmp_path / name).chmod(0o755)
    pictures = media.pictures(spark, ["/a.mov"], fps=4.0, side=320, gray=True, tools=str(tmp_path))
    got = motion.motion(pictures)
    px = {r.t: r.px for r in got.collect()}
    assert sorted(px) == [0.25, 0.5, 0.75, 1.0] and min(px.values()) > 3
    want = np.mean(sorted(px.values())[-1:])
    assert abs(energy.upper_mean(got, "path", "px").first().px - want) < 1e-9
    levels = energy.grid(spark.createDataFrame([], "path string, sec int, db double"), got, "path").orderBy("sec").collect()
    assert levels[0].level > 0 and energy.score(energy.grid(spark.createDataFrame([], "path string, sec int, db double"), got, "path"), "path").first().score > 0
    odd = spark.createDataFrame([("/b", 0.0, 2, 2, bytearray(4)), ("/b", 1.0, 2, 2, bytearray(3)), ("/c", 0.0, 2, 2, bytearray(4))], "path string, t double, h int, w int, pixels binary")
    assert [(r.path, r.px) for r in motion.motion(odd).collect()] == [("/b", 0.0)]

"""Clip metrics against plain loops."""

import hashlib
import math
import struct

import numpy as np
import pytest

from quern.operators import clips

T, C, H, W = SHAPE = (3, 2, 5, 6)


def at(x, t, c, y, z):
    return x[t, c, y, z] if 0 <= y < H and 0 <= z < W else 0.0


def plain(a, b, valid, threshold, dilation):
    def mean(f, mask):
        total = weight = 0.0
        for t in range(T):
            for c in range(C):
                for y in range(H):
                    for x in range(W):
                        m = mask(t, y, x)
                        total, weight = total + m * f(t, c, y, x), weight + m
        return total / max(weight, 1.0)

    v = lambda t, y, x: valid[t, y, x]
    error = lambda t, c, y, x: abs(a[t, c, y, x] - b[t, c, y, x])

    def box(f, t, c, y, x):
        return sum(f(t, c, y + i, x + j) for i in range(-3, 4) for j in range(-3, 4)) / 49

    def structure(t, c, y, x):
        p, q = (lambda *i: at(a, *i)), (lambda *i: at(b, *i))
        mp, mq = box(p, t, c, y, x), box(q, t, c, y, x)
        vp = box(lambda *i: p(*i) ** 2, t, c, y, x) - mp**2
        vq = box(lambda *i: q(*i) ** 2, t, c, y, x) - mq**2
        cov = box(lambda *i: p(*i) * q(*i), t, c, y, x) - mp * mq
        return (2 * mp * mq + 1e-4) * (2 * cov + 9e-4) / max((mp**2 + mq**2 + 1e-4) * (vp + vq + 9e-4), 1e-8)

    def sobel(k, t, c, y, x):
        across = sum(w * (at(k, t, c, y + i, x + 1) - at(k, t, c, y + i, x - 1)) for i, w in ((-1, 1), (0, 2), (1, 1)))
        down = sum(w * (at(k, t, c, y + 1, x + i) - at(k, t, c, y - 1, x + i)) for i, w in ((-1, 1), (0, 2), (1, 1)))
        return across, down

    def edge(t, c, y, x):
        return sum(abs(p - q) for p, q in zip(sobel(a, t, c, y, x), sobel(b, t, c, y, x), strict=True))

    half = dilation // 2
    hit = lambda t, y, x: 0 <= y < H and 0 <= x < W and sum(abs(b[t, c, y, x] - b[0, c, y, x]) for c in range(C)) / C > threshold
    moving = lambda t, y, x: float(t > 0 and any(hit(t, y + i, x + j) for i in range(-half, half + 1) for j in range(-half, half + 1)))
    step = lambda k, t, c, y, x: k[t, c, y, x] - k[t - 1, c, y, x]
    return {
        "l1": mean(error, v),
        "psnr": -10 * math.log10(max(mean(lambda *i: error(*i) ** 2, v), 1e-12)),
        "ssim": mean(structure, v),
        "edge_l1": mean(edge, v),
        "temporal_l1": mean(lambda t, *i: abs(step(a, t, *i) - step(b, t, *i)) if t else 0.0, lambda t, y, x: v(t, y, x) * (t > 0)),
        "foreground_l1": mean(error, lambda *i: moving(*i) * v(*i)),
        "background_l1": mean(error, lambda *i: (1 - moving(*i) * v(*i)) * v(*i)),
        "charbonnier": mean(lambda *i: math.sqrt(error(*i) ** 2 + 1e-6), v),
    }


@pytest.mark.parametrize("masked", [False, True])
def test_metrics_equal_plain_loops(spark, masked):
    rng = np.random.default_rng(3)
    made = [(rng.random(SHAPE), rng.random(SHAPE) * 0.2 + 0.4, (rng.random((T, H, W)) > 0.3).astype(float)) for _ in range(4)]
    rows = [(i, a.ravel().tolist(), b.ravel().tolist(), m.ravel().tolist()) for i, (a, b, m) in enumerate(made)]
    df = spark.createDataFrame(rows, "clip_id int, prediction array<double>, target array<double>, ok array<double>").repartition(2)
    out = clips.reconstruction_metrics(df, SHAPE, valid="ok" if masked else None, threshold=0.15, dilation=3)
    for r in out.collect():
        a, b, m = made[r.clip_id]
        want = plain(a, b, m if masked else np.ones((T, H, W)), 0.15, 3)
        assert {k: r[k] for k in want} == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert clips.reconstruction_metrics(df.limit(0), SHAPE).count() == 0


def test_a_clip_of_another_size_is_an_error(spark):
    df = spark.createDataFrame([(1, [0.0] * 7, [0.0] * 7)], "clip_id int, prediction array<double>, target array<double>")
    with pytest.raises(Exception, match="does not have 8 numbers"):
        clips.reconstruction_metrics(df, (2, 1, 2, 2)).collect()


def test_letterbox_and_back(spark):
    frame = np.arange(24.0).reshape(4, 6)
    made, mask = clips.letterboxed(frame, (8, 20))
    assert mask.sum() == 8 * 12 and mask[:, 4:16].all() and not made[:, :4].any()
    small, mask = clips.letterboxed(frame, (2, 8))
    assert small[:, 2:5].tolist() == [[frame[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range(3)] for y in range(2)]
    assert [clips.letterboxed(np.zeros((2, 5)), (9, 1), half_up=h)[1].sum() for h in (False, True)] == [1, 1]
    # Growing twofold and restoring keeps a plane but for its border.
    big, _ = clips.letterboxed(frame, (8, 12))
    assert np.allclose(clips.restored(big, (0, 0, 12, 8), (4, 6))[1:-1, 1:-1], frame[1:-1, 1:-1])
    df = spark.createDataFrame([(1, 4, 6, frame.ravel().tolist())], "frame_id int, height int, width int, values array<double>")
    row = clips.fitted(df, (2, 8)).first()
    assert np.allclose(row["values"], small.ravel()) and row["mask"] == mask.ravel().tolist()


def test_content_hash_is_of_little_endian_bytes(spark):
    values = [1.5, -2.0, 0.25, 3.0]
    want = hashlib.sha256(struct.pack("<qq", 2, 2) + struct.pack("<4f", *values)).hexdigest()
    df = spark.createDataFrame([(1, values), (2, [1.0]), (3, None)], "k int, v array<float>")
    assert {r.k: (r["rows"], r.content_sha256) for r in clips.content_hashes(df, 2, id_col="k", values="v").collect()} == {
        1: (2, want),
        2: (None, None),
        3: (None, None),
    }

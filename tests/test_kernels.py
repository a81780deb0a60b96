import numpy as np
import pytest

from orthoframe.estimators import estimator
from orthoframe.functions import kernels, rings


def test_warp_moves_and_interpolates():
    image = np.arange(30, dtype=float).reshape(5, 6)
    assert (kernels.warp(image, np.eye(3), 5, 6) == image).all()
    moved = kernels.warp(image, [[1, 0, 2], [0, 1, 1], [0, 0, 1]], 5, 6)
    assert (moved[:4, :4] == image[1:, 2:]).all() and (moved[4] == 0).all() and (moved[:, 4:] == 0).all()
    half = kernels.warp(image, [[1, 0, 0.5], [0, 1, 0], [0, 0, 1]], 5, 6)
    assert np.allclose(half[:, :5], image[:, :5] + 0.5) and np.allclose(half[:, 5], image[:, 5] / 2)
    part = kernels.warp(image, [[0.9, 0.2, 1], [0.1, 1.1, 0], [0.01, 0, 1]], 5, 6)
    assert np.allclose(kernels.warp(image, [[0.9, 0.2, 1], [0.1, 1.1, 0], [0.01, 0, 1]], 2, 3, 3, 2), part[3:5, 2:5])


def test_semi_global_finds_a_shift():
    dice = np.random.default_rng(1)
    left = dice.random((40, 60))
    right = np.roll(left, -5, axis=1)
    d, valid = kernels.semi_global(left, right, 0, 10)
    inner = d[5:-5, 12:-12]
    assert np.nanmedian(np.abs(inner - 5)) < 0.5 and valid[:, 12:].all() and np.isnan(d[~valid]).all()


def test_sgm_estimator_scales_and_fills():
    dice = np.random.default_rng(2)
    left = dice.random((20, 24, 1)).repeat(3, axis=2).repeat(6, axis=0).repeat(6, axis=1)
    right = np.roll(left, -12, axis=1)  # two small pixels
    d, valid = estimator("SGM", low=0, high=4)(left, right)
    assert d.shape == left.shape[:2] == valid.shape
    assert np.median(np.abs(d[24:-24, 36:-24] - 12)) < 3
    assert (d[valid == 0] == -192).all()
    assert estimator("SGM", low=0, high=4)(left[:-1, :-2], right[:-1, :-2])[0].shape == (119, 142)
    with pytest.raises(ValueError, match="unknown"):
        estimator("other")


def plain_components(mask):
    seen, out = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if seen[start]:
            continue
        out += 1
        todo = [start]
        seen[start] = out
        while todo:
            y, x = todo.pop()
            for v in range(max(y - 1, 0), min(y + 2, mask.shape[0])):
                for u in range(max(x - 1, 0), min(x + 2, mask.shape[1])):
                    if mask[v, u] and not seen[v, u]:
                        seen[v, u] = out
                        todo.append((v, u))
    return seen, out


def test_components_and_morphology():
    dice = np.random.default_rng(3)
    for density in (0.2, 0.4, 0.6):
        mask = dice.random((30, 25)) < density
        labels, n = kernels.components(mask)
        want, m = plain_components(mask)
        assert n == m and len({*zip(labels.ravel().tolist(), want.ravel().tolist(), strict=True)}) == n + 1
    valid = np.ones((40, 40), bool)
    valid[2:4, 2:4] = False  # a speck of four: becomes valid
    valid[10:20, 10:20] = False
    valid[14, 14] = True  # a small hole in it: becomes invalid
    out = kernels.clean_mask(valid)
    assert out[2:4, 2:4].all() and not out[10:20, 10:20].any()


def test_attention_and_hole_filling():
    dice = np.random.default_rng(4)
    att = kernels.attend(dice.random((3, 6, 6)))
    assert np.allclose(att.sum(axis=-1), 1) and (np.triu(att[0], 1) == 0).all()
    valid = np.ones((3, 6), bool)
    valid[1, 2:4] = False
    d = kernels.regress(att, valid)
    first = np.arange(6) - att @ np.arange(6.0)
    assert np.allclose(d[valid], first[valid])
    assert d[1, 2] == pytest.approx(first[1, 1] / 1.0001) and d[1, 3] == pytest.approx(d[1, 2] / 1.0001)
    assert kernels.received(att).shape == (3, 6)


def test_resize_and_costs():
    image = np.arange(12.0).reshape(3, 4)
    assert np.allclose(kernels.resize(image, 3, 4), image)
    assert np.allclose(kernels.resize(np.full((3, 4), 2.5), 7, 9), 2.5)
    assert np.allclose(kernels.resize(image, 6, 8).reshape(3, 2, 4, 2).mean(axis=(1, 3))[1, 1:3], image[1, 1:3])
    q = np.random.default_rng(1).random((2, 5, 3))
    assert np.allclose(kernels.parallax_cost(q, q)[1, 2, 4], q[1, 2] @ q[1, 4] / 3)
    assert np.allclose(kernels.parallax_cost(q, q, np.ones((2, 5, 5))), kernels.parallax_cost(q, q) + 1)


def test_rings():
    square = np.array([(0, 0), (0, 4), (4, 4), (4, 0)], float)
    tilted = np.array([(2, -1), (5, 2), (2, 5), (-1, 2)], float)
    assert abs(rings.signed_area(rings.clip(square, tilted))) == pytest.approx(14)
    assert abs(rings.signed_area(rings.erode(square, 1))) == pytest.approx(4)
    assert not len(rings.erode(square, 3))
    assert rings.intersects(square, square + 4) and not rings.intersects(square, square + 4.1)
    assert not rings.intersects(square, np.empty((0, 2)))
    assert rings.fill(square + 1, 8, 8).sum() == 16 and rings.fill(square + 1.2, 8, 8).sum() == 16
    dice = np.random.default_rng(5)
    a, b = (c + np.array([(-3, -2), (3, -2), (3, 2), (-3, 2)]) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) for c, t in ((0, 0.3), (1.5, 1.1)))
    p = dice.uniform(-6, 6, (200000, 2))

    def inside(r):
        r = rings.oriented(r)
        return np.all([(q[0] - s[0]) * (p[:, 1] - s[1]) - (q[1] - s[1]) * (p[:, 0] - s[0]) >= 0 for s, q in zip(r, np.roll(r, -1, axis=0), strict=True)], axis=0)

    assert abs(rings.signed_area(rings.clip(a, b))) == pytest.approx(144 * (inside(a) & inside(b)).mean(), abs=0.3)

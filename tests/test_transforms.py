"""Cosine transform and quantiser."""

import numpy as np

from lumenweave.operators import transforms as t


def test_inverse_is_near():
    x = np.random.default_rng(1).integers(-255, 256, (2000, 4, 4))
    # the inverse's basis is rounded to whole numbers: both ways in exact arithmetic are this, not the identity
    line = t.INVERSE.T @ t.FORWARD / 2**14 / 2**7.5
    both = np.kron(line, line)
    inherent = np.abs(both - np.eye(16)).sum(1).max() * 255
    assert inherent < 12
    back = t.inverse_dct(t.forward_dct(x)).reshape(-1, 16)
    assert np.abs(back - np.clip(x.reshape(-1, 16) @ both.T, -256, 255)).max() <= 2 and np.abs(back - x.reshape(-1, 16)).max() <= inherent + 2
    assert (t.forward_dct(np.zeros((1, 4, 4), int)) == 0).all()
    flat = t.forward_dct(np.full((1, 4, 4), 16))
    assert np.abs(flat[0].ravel()[1:]).max() <= 1 and flat[0, 0, 0] > 0


def test_levels():
    c = np.random.default_rng(2).integers(-4000, 4001, (500, 4, 4))
    for index in (0, 1, 24, 25, 90, 255, 400):
        step = t.step_size(index)
        q = t.levels(c, step)
        assert (q == -t.levels(-c, step)).all()
        assert np.abs(t.from_levels(q, step) - c).max() <= step / 8 + 2
    assert [t.step_size(i) for i in (0, 1, 24, 25, 49)] == [40, 40, 78, 80, 160]

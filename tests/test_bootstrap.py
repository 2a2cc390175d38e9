"""The bootstrap's draws: counts of a Poisson(1) variable, apart by clip and by resample."""

import numpy as np

from clipflow.operators.compare import counts_of
from clipflow.plans.text import RESAMPLES


def test_counts():
    key = np.random.default_rng(1).integers(0, 1 << 32, 500)
    w = counts_of(key, RESAMPLES, 7)
    assert w.shape == (2000, 500) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(w.sum(1).std() - 500**0.5) < 2  # resamples: independent clips
    assert abs(w.sum(0).std() - 2000**0.5) < 6  # clips: independent resamples
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2
    assert (counts_of(key, RESAMPLES, 8) != w).mean() > 0.5

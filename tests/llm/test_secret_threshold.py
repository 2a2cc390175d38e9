"""The threshold of the secret scans keeps its recall on all labelled secrets that are kept apart, below 0.5 too."""

import numpy as np

from clipflow.llm import secret_scans as S


def test_threshold_keeps_recall_below_half(spark):
    rng = np.random.default_rng(5)
    net = S.Network(*(rng.normal(0, 0.2, s) for s in ((129, S.DIM), (S.FIELD * S.DIM, S.FILTERS), (S.FILTERS,), (S.FILTERS + 1,))), 1.0, -3.0)
    texts = [bytes(rng.integers(97, 123, 24).tolist()) for _ in range(3000)]  # more than the 2,000 rows of a fit
    held = [S.windows(t, 0, len(t)) for t in texts]
    p = net.probability([w[0] for w in held])
    assert p.max() < 0.5
    chosen = S.placed(net, spark.createDataFrame([(i, w) for i, w in enumerate(held)], "place long, windows array<binary>"), 0.98).threshold
    assert (p >= chosen).mean() >= 0.98 and (p >= S.EDGES[np.searchsorted(S.EDGES, chosen, "right")]).mean() < 0.98
    x, y = np.frombuffer(b"".join(w[0] for w in held), np.uint8).reshape(-1, S.WIDTH), (np.arange(3000) % 10 == 0) * 1.0
    flat = S.calibrate(net, x, y, 0.98)  # a tenth are secrets and nothing tells them apart: scores near 0.1
    assert (flat.probability([w[0] for w in held])[y == 1] >= flat.threshold).mean() >= 0.98

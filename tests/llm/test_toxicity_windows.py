import tracemalloc

import numpy as np

from vdomain.llm import toxicity


def test_a_passage_of_half_a_window_lies_whole_in_a_window():
    net = toxicity.Network({}, {})
    for size in range(65, 400):
        _, start, length = net.windows(np.array([size]))
        for at in range(size - 32 + 1):
            assert ((start <= at) & (start + length >= at + 32)).any()


def test_projections_hold_one_table():
    rng = np.random.default_rng(3)
    D, H = toxicity.WORD_DIM + toxicity.CHAR_DIM, toxicity.HIDDEN
    net = toxicity.Network({}, {"W": rng.standard_normal((2, D, 3 * H)).astype(np.float32), "b": rng.standard_normal((2, 3 * H)).astype(np.float32)})
    x = rng.standard_normal((20_000, D)).astype(np.float32)
    tracemalloc.start()
    out = net.projections(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * out.nbytes
    assert (out == (np.matmul(x[None], net.p["W"]) + net.p["b"][:, None]) * net.halves).all()

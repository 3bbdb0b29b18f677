from __future__ import annotations

import numpy as np

from tallycast.llm import neighbours


def test_a_block_of_copies_yields_all_rows_of_each_query():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        x, q = np.repeat(rng.normal(size=(1, 64)), 500, axis=0), rng.normal(size=(50, 64))
        turn = neighbours.rotation(64)
        rows, cols, score = neighbours.best_of_block(np.arange(5000, 5050), q, np.arange(500), x, *neighbours.encode(x, turn), turn)
        assert np.bincount(rows, minlength=50).tolist() == [20] * 50
        assert cols.reshape(50, 20).tolist() == [list(range(20))] * 50
        assert np.allclose(score.reshape(50, 20), (q @ x[0])[:, None])

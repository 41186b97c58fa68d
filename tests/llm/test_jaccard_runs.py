"""The number of runs meets the recall over the sampled tokens' agreement."""

import numpy as np

from loomspan.llm import jaccard_join as jj


def test_runs_hold_the_recall_over_shared_tokens():
    same = np.random.default_rng(5).binomial(jj.TOKENS, jj.THRESHOLD, 2_000_000)
    p, q = same / jj.TOKENS, 1 / jj.THRESHOLD - 1
    meets = np.ones(len(p))
    for _ in range(jj.DEPTH):
        meets = 1 - (1 - p * meets) * (1 - p * q * meets)
    cut = jj.TOKENS * jj.THRESHOLD - 4 * (jj.TOKENS * jj.THRESHOLD * (1 - jj.THRESHOLD)) ** 0.5
    missed = np.where(same < cut, 1.0, (1 - meets) ** jj.runs_for())
    assert missed.mean() <= 1.02 * (1 - jj.RECALL)

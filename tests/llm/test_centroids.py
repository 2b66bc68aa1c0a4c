"""Centroids of inverted lists where many vectors are equal."""

import numpy as np

from lossledger.llm.neighbours import fit_centroids, unit


def test_a_group_of_equal_vectors_gets_one_list():
    vectors = unit(np.random.default_rng(0).standard_normal((600, 16)))
    sample = np.vstack([vectors, np.repeat(vectors[:1], 600, axis=0)])
    centres = fit_centroids(sample, 35)
    assert len(centres) == 35
    assert len(set(np.argmax(sample @ centres.T, axis=1).tolist())) == 35
    assert len(fit_centroids(np.repeat(vectors[:1], 50, axis=0), 7)) == 1

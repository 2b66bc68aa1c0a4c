"""Best fit where documents and cost bind, against a plain version."""

import numpy as np
import pytest

from lossledger.llm.packing import best_fit


def plain_fit(lengths, full, weights, score):
    """The number of sequences, every open sequence tried for every piece; and the score of each choice."""
    full, scale = np.array(full, float), np.array(weights) / np.array(full, float)
    rooms, scores = [], []
    for length in sorted(lengths, reverse=True):
        need = np.array([length, 1, length * length], float)
        value = lambda room: (-((room - need) * scale) ** 2).sum() if score == "norm" else (
            need * scale * room * scale).sum()
        fit = [(value(r), -i) for i, r in enumerate(rooms) if (r >= need).all()]
        if fit:
            best, i = max(fit)
            scores.append(best)
            rooms[-i] = rooms[-i] - need
        else:
            rooms.append(full - need)
    return len(rooms)


def test_a_piece_goes_to_the_second_sequence_of_equal_token_room():
    # after 10 | 5 + 5 both have 10 tokens left; the first, with more documents left, has too little cost for another 5
    sequence, offset = best_fit(np.array([10, 5, 5, 5]), 20, 5, 120, (1.0, 1.0, 1.0), "norm")
    assert sequence.tolist() == [0, 1, 1, 1] and offset.tolist() == [0, 0, 5, 10]


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_as_many_sequences_as_trying_all(score, seed):
    lengths = np.random.default_rng(seed).integers(1, 40, 300)
    full, weights = (100, 6, 2500), (1.0, 0.3, 0.7)
    sequence, _ = best_fit(lengths, *full, weights, score)
    assert len(set(sequence.tolist())) == plain_fit(lengths.tolist(), full, weights, score)

import numpy as np
import pytest

from kilim.llm import language as g


@pytest.mark.parametrize("least, mixed", [(0.91, ["tr", "en"]), (0.95, [])])
def test_sentence_needs_the_calibrated_confidence(least, mixed):
    m = g.Model(g.LANGUAGES)
    m.least = least
    p = np.full((6, len(g.LANGUAGES)), 0.02)
    p[:3, 0] = p[3:, 1] = 0.92
    m.probabilities = lambda texts: p
    assert g.judge(["Bir iki üç dört beş. " * 3 + "One two three four five. " * 3], m)[0].mixed == mixed

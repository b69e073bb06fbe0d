"""Masked words in texts with characters outside ASCII and two-byte letters."""

import numpy as np
import pyarrow as pa
import pytest

from stratagraph.llm import toxicity

NONE, ABUSE, SECOND = np.zeros(0, np.uint64), toxicity.hashes_of(["asshole", "idiot"]), toxicity.hashes_of(["you"])
MASK = [toxicity.FEATURES.index(x) for x in ("words", "abuse_hits", "masked_hits", "near_second_person", "mixed_words", "repeated")]


def of(text):
    return toxicity.features(pa.array([text]), NONE, ABUSE, SECOND)[0, MASK]


@pytest.mark.parametrize("odd", "“ ’ – — €   ¡ ¿ … 😀 × ÷".split(" "))
def test_masked_words_count_beside_odd_characters(odd):
    plain = of("you a$$hole, you 1d10t! you @sshole")
    assert plain[MASK.index(toxicity.FEATURES.index("masked_hits"))] > 0
    assert of(f"you a$$hole, you 1d10t! you @sshole {odd}").tolist() == plain.tolist()
    assert of(f"you{odd}a$$hole,{odd}you 1d10t! you{odd}@sshole").tolist() == plain.tolist()


def test_masked_words_count_beside_other_scripts():
    plain, mixed = of("you a$$hole you word"), of("you a$$hole you слово")
    assert plain.tolist() == mixed.tolist()

"""Registered permutation tests draw as often as the reference does."""

import pytest

from loomnet.operators import netstats
from loomnet.plans import registry


@pytest.mark.parametrize("name, reps", [("qap", {15_000}), ("mrqap", {15_000}), ("cug", {15_000}), ("reciprocity_random", {5_000})])
def test_draws_of_the_reference(spark, sf, monkeypatch, name, reps):
    seen, draws = set(), netstats._draws

    def few(spark, n, *more):
        seen.add(n)
        return draws(spark, 5, *more)

    monkeypatch.setattr(netstats, "_draws", few)
    assert registry.QUERIES[name](spark, sf).columns and seen == reps

"""Budgets of whole trees against a recursive filling, with weights of zero at every level."""

from __future__ import annotations

import math
import random

import pytest

from tidecast.llm import mixing


def filled(given: float, caps: dict, weights: dict) -> dict:
    """Shares of ``given`` by weight, none above its cap: children are closed one by one at their cap."""
    out = dict.fromkeys(caps, 0.0)
    left, still = given, {k for k in caps if weights[k] > 0}
    while still:
        level = left / sum(weights[k] for k in still)
        full = {k for k in still if caps[k] <= level * weights[k]}
        if not full:
            return out | {k: math.floor(level * weights[k]) for k in still}
        out |= {k: caps[k] for k in full}
        left -= sum(caps[k] for k in full)
        still -= full
    return out


def brute(leaves: dict, spec: mixing.MixSpec) -> dict:
    def weight(level: int, value) -> float:
        return spec.weights.get(mixing.LEVELS[level], {}).get(value, 1.0)

    def cap(prefix: tuple) -> float:
        if len(prefix) == 3:
            return leaves[prefix] * spec.max_epochs
        return sum(cap(c) for c in children(prefix) if weight(len(prefix), c[-1]) > 0)

    def children(prefix: tuple) -> list[tuple]:
        n = len(prefix)
        return list(dict.fromkeys(k[: n + 1] for k in leaves if k[:n] == prefix))

    def give(prefix: tuple, budget: float) -> dict:
        if len(prefix) == 3:
            return {prefix: budget}
        below = children(prefix)
        shares = filled(budget, {c: cap(c) for c in below}, {c: weight(len(prefix), c[-1]) for c in below})
        return {leaf: b for c in below for leaf, b in give(c, shares[c]).items()}

    return give((), math.floor(sum(leaves.values()) * spec.share))


def budgets(spark, leaves: dict, spec: mixing.MixSpec) -> dict:
    df = spark.createDataFrame([(*k, v, 1) for k, v in leaves.items()], "domain string, lang string, source string, supply long, rows long")
    return {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, spec).collect()}


def test_a_subtree_of_weight_zero_takes_no_budget_from_others(spark):
    leaves = {("d1", "en", "a"): 100, ("d1", "fr", "a"): 1900, ("d2", "en", "b"): 3000}
    got = budgets(spark, leaves, mixing.MixSpec(share=0.4, max_epochs=1, weights={"lang": {"fr": 0.0}}))
    assert got == {("d1", "en", "a"): 100, ("d1", "fr", "a"): 0, ("d2", "en", "b"): 1900}


@pytest.mark.parametrize("seed", range(4))
def test_random_trees_with_zero_weights_at_every_level(spark, seed):
    rng = random.Random(seed)
    leaves = {(d, la, s): rng.choice([0, 1, 30, 500, 9000]) for d in ("d1", "d2", "d3") for la in ("en", "fr", None) for s in ("a", "b", "c") if rng.random() < 0.8}
    values = {"domain": ("d1", "d2"), "lang": ("en", "fr"), "source": ("a", "b")}
    spec = mixing.MixSpec(share=0.5, max_epochs=2, weights={k: {v: rng.choice([0.0, 1.0, 4.0]) for v in vs} for k, vs in values.items()})
    assert budgets(spark, leaves, spec) == brute(leaves, spec)


def test_nothing_may_give(spark):
    leaves = {("d1", "en", "a"): 100, ("d2", "en", "a"): 50}
    assert budgets(spark, leaves, mixing.MixSpec(weights={"source": {"a": 0.0}})) == dict.fromkeys(leaves, 0.0)

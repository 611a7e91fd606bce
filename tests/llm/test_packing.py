"""Packing against item-by-item best fit."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomdex.llm import packing


def brute(lengths, capacities, overhead, prefer):
    """Best-fit decreasing, one item at a time."""
    capacities = sorted(capacities)
    bins = []
    left = Counter(lengths)
    for n in sorted(lengths, reverse=True):
        open_ = [b for b in bins if b[1] >= n]
        if open_:
            best = min(open_, key=lambda b: b[1])
        else:
            fit = [c for c in capacities if c >= n]
            cap = next((c for c in fit if c >= prefer), fit[-1]) if prefer is not None else min(fit, key=lambda c: ((c + overhead) / min(c // n, left[n]), -c))
            best = [cap, cap]
            bins.append(best)
        best[1] -= n
        left[n] -= 1
    return sum(min(c for c in capacities if c >= b[0] - b[1]) + overhead for b in bins), len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_plan_equals_item_by_item(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 2, 3, 5, 8, 20, 31, 32, 33, 60, 64, rnd.randrange(1, 65)]) for _ in range(300)]
    for prefer in (16, 32, 64):
        plan = packing.Plan(dict(Counter(lengths)), (16, 32, 64), 3, prefer)
        assert (plan.cost, plan.n_bins) == brute(lengths, (16, 32, 64), 3, prefer)
    best = packing.plan(dict(Counter(lengths)), (16, 32, 64), 3)
    assert best.cost <= min(brute(lengths, (16, 32, 64), 3, p)[0] for p in (16, 32, 64))


def test_salted_ranks_fill_the_same_bins(spark, docs_of):
    rnd = random.Random(1)
    rows = [(k, "w " * rnd.choice([0, 3, 7, 7, 7, 7, 100])) for k in range(200)] + [(5, "w " * 7), (None, "w"), (6, None)]
    a, b = (packing.pack(docs_of(rows), capacities=(16, 64), bucket=n) for n in (1 << 20, 10))
    key = lambda df: sorted((r.capacity, r.used, tuple(r.lengths)) for r in df.collect())
    assert key(a) == key(b)
    assert b.select(F.explode("doc_ids").alias("d")).filter("d = 5").count() >= 2
    assert sum(r.n_pieces for r in b.collect()) == b.agg(F.sum(F.size("doc_ids"))).first()[0]
    assert packing.pack(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of(rows), capacities=())

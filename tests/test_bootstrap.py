"""Bootstrap intervals of large comparisons: what they hold in memory, and that they stay the same."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvidex.operators import evaluation as E


def peak_mb(f, *args) -> float:
    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def whole(d, draws, resamples, low, high):
    """The interval from all draws at once."""
    means = np.sort(d[draws].reshape(resamples, len(d)).mean(axis=1))
    return float(d.mean()), float(means[low]), float(means[high]), len(d)


def python_draws(n, count):
    _, state, _ = random.Random(1).getstate()
    twister = np.random.RandomState()
    twister.set_state(("MT19937", np.array(state[:-1], dtype=np.uint32), state[-1]))
    return np.floor(twister.random_sample(count) * n).astype(np.int64)


def test_python_draws_are_not_held():
    assert peak_mb(E.bootstrap_python, np.arange(2000.0).tolist(), 5000) < 8  # its 10 M draws would be 80


# one pair; steps of many resamples, the last one short; a resample in one part (of 2^14 draws), a full one and several
@pytest.mark.parametrize(("n", "resamples"), [(1, 40), (7, 5003), (1000, 333), (16_383, 41), (16_384, 40), (49_157, 41)])
def test_python_interval_is_that_of_all_draws_at_once(n, resamples):
    d = np.random.RandomState(n).standard_normal(n)
    want = whole(d, python_draws(n, n * resamples), resamples, int(0.025 * resamples), int(0.975 * resamples) - 1)
    assert E.bootstrap_python(d.tolist(), resamples) == want


def test_comparisons_are_spread_over_tasks(spark):
    rows = [(g, i, float(i) if i else None) for g in ("a", "b", "c", "d", "e", None) for i in range(4)] + [("none", 1, None)]
    r = E.bootstrap(spark.createDataFrame(rows, "grp string, qid long, difference double"), ["grp"], E.bootstrap_python, 50, 1)
    got = {x.grp: x for x in r.withColumn("task", F.spark_partition_id()).collect()}
    assert len({x.task for x in got.values()}) >= 6
    assert got["none"].pairs == 0 and got["none"].mean_diff is None and {got[g].pairs for g in ("a", "b", "c", "d", "e", None)} == {3}


def test_java_draws_are_not_held():
    assert peak_mb(E.bootstrap_java, np.arange(3000.0).tolist(), 3333) < 8  # its 10 M draws would be 80


# 4096 and 16,384 take no remainder; of 70,001 some draws are rejected
@pytest.mark.parametrize(("n", "resamples"), [(1, 40), (7, 5003), (4096, 41), (16_383, 41), (16_384, 40), (70_001, 21)])
def test_java_interval_is_that_of_all_draws_at_once(n, resamples):
    d, one = np.random.RandomState(n).standard_normal(n), E.JavaRandom(42)
    draws = np.array([one.below(n) for _ in range(n * resamples)])
    want = whole(d, draws, resamples, int(0.025 * (resamples - 1)), -int(-0.975 * (resamples - 1) // 1))
    assert E.bootstrap_java(d.tolist(), resamples) == want


@pytest.mark.parametrize("n", [3, 1 << 20, (1 << 30) + 1, (1 << 31) - 1])
def test_java_draws_go_on_where_they_ended(n):
    draws, one = E.JavaDraws(-7, n), E.JavaRandom(-7)
    for k in (0, 1, 16_383, 16_384, 5, 40_000):
        assert draws.take(k).tolist() == [one.below(n) for _ in range(k)]

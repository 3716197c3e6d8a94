import random
from collections import defaultdict

from pyspark.sql import functions as F

from corvidex.operators.ordering import blocked_row_number, blocked_running_max, blocked_running_sum


def test_blocked_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, 1, 5])) for i in rng.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "k string, o long, v int").repartition(7)
    groups = defaultdict(list)
    for k, o, v in rows:
        groups[k].append((o, v))
    number, before = {}, {}
    for k, g in groups.items():
        total = 0
        for i, (o, v) in enumerate(sorted(g), 1):
            number[k, o], before[k, o] = i, total
            total += v or 0
    assert {(r.k, r.o): r.n for r in blocked_row_number(df, ["k"], [F.col("o")], "n").collect()} == number
    assert {(r.k, r.o): r.before for r in blocked_running_sum(df, ["k"], [F.col("o")], "v").collect()} == before
    top = {}
    for k, g in groups.items():
        best = None
        for o, v in sorted(g):
            top[k, o] = best
            best = v if best is None or (v is not None and v > best) else best
    assert {(r.k, r.o): r.top for r in blocked_running_max(df, ["k"], [F.col("o")], F.col("v"), "top").collect()} == top
    assert blocked_row_number(df.limit(0), ["k"], [F.col("o")]).count() == 0

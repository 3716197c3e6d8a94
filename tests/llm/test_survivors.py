import random
import re
from collections import defaultdict

from corvidex.llm.emptiness import is_blank, is_empty, is_empty_list
from corvidex.llm.survivors import field_winners, survivors
from pyspark.sql import functions as F

FIELDS = {"a": is_empty, "t": is_empty_list}


def test_emptiness(spark):
    empty = [None, "", " ", "\n\t ", "​", "﻿", "  ", "...", "…", "-", "--", "None", "null", "[empty]", "(empty)", "<no response>", "(no output)", "n/a", "N/A", "## Assistant\n\n", "```\n```", "```java\n```", "**", "[brak]"]
    full = ["Done.", "Yes.", "ok", "0", "👍", "None of it", "## Plan\ntext", "```\nx = 1\n```", "n/a for now, see below", "x" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(empty + full)], "i int, t string")
    got = {r.i for r in df.where(is_empty(F.col("t"))).collect()}
    assert got == set(range(len(empty))), [(empty + full)[i] for i in got ^ set(range(len(empty)))]
    lists = spark.createDataFrame([("[]",), ("[ ]",), ('[""]',), (None,), (" ",), ('["A-1"]',), ("[null, null]",)], "t string")
    assert [r[0] for r in lists.select(is_empty_list(F.col("t"))).collect()] == [True, True, True, True, True, False, True]
    assert lists.where(is_blank(F.col("t"))).count() == 2


def test_against_brute_force(spark):
    rng = random.Random(2)
    keys = ["Logs\\a#1", "logs/a#1 ", " LOGS/A#1", "k2", "K2", "solo", None, " ", "k3", "k3"]
    rows = [(i, rng.choice(keys), rng.choice([1, 2, 3, None]), rng.choice(["x", "X ", "y", "n/a", "", None]), rng.choice(["[]", '["A-1"]', None]), "clash") for i in range(120)]
    df = spark.createDataFrame(rows, "sequence long, key string, rank int, a string, t string, votes string")
    norm = lambda k: re.sub(r"\s+$|^\s+", "", k.replace("\\", "/")).lower() if k else ""
    groups = defaultdict(list)
    for r in rows:
        if norm(r[1]):
            groups[norm(r[1])].append(r)
    want = set()
    for g in groups.values():
        if len(g) < 2:
            continue
        for name, col, none in (("a", 3, {"", "n/a", None}), ("t", 4, {"[]", None})):
            have = [r for r in g if r[col] not in none]
            if have:
                best = max(have, key=lambda r: (-(r[2] or 2**31), r[0]))
                want.add((min(r[0] for r in g), name, best[0]))
    w = field_winners(df, "key", FIELDS, "rank", "sequence")
    assert {(r.first_sequence, r.field_name, r.sequence) for r in w.collect()} == want and want
    recs = survivors(df, w, ["a", "t"], "sequence").collect()
    by = {r[0]: r for r in rows}
    assert len(recs) == len({x[0] for x in want}) and all(r.a is None or by[r.a_from][3] == r.a for r in recs)
    assert field_winners(df.limit(0), "key", FIELDS, "rank", "sequence").count() == 0


def test_many_lesser_votes_do_not_outweigh_a_better_one(spark):
    rows = [(1, "k", 1, "old"), *[(i, "k", 2 + i % 3, "new " if i % 2 else "New") for i in range(2, 3000)], (3000, "k", None, "old")]
    df = spark.createDataFrame(rows, "sequence long, key string, rank int, a string")
    won = field_winners(df, "key", {"a": is_empty}, "rank", "sequence").first()
    assert (won.sequence, won.votes) == (1, 2)
    without = field_winners(df.where("sequence > 1"), "key", {"a": is_empty}, "rank", "sequence").first()
    assert (without.sequence, without.votes) == (2997, 2998)  # the newest of rank 2


def test_any_ranks_large_sequences_and_one_hot_key(spark):
    """Ranks far apart (more levels than one number holds) and sequences near each other at the far end."""
    rng = random.Random(5)
    rows = [(2**50 + i, "hot" if i % 3 else f"k{i % 40}", rng.choice([-7, 0, 3, *range(100, 260)]), f"v{rng.randrange(30)}") for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sequence long, key string, rank int, a string").withColumn("field_name", F.lit("clash"))
    best = {}
    for s, k, r, _ in rows:
        best[k] = min(best.get(k, (r, -s)), (r, -s))
    got = {(r.first_sequence, r.sequence) for r in field_winners(df, "key", {"a": is_empty}, "rank", "sequence").collect()}
    assert got == {(min(s for s, k2, *_ in rows if k2 == k), -b[1]) for k, b in best.items()}
    nulls = df.withColumn("rank", F.lit(None).cast("int"))
    assert {r.sequence for r in field_winners(nulls, "key", {"a": is_empty}, "rank", "sequence").collect()} == {max(s for s, k2, *_ in rows if k2 == k) for k in best}


def test_plain_texts_skip_the_full_rule_only_when_it_agrees(spark):
    from corvidex.llm.emptiness import _stands_for_nothing

    odd = ["none" + " " * 100, "n/a" + "." * 100, "# " + "a" * 100, "none\n```" + "b" * 60 + "\n", "x\n~~~" + "b" * 60, "brak" + "​" * 90, "a" * 41, "a" * 40, "7 " * 45, "é" * 50, "tbd " * 30, "none`" + "c" * 60]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert df.where(is_empty(F.col("t")) != _stands_for_nothing(F.col("t"))).count() == 0

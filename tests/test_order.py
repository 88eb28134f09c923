"""Running values, balance rules and greedy flags against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quizloom.operators import balance as B
from quizloom.operators import dedup as D
from quizloom.operators import ordered as O

LETTERS = ["a1", "b2", "c3", "d4"]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_running_values_over_many_buckets(spark, parts):
    rnd = random.Random(parts)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rnd.randint(-9, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o bigint, v int").repartition(parts)
    got = O.running(
        df, ["g"], "o",
        {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "mb": ("min_before", F.col("v"))}, width=7,
    ).collect()
    want = {}
    seen = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(g, [])
        want[(g, o)] = (sum(past) + v, min([*past, v]), min(past) if past else None)
        past.append(v)
    assert {(r.g, r.o): (r.s, r.m, r.mb) for r in got} == want


def test_bucket_width_for_sparse_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 10**12).alias("o"), F.lit(1).alias("g"))
    width = O.bucket_width(df, "o", 100)
    got = O.row_numbers(df, ["g"], "o", width=width)
    assert [r.row_no for r in got.orderBy("o").collect()] == list(range(1, 1001))
    assert got.select(F.floor(F.col("o") / width)).distinct().count() <= 11


@pytest.mark.parametrize("seed", range(6))
def test_answer_positions_by_the_rule_of_each_prefix(spark, seed):
    rnd = random.Random(seed)
    groups = {g: [rnd.choices([0, 1, 2, 3, None], [8, 1, 1, 1, 1])[0] for _ in range(n)] for g, n in enumerate([7, 8, 9, 20, 40, 150])}
    groups[9] = [0] * 60
    rows = [(g, i * 3, LETTERS, "none" if p is None else LETTERS[p]) for g, ps in groups.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "g int, o bigint, options array<string>, correct_answer string")
    got = {(r.g, r.o): r.flagged for r in B.enforce_answer_positions(df, ["g"], "o", width=11).collect()}
    for g, places in groups.items():
        flags = [got[g, i * 3] for i in range(len(places))]
        for i, place in enumerate(places):
            # What the rule says of the rows before, as they were flagged.
            kept = sum(p == place and not f for p, f in zip(places[:i], flags[:i]))
            crowded = kept + 1 > 0.55 * (i + 1) and kept >= math.ceil(len(places) * 0.45)
            assert flags[i] == (place is not None and len(places) >= 8 and crowded)
    assert any(got.values())


@pytest.mark.parametrize("seed", range(6))
def test_assertion_balance_by_the_rule_of_each_prefix(spark, seed):
    rnd = random.Random(seed)
    groups = {g: [(rnd.random() < 0.7, rnd.random() < 0.6) for _ in range(n)] for g, n in enumerate([2, 3, 4, 5, 30, 120])}
    a = "Both A and R are true, the correct explanation of A is R".replace(",", " and")
    rows = [
        (g, i, "assertion_reason" if k else "standard", a if k and x else "A is true")
        for g, items in groups.items() for i, (k, x) in enumerate(items)
    ]
    df = spark.createDataFrame(rows, "g int, o bigint, question_type string, correct_answer string")
    got = {(r.g, r.o): r.flagged for r in B.enforce_assertion_balance(df, ["g"], "o", width=7).collect()}
    for g, items in groups.items():
        few = sum(k for k, _ in items) < 3
        kept = []  # whether each kept item of the kind has option A
        for i, (kind, is_a) in enumerate(items):
            too_many = is_a and len(kept) >= 3 and sum(kept) + 1 > 0.40 * (len(kept) + 1)
            assert got[g, i] == (kind and too_many and not few)
            if kind and not got[g, i]:
                kept.append(is_a)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_flags_equal_the_loop(spark, seed):
    rnd = random.Random(seed)
    edges = {(i, j) for i in range(60) for j in range(i + 1, 60) if rnd.random() < 0.06} | {(i, i + 1) for i in range(60, 75)}
    df = spark.createDataFrame([(1, i, j) for i, j in edges], "g int, left_id bigint, right_id bigint")
    got = {r.id: r.flagged_by for r in D.greedy_flags(df, ["g"]).collect()}
    want = {}
    for i in range(80):
        if i in want:
            continue
        for j in range(i + 1, 80):
            if (i, j) in edges and j not in want:
                want[j] = i
    assert got == want


def test_allocation_bounds_and_total(spark):
    sets = spark.range(1, 60).select(F.col("id").cast("int").alias("exam_set"))
    rows = B.allocate(sets).collect()
    assert len(rows) == 59 * 9
    assert all(r.min_q <= r.quota <= r.max_q for r in rows)
    totals = {}
    for r in rows:
        totals[r.exam_set] = totals.get(r.exam_set, 0) + r.quota
    assert set(totals.values()) == {100}
    assert len({tuple(r.quota for r in rows if r.exam_set == s) for s in range(1, 60)}) > 10

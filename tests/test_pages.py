"""Pages by counts: the rows of the plain page, from as many files however deep."""

import pytest
from pyspark.sql import functions as F

from quizloom.operators import bank as B
from quizloom.operators import pages as P

COLUMNS = ["id", "exam_set", "difficulty", "total"]


@pytest.fixture(scope="module")
def bank(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") * 7 % 11).cast("int")).alias("exam_set"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("id") % 5 % 3 + 1).cast("int")).alias("difficulty"),
    )
    return rows.repartition(6).cache()


@pytest.fixture(scope="module")
def paged(bank):
    return P.store(bank, ["exam_set", "difficulty"], file_rows=100)


def _rows(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


@pytest.mark.parametrize("where", [{}, {"difficulty": "hard"}, {"exam_set": 1}, {"exam_set": 4, "difficulty": "easy"}])
def test_pages_equal_the_plain_ones(bank, paged, where):
    kept = B.filter_bank(bank, **where)
    last = -(-kept.count() // 70)
    for number in {1, 2, max(1, last - 1), last}:
        assert _rows(paged.page(number, 70, **where)) == _rows(B.page(kept, number, 70))
    assert paged.page(last + 1, 70, **where).count() == 0


def test_deep_pages_read_no_more_files(paged):
    files = []
    for number in (1, 20, 60):
        seen = {}
        paged.page(number, 50, seen=seen)
        files.append(seen["files"])
    assert max(files) <= 2


def test_odd_calls(spark, bank, paged):
    with pytest.raises(ValueError):
        paged.page(0)
    with pytest.raises(ValueError):
        paged.page(1, chapter="c")
    assert P.store(bank.limit(0), ["exam_set"]).page(1).count() == 0

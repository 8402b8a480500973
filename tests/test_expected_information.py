"""The expected information of drawn clusterings against sums over whole numbers, and the adjusted score against it."""

import math
import random
from collections import Counter
from fractions import Fraction

from clusterloom.functions import measures


def plain(rows, cols):
    """The mean information of a table with these margins, with exact probabilities."""
    n = sum(rows)
    total = 0.0
    for a, ka in Counter(rows).items():
        for b, kb in Counter(cols).items():
            for x in range(max(1, a + b - n), min(a, b) + 1):
                p = Fraction(math.comb(a, x) * math.comb(n - a, b - x), math.comb(n, b))
                total += ka * kb * float(p) * x / n * math.log(n * x / (a * b))
    return total


def emi(spark, rows, cols, n):
    tables = (spark.createDataFrame(list(Counter(sizes).items()), f"{names[0]} long, {names[1]} long") for sizes, names in ((rows, ("ra", "ka")), (cols, ("cb", "kb"))))
    return measures.expected_information(*tables, spark.createDataFrame([(n,)], "N long")).first()["emi"]


def test_equals_exact_sums(spark):
    rng = random.Random(5)
    for rows, cols in [([1], [1]), ([7], [7]), ([1] * 9, [9]), ([1] * 9, [1] * 9), ([5, 4], [8, 1]), ([400, 3, 1, 1], [200, 205]), ([90, 90, 20], [150, 50])]:
        assert math.isclose(emi(spark, rows, cols, sum(rows)), plain(rows, cols), rel_tol=1e-11, abs_tol=1e-14), (rows, cols)
    rows = [rng.randint(1, 60) for _ in range(30)]
    cols = [rng.randint(1, 60) for _ in range(25)]
    gap = sum(rows) - sum(cols)
    (cols if gap > 0 else rows).append(abs(gap) or 1)
    if not gap:
        rows.append(1)
    assert math.isclose(emi(spark, rows, cols, sum(rows)), plain(rows, cols), rel_tol=1e-11)


def test_a_billion_nodes(spark):
    """With large cells all around, the mean is (rows - 1) (columns - 1) / 2 N but for terms of 1 / N squared."""
    n = 10**9
    assert math.isclose(emi(spark, [n // 2, n // 2], [n // 2, n // 4, n // 4], n), 2 / (2 * n), rel_tol=1e-4)
    assert emi(spark, [n], [n // 2, n // 2], n) < 1e-18


def test_skewed_score_and_empty(spark):
    a = [(i, 0 if i < 700 else i) for i in range(1000)]
    b = [(i, i % 2 if i < 700 else i // 3) for i in range(1000)]
    truth, found = (spark.createDataFrame(x, "node_id long, cluster_id long") for x in (a, b))
    row = measures.adjusted_information(truth, found).first()
    sizes = [list(Counter(c for _, c in x).values()) for x in (a, b)]
    assert row["nodes"] == 1000 and abs(row["expected"] - plain(*sizes)) < 1e-6
    assert measures.adjusted_information(truth, truth).first()["ami"] == 1.0
    none = truth.where("false")
    assert measures.adjusted_information(none, none).first()["expected"] == 0.0

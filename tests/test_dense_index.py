"""Places of rows in a total order, where adaptive execution merges ranges by their size."""

from pyspark.sql import functions as F

from clusterloom.operators.graph import dense_index


def test_every_row_has_its_place(spark):
    wide = F.concat(*(F.sha2(F.concat("id", F.lit(i)), 256) for i in "abcd"))  # columns beside the order make ranges larger
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") * 7919 % 40_009).alias("component"), (-(F.col("id") % 5)).alias("down"), wide.alias("wide"))
    placed = [tuple(r) for r in dense_index(rows, ["down", "component"], "at").selectExpr("down", "component", "at", "length(wide)").collect()]
    assert len(placed) == 40_000
    assert [at for _, _, at, _ in sorted(placed)] == list(range(40_000))

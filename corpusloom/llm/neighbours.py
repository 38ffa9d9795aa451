"""Each row together with the one after it in a total order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ranges import constants, cut_points, range_of


def with_next(rows: DataFrame, key: str, ties: list[str], carry: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``carry`` (new name: column) of the next row by descending ``key``, a long.

    After the last row comes the first. Rows with an equal key go by ``ties``;
    null keys come last. Rows are dealt by ranges of the key, as many as
    ``spark.sql.shuffle.partitions``, and the first row of each range is also
    given to the range before it; only the ranges' bounds reach the driver,
    and a row finds its range by binary search.
    """
    cuts = cut_points(rows, key, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = len(cuts) + 1  # the range of null keys
    rows = rows.withColumn("__range", F.when(F.col(key).isNull(), last).otherwise(range_of(F.col(key), cuts)))
    tops = {r[0]: r[1] for r in rows.groupBy("__range").agg(F.max(key)).collect()}  # a row for each range
    order = sorted(tops, key=lambda r: (r == last, -r))
    home = dict(zip(order, [order[-1], *order[:-1]], strict=True)) if order else {}
    top_of = F.get(constants([tops.get(r) for r in range(last + 1)], "bigint"), F.col("__range"))
    home_of = F.get(constants([home.get(r) for r in range(last + 1)], "int"), F.col("__range"))
    guests = rows.where(F.col(key).eqNullSafe(top_of)).withColumn("__range", home_of).withColumn("__guest", F.lit(1))
    out = rows.withColumn("__guest", F.lit(0)).unionByName(guests)
    window = Window.partitionBy("__range").orderBy("__guest", F.col(key).desc_nulls_last(), *ties)
    for a, c in carry.items():
        out = out.withColumn(a, F.lead(c).over(window))
    return out.where("__guest = 0").drop("__range", "__guest")

"""Exact quantiles of large groups without gathering or sorting a group.

percentile() brings all distinct values of a group to one task.  Here values are counted in CELLS cells between the
group's ends; the cells that hold the wanted ranks are counted again in CELLS parts, and so on until each holds one
value or all of them together SORTED rows at most, which are then ranked.  What is shuffled is a row for each group,
task and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

c = F.col
CELLS, ROUNDS, SORTED = 4_096, 16, 500_000


def _cell(lo: str, hi: str) -> Column:
    place = F.floor((c("v") - c(lo)) / (c(hi) - c(lo)) * CELLS)
    return F.when(c(hi) > c(lo), F.least(place, F.lit(CELLS - 1))).otherwise(F.lit(0)).cast("long")


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, list[float]], nearest: bool = False) -> DataFrame:
    """keys, and for each name of wanted (a column of finite numbers, nulls are left out) the array of its quantiles.

    Between two ranks values are interpolated linearly; nearest: the value of rank ceil(n q).
    """
    each = F.array(*[F.struct(F.lit(k).alias("name"), c(k).cast("double").alias("v")) for k in wanted])
    long = df.select(*keys, F.explode(each).alias("_s")).select(*keys, "_s.name", "_s.v").filter(c("v").isNotNull())
    group = [*keys, "name"]
    ends = settled(long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "ends")
    places = []
    for name, qs in wanted.items():
        for i, q in enumerate(qs):
            at = (c("n") - 1) * q
            ranks = (F.greatest(F.ceil(F.round(c("n") * q, 9)) - 1, F.lit(0)),) * 2 if nearest else (F.floor(at), F.ceil(at))
            places += [F.when(c("name") == name, F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), r.cast("long").alias("rank"), (at - F.floor(at)).alias("part"))) for s, r in enumerate(ranks)]
    open_ = ends.select(*group, "lo", "hi", F.explode(F.array_compact(F.array(*places))).alias("_p")).select(*group, "lo", "hi", "_p.*")
    done, size = None, int(ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    for _ in range(ROUNDS):
        # the intervals that are still looked into, each once; in the first round there is one for each group
        spans = open_.select(*group, "lo", "hi").distinct()
        inside = long.join(spans, group).filter((c("v") >= c("lo")) & (c("v") <= c("hi")))
        if size <= SORTED:
            place = F.row_number().over(Window.partitionBy(*group, "lo", "hi").orderBy("v")) - 1
            found = inside.withColumn("rank", place.cast("long")).join(open_, [*group, "lo", "hi", "rank"]).select(*group, "i", "side", "part", "v")
            done = found if done is None else done.unionByName(found)
            break
        cells = inside.withColumn("cell", _cell("lo", "hi")).groupBy(*group, "lo", "hi", "cell").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("m").over(Window.partitionBy(*group, "lo", "hi").orderBy("cell"))  # CELLS rows at most
        run = cells.withColumn("before", before - c("m"))
        hit = open_.join(run, [*group, "lo", "hi"]).filter((c("rank") >= c("before")) & (c("rank") < c("before") + c("m")))
        hit = settled(hit.select(*group, "i", "side", "part", (c("rank") - c("before")).alias("rank"), c("low").alias("lo"), c("high").alias("hi"), "m"), "ranks")
        found = hit.filter("lo = hi").select(*group, "i", "side", "part", c("lo").alias("v"))
        done = found if done is None else done.unionByName(found)
        left = hit.filter("lo < hi")
        size = int(left.select(*group, "lo", "hi", "m").distinct().agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
        open_ = left.drop("m")
        if not size:
            break
    else:
        raise ArithmeticError(f"values lie too close for {ROUNDS} rounds of {CELLS} cells")
    pick = lambda s: F.max(F.when(c("side") == s, c("v")))
    share = F.max("part")
    one = done.groupBy(*group, "i").agg(F.when(pick(0) == pick(1), pick(0)).otherwise((1 - share) * pick(0) + share * pick(1)).alias("v"))
    arrays = [F.transform(F.sort_array(F.collect_list(F.when(c("name") == k, F.struct("i", "v")))), lambda x: x["v"]).alias(k) for k in wanted]
    return one.groupBy(*keys).agg(*arrays)

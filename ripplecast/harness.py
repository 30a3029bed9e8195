"""Comparing selection methods: sweeps over seed counts and items, model diagnostics, tables and files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplecast.operators import spread
from ripplecast.operators.lineage import stable

#: method(item, k) -> (rank, u)
Method = Callable[[int, int], DataFrame]
POINT = "method string, k int, item long, spread double, seeds int, seconds double, status string"


def evaluator(weights: DataFrame, h: float) -> Callable[[int, DataFrame], float]:
    """Spread on the full graph by one shared set of arborescences an item."""
    kept: dict[int, tuple[DataFrame, DataFrame]] = {}

    def evaluate(item: int, seeds: DataFrame) -> float:
        if item not in kept:
            w = stable(weights.where(F.col("item") == item).select("u", "v", "pp"))
            nodes = w.select("u").union(w.select("v")).distinct()
            kept[item] = (spread.arborescences(w, h, nodes), w)
        trees, w = kept[item]
        known = trees.where("hops = 0").select(F.col("root").alias("u"))
        return spread.activation(trees, w, seeds.join(known, "u", "left_semi")).agg(F.coalesce(F.sum("ap"), F.lit(0.0))).first()[0]

    return evaluate


#: What a point may fail by: bad parameters and failed Spark jobs.  Errors of the code itself end the sweep.
RECORDED = (ValueError, PySparkException)


def failure(e: Exception) -> str:
    return f"failed: {type(e).__name__}: {e}"[:200]


def sweep(spark: SparkSession, methods: dict[str, Method], ks: list[int], items: list[int], evaluate: Callable[[int, DataFrame], float], once: tuple[str, ...] = ()) -> DataFrame:
    """One row a method, k and item; a method that fails leaves its error as the status.

    Methods in once don't look at the item: they select once for each k, and these seeds are scored on every item.
    """
    points = []
    for name, method in methods.items():
        for k in ks:
            chosen = None
            for item in items:
                began = time.time()
                try:
                    if chosen is None or name not in once:
                        seeds = stable(method(item, k).select("u").distinct())
                        chosen = seeds, seeds.count(), time.time() - began
                    points.append((name, k, item, float(evaluate(item, chosen[0])), *chosen[1:], "ok"))
                except RECORDED as e:
                    points.append((name, k, item, None, 0, time.time() - began, failure(e)))
    return spark.createDataFrame(points, POINT)


def summary(points: DataFrame) -> DataFrame:
    """(method, k, spread, sd, seconds, n) over the items of the points that are ok; sd is of the whole population, spreads
    that are no numbers don't count."""
    return points.where("status = 'ok' AND NOT isnan(spread)").groupBy("method", "k").agg(F.avg("spread").alias("spread"), F.coalesce(F.stddev_pop("spread"), F.lit(0.0)).alias("sd"), F.avg("seconds").alias("seconds"), F.count("*").alias("n"))


def chain_holds(summary_: DataFrame, better: str, worse: str, tolerance: float = 0.02) -> DataFrame:
    """(k, holds): better's spread at least worse's less the tolerance, a row a k that both have."""
    a = summary_.where(F.col("method") == better).select("k", F.col("spread").alias("a"))
    b = summary_.where(F.col("method") == worse).select("k", F.col("spread").alias("b"))
    return a.join(b, "k").select("k", (F.col("a") >= F.col("b") * (1 - tolerance)).alias("holds"))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """(median): the value at place n // 2 from 0 of the sorted column, 0 without rows.

    Places come from counts of equal values, so no task sorts them all: values fall into 4096 ranges first.
    """
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not ends["n"]:
        return rows.sparkSession.createDataFrame([(0.0,)], "median double")
    width = (ends["hi"] - ends["lo"]) / 4096 or 1.0
    cell = F.least(F.floor((F.col(column) - ends["lo"]) / width), F.lit(4095))
    cells = rows.where(F.col(column).isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect()
    place, before = ends["n"] // 2, 0
    for r in cells:
        if before + r["n"] > place:
            break
        before += r["n"]
    inside = rows.where(cell == r["cell"]).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    upto = inside.withColumn("upto", F.sum("n").over(Window.orderBy("x")) + before)
    return upto.where(F.col("upto") > place).agg(F.min("x").alias("median"))


def diagnostics(pi: DataFrame, weights: DataFrame, h: float, C: int) -> DataFrame:
    """One row: mean largest share of a user and its floor 1/C, communities used as the largest, the weights' range, upper
    median and share of h or more, and whether that share is none."""
    top = pi.groupBy("v").agg(F.max("p").alias("p"), F.min(F.struct((-F.col("p")).alias("d"), "c")).alias("b"))
    a = top.agg(F.avg("p").alias("mean_top"), F.lit(1.0 / C).alias("uniform"), F.countDistinct("b.c").alias("n_communities"))
    b = weights.agg(F.coalesce(F.max("pp"), F.lit(0.0)).alias("pp_max"), F.coalesce(F.min("pp"), F.lit(0.0)).alias("pp_min"), F.coalesce(F.avg("pp"), F.lit(0.0)).alias("pp_mean"), F.coalesce(F.avg((F.col("pp") >= h).cast("double")), F.lit(0.0)).alias("share_of_h"))
    middle = upper_median(weights, "pp").toDF("pp_median")
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(middle)).withColumn("degenerate", F.col("share_of_h") == 0)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def ascii_table(header: list[str], rows: list[list]) -> str:
    """A Markdown table; columns whose non-empty cells are all numbers are right-aligned."""
    def text(x) -> str:
        return "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    cells = [[text(x) for x in row] for row in rows]
    width = [max([len(h), 3, *(len(r[j]) for r in cells)]) for j, h in enumerate(header)]
    right = [bool([r for r in cells if r[j]]) and all(number(r[j]) for r in cells if r[j]) for j in range(len(header))]
    line = lambda r: "| " + " | ".join(x.rjust(width[j]) if right[j] else x.ljust(width[j]) for j, x in enumerate(r)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + ":" if r else "-" * (w + 2) for w, r in zip(width, right, strict=True)) + "|"
    return "\n".join([line(header), rule, *map(line, cells)])

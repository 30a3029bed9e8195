"""One row of facts about a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.operators import graph

SECONDS_A_DAY = 86_400.0


def share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def summarize(edges: DataFrame, adoptions: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Sizes, degrees, density, attribute tokens, adoptions an item and an adopter, and the time they span.

    edges (u, v), adoptions (u, i, t), items (i, attrs).  Each table is one aggregation of one row.
    """
    n = users.agg(F.count("*").alias("n_users"))
    links = edges.agg(F.count("*").alias("n_links"))
    sizes = items.select(F.coalesce(F.size("attrs"), F.lit(0)).alias("k"))
    bags = sizes.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_attr_tokens"), F.coalesce(F.avg("k"), F.lit(0.0)).alias("attrs_per_item_mean"), F.count_if(F.col("k") == 0).alias("n_items_no_attrs"))
    span = (F.col("t_max") - F.col("t_min")) / F.lit(SECONDS_A_DAY)
    logs = adoptions.agg(F.count("*").alias("n_logs"), F.countDistinct("u").alias("n_adopters"), F.countDistinct("i").alias("n_adopted_items"), F.coalesce(F.min("t"), F.lit(0)).alias("t_min"), F.coalesce(F.max("t"), F.lit(0)).alias("t_max"))
    logs = logs.withColumns({"logs_per_item_mean": share(F.col("n_logs"), F.col("n_adopted_items")), "logs_per_user_mean": share(F.col("n_logs"), F.col("n_adopters")), "t_span_days": span})
    degrees = graph.degree_stats(edges, users)
    one = lambda d: degrees.where(F.col("direction") == d).select(*[F.col(c).alias(f"{d}_deg_{c}") for c in ("mean", "median", "max", "min", "zeros")])
    # Every table here has one row.
    out = n
    for other in (links, bags, logs, one("out"), one("in")):
        out = out.crossJoin(F.broadcast(other))
    return out.withColumn("density", share(F.col("n_links"), F.col("n_users") * (F.col("n_users") - F.lit(1.0))))


def table(ds) -> str:
    """summarize of a Dataset as a Markdown table."""
    from ripplecast.harness import ascii_table

    row = summarize(ds.edges, ds.adoptions, ds.items, ds.users).first()
    return ascii_table([str(ds.meta.get("name", "")), "value"], [[c, row[c]] for c in row.asDict()])

"""Datasets: edges (u, v), adoptions (u, i, t) and items (i, attrs), as TSV folders or Parquet."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    edges: DataFrame
    adoptions: DataFrame
    items: DataFrame
    meta: dict = field(default_factory=dict)

    @property
    def users(self) -> DataFrame:
        return self.edges.sparkSession.range(self.meta["n_users"]).select(F.col("id").alias("u"))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def located(spark: SparkSession, path: str) -> str | None:
    """path, or path.gz, or None."""
    return next((p for p in (path, path + ".gz") if exists(spark, p)), None)


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A TSV, plain or gzip, without blank and comment lines."""
    found = located(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return spark.read.schema(schema).csv(found, sep="\t", comment="#", quote="")


def widened(edges: DataFrame, adoptions: DataFrame, items: DataFrame, meta: dict) -> dict:
    """meta with cardinalities of at least the largest id + 1."""
    top = lambda df, c: df.agg(F.coalesce(F.max(c) + 1, F.lit(0))).first()[0]
    n_users = max(top(edges, "u"), top(edges, "v"), top(adoptions, "u"), meta.get("n_users", 0))
    n_items = max(top(adoptions, "i"), top(items, "i"), meta.get("n_items", 0))
    n_attrs = max(top(items.select(F.explode("attrs").alias("w")), "w"), meta.get("n_attrs", 0))
    return meta | {"n_users": n_users, "n_items": n_items, "n_attrs": n_attrs, "n_links": edges.count(), "n_logs": adoptions.count()}


def load(spark: SparkSession, path: str) -> Dataset:
    """A folder of graph.tsv, logs.tsv, items.tsv (may be missing) and meta.json (may be missing); repeated edges count once."""
    edges = table(spark, f"{path}/graph.tsv", "u long, v long").distinct()
    adoptions = table(spark, f"{path}/logs.tsv", "u long, i long, t long")
    if located(spark, f"{path}/items.tsv"):
        bags = F.transform(F.filter(F.split(F.coalesce("bag", F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
        items = table(spark, f"{path}/items.tsv", "i long, bag string").groupBy("i").agg(F.max("bag").alias("bag")).select("i", bags.alias("attrs"))
    else:
        items = spark.createDataFrame([], "i long, attrs array<long>")
    meta = {}
    if located(spark, f"{path}/meta.json"):
        meta = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/meta.json").collect()))
    meta.setdefault("name", path.rstrip("/").rsplit("/", 1)[-1])
    return Dataset(edges, adoptions, items, widened(edges, adoptions, items, meta))


def save(ds: Dataset, path: str) -> None:
    """The same layout, each table a folder of one file named .tsv, logs in order of (t, u, i), every item a line."""
    one = lambda df, name: df.coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", sep="\t", emptyValue="", quote="")
    spark = ds.edges.sparkSession
    one(ds.edges.select("u", "v").orderBy("u", "v"), "graph.tsv")
    one(ds.adoptions.select("u", "i", "t").orderBy("t", "u", "i"), "logs.tsv")
    every = spark.range(ds.meta["n_items"]).select(F.col("id").alias("i")).join(ds.items, "i", "left")
    one(every.select("i", F.array_join(F.coalesce("attrs", F.array().cast("array<long>")), ",").alias("bag")).orderBy("i"), "items.tsv")
    spark.createDataFrame([(json.dumps(ds.meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")


def dense(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the rank of each distinct value, from 0; ranks within hash-free ranges, no task sees all."""
    keys = rows.select(column).where(F.col(column).isNotNull()).distinct()
    parts = keys.repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1)
    from ripplecast.operators.lineage import stable

    parts = stable(parts)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return parts.join(F.broadcast(shift), "_p").select(column, (F.col("_r") + F.col("_s")).alias(name))


def renumber(edges: DataFrame, adoptions: DataFrame, bags: DataFrame, meta: dict) -> Dataset:
    """Dense ids by order of the old: users of edges and adoptions, items of adoptions, the attributes those use."""
    keys = edges.select(F.col("u").alias("k")).union(edges.select("v")).union(adoptions.select("u"))
    user, item = dense(keys, "k", "n"), dense(adoptions.select(F.col("i").alias("k")), "k", "n")
    tok = bags.select(F.col("i").alias("k"), "attrs").join(item, "k").select(F.col("n").alias("i"), F.posexplode_outer("attrs").alias("pos", "k"))
    attr = dense(tok, "k", "w")
    items = tok.join(attr, "k", "left").groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("pos", "w")))), lambda x: x["w"]).alias("attrs"))
    e = edges.join(user.toDF("u", "a"), "u").join(user.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    logs = adoptions.join(user.toDF("u", "a"), "u").join(item.toDF("i", "b"), "i").select(F.col("a").alias("u"), F.col("b").alias("i"), "t")
    ds = Dataset(e, logs, items, meta)
    return replace(ds, meta=widened(e, logs, items, meta))

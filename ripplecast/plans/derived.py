"""The domain relations, derived from the driver's tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplecast.functions.randomness import u01, u01_sql

DAY = 86_400
DELTA = 365 * DAY
C, Z = 5, 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adoptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, i, t) of customers and parts, repeats included."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"), F.unix_timestamp("o_orderdate").alias("t"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("i"))
    return items.join(o, "k").select("u", "i", "t")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, i, t) of purchase events, the item in their JSON."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("i"), F.unix_timestamp("ts").alias("t")).where("i is not null")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): customers of a nation, v one to eight places after u by balance.

    Eight lags, not a join of a nation with itself.
    """
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), F.array(*[F.lead("c_custkey", k).over(w) for k in range(1, 9)]).alias("vs"))
    return rows.select("u", F.explode(F.filter("vs", lambda v: v.isNotNull())).alias("v"))


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): a cyclic relation, v one to eight places on around the customers."""
    n = read(spark, sf_dir, "customer").count()
    return users(spark, sf_dir).select("u", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select("u", F.pmod(F.col("u") + F.col("k"), F.lit(n)).alias("v"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, pos, label, z): three attribute tokens a part with a hash-assigned topic."""
    labels = F.array(F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("t:"), "p_type"), F.concat(F.lit("s:"), F.floor(F.col("p_size") / 10)))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.posexplode(labels).alias("pos", "label"))
    return rows.withColumn("z", F.floor(u01(1, F.col("i"), F.col("pos")) * Z).cast("int"))


def attributes(tokens_: DataFrame) -> DataFrame:
    """(w, label): dense ids of the labels in order."""
    return tokens_.select("label").distinct().withColumn("w", F.dense_rank().over(Window.orderBy("label")) - 1).select("w", "label")


def events(edges_: DataFrame, logs: DataFrame) -> DataFrame:
    """(kind, u, v, i, cp, c): links and logs with hash-assigned communities."""
    rows = edges_.select(F.lit(0).alias("kind"), "u", "v", F.lit(-1).cast("long").alias("i")).union(logs.select(F.lit(1), "u", "v", "i"))
    draw = lambda seed: F.floor(u01(seed, F.col("kind"), F.col("u"), F.col("v"), F.col("i")) * C).cast("int")
    return rows.withColumn("cp", draw(2)).withColumn("c", draw(3))


CTES = f"""
adoptions AS (SELECT o_custkey AS u, l_partkey AS i, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
adopt AS (SELECT u, i, min(t) AS t FROM adoptions GROUP BY u, i),
buys AS (SELECT user_id AS u, CAST(json_extract_string(props,'$.k') AS BIGINT) AS i, CAST(epoch(ts) AS BIGINT) AS t FROM events WHERE event_type='purchase'),
buy AS (SELECT u, i, min(t) AS t FROM buys WHERE i IS NOT NULL GROUP BY u, i),
ranked AS (SELECT c_custkey AS u, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer),
edge AS (SELECT a.u, b.u AS v FROM ranked a JOIN ranked b ON a.n=b.n AND b.r-a.r BETWEEN 1 AND 8),
users AS (SELECT c_custkey AS u FROM customer),
ring AS (SELECT u, (u+k)%(SELECT count(*) FROM customer) AS v FROM users, range(1,9) r(k)),
logs AS (SELECT a.u, e.v, a.i FROM adopt a JOIN edge e ON a.u=e.u JOIN adopt b ON b.i=a.i AND b.u=e.v WHERE b.t>a.t AND b.t-a.t<={DELTA}),
labels5 AS (SELECT c_custkey AS u, dense_rank() OVER (ORDER BY c_mktsegment)-1 AS c FROM customer),
tok0 AS (SELECT p_partkey AS i, 0 AS pos, 'b:'||p_brand AS label FROM part UNION ALL SELECT p_partkey, 1, 't:'||p_type FROM part UNION ALL SELECT p_partkey, 2, 's:'||CAST(floor(p_size/10) AS INT) FROM part),
tok AS (SELECT *, CAST(floor({u01_sql('1', 'i', 'pos')}*{Z}) AS INT) AS z FROM tok0),
attr AS (SELECT label, dense_rank() OVER (ORDER BY label)-1 AS w FROM (SELECT DISTINCT label FROM tok0)),
ev0 AS (SELECT 0 AS kind, u, v, -1 AS i FROM edge UNION ALL SELECT 1, u, v, i FROM logs),
ev AS (SELECT *, CAST(floor({u01_sql('2', 'kind', 'u', 'v', 'i')}*{C}) AS INT) AS cp, CAST(floor({u01_sql('3', 'kind', 'u', 'v', 'i')}*{C}) AS INT) AS c FROM ev0),
zs AS (SELECT CAST(range AS INT) AS z FROM range({Z})), cs AS (SELECT CAST(range AS INT) AS c FROM range({C})),
sizes AS (SELECT (SELECT count(*) FROM users)::DOUBLE AS nu, (SELECT count(*) FROM edge)::DOUBLE AS ne, (SELECT count(*) FROM logs)::DOUBLE AS nd),
hyp AS (SELECT 50.0/{C} AS rho, 50.0/{Z} AS alpha, 0.01 AS beta, 50.0/{Z} AS omega, ln((nu*(nu-1)*(1+nd/ne)-nd-ne)/({C}*{C})) AS eps0, 0.1 AS eps1 FROM sizes),
phi AS (SELECT p.i, z, (coalesce(n,0)+omega)/(coalesce(t,0)+{Z}*omega) AS p FROM (SELECT p_partkey AS i FROM part) p CROSS JOIN zs CROSS JOIN hyp LEFT JOIN (SELECT i, z, count(*) AS n FROM tok GROUP BY i, z) USING (i, z) LEFT JOIN (SELECT i, count(*) AS t FROM tok GROUP BY i) USING (i)),
psi AS (SELECT z, w, (coalesce(n,0)+beta)/(coalesce(t,0)+(SELECT count(*) FROM attr)*beta) AS p FROM attr CROSS JOIN zs CROSS JOIN hyp LEFT JOIN (SELECT z, w, count(*) AS n FROM tok JOIN attr USING (label) GROUP BY z, w) USING (z, w) LEFT JOIN (SELECT z, count(*) AS t FROM tok GROUP BY z) USING (z)),
side AS (SELECT u AS v, cp AS c FROM ev UNION ALL SELECT v, c FROM ev),
pi AS (SELECT uu.v, c, (coalesce(n,0)+rho)/(coalesce(t,0)+{C}*rho) AS p FROM (SELECT u AS v FROM users) uu CROSS JOIN cs CROSS JOIN hyp LEFT JOIN (SELECT v, c, count(*) AS n FROM side GROUP BY v, c) USING (v, c) LEFT JOIN (SELECT v, count(*) AS t FROM side GROUP BY v) USING (v)),
eta AS (SELECT a.c AS cp, b.c, (coalesce(n,0)+eps1)/(coalesce(n,0)+eps0+eps1) AS p FROM cs a CROSS JOIN cs b CROSS JOIN hyp LEFT JOIN (SELECT cp AS xp, c AS x, count(*) AS n FROM ev GROUP BY cp, c) ON xp=a.c AND x=b.c),
soft AS (SELECT c, z, sum(p) AS s FROM ev JOIN phi USING (i) WHERE kind=1 GROUP BY c, z),
theta AS (SELECT c, z, (coalesce(s,0)+alpha)/(sum(coalesce(s,0)) OVER (PARTITION BY c)+{Z}*alpha) AS p FROM cs CROSS JOIN zs CROSS JOIN hyp LEFT JOIN soft USING (c, z)),
tops AS (SELECT i AS item FROM (SELECT i, count(*) AS n FROM adopt GROUP BY i ORDER BY n DESC, i LIMIT 3)),
bar AS (SELECT f.i AS item, t.c, sum(f.p*t.p) AS b FROM phi f JOIN tops ON f.i=item JOIN theta t USING (z) GROUP BY f.i, t.c),
au AS (SELECT v AS u, eta.c, sum(pi.p*eta.p) AS a FROM pi JOIN eta ON eta.cp=pi.c GROUP BY v, eta.c),
pp AS (SELECT item, e.u, e.v, sum(a*pi.p*b) AS raw FROM edge e JOIN au ON au.u=e.u JOIN pi ON pi.v=e.v AND pi.c=au.c JOIN bar ON bar.c=au.c GROUP BY item, e.u, e.v)
"""


def sql(body: str) -> str:
    return f"WITH RECURSIVE {CTES} {body}"

"""Readers of the public vote and review exports: friend arcs, votes, businesses, reviews, friends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.operators import logs, subsample
from ripplecast.sources.datasets import Dataset, located, renumber

#: Names of the public vote exports (fixed values), friends first.
VOTE_FILES = [("digg_friends.csv", "digg_votes1.csv"), ("digg_friends.csv", "digg_votes.csv"), ("out.digg-friends", "out.digg-votes")]
VOTE_DAY = 86_400


def is_csv(spark: SparkSession, path: str) -> bool:
    """By the first non-empty line: commas make it CSV, whitespace the column format with % comments."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return bool(first) and "," in first[0].value and not first[0].value.startswith("%")


def fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    """(f array) of the rows with least or more whitespace columns, comments left out."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '%')")
    return rows.select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= least)


def quoted(spark: SparkSession, path: str, least: int) -> DataFrame:
    """(f array) of comma rows, quotes off; a header or any row without integers drops out in the caller's casts."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.transform(F.split("value", ","), lambda x: F.regexp_replace(F.trim(x), '"', "")).alias("f")).where(F.size("f") >= least)


def whole(at: int) -> Column:
    return F.expr(f"try_cast(f[{at}] as bigint)")


def friend_arcs(spark: SparkSession, path: str, influence: bool = True) -> DataFrame:
    """(u, v) without self-loops; influence turns a watcher's arc around, from the watched to the watcher."""
    rows = quoted(spark, path, 4).select(whole(2).alias("a"), whole(3).alias("b")) if is_csv(spark, path) else fields(spark, path, 2).select(whole(0).alias("a"), whole(1).alias("b"))
    u, v = ("b", "a") if influence else ("a", "b")
    return rows.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")


def votes(spark: SparkSession, path: str) -> DataFrame:
    """(u, i, t)."""
    if is_csv(spark, path):
        rows = quoted(spark, path, 3).select(whole(1).alias("u"), whole(2).alias("i"), whole(0).alias("t"))
    else:
        rows = fields(spark, path, 4).select(whole(0).alias("u"), whole(1).alias("i"), whole(3).alias("t"))
    return rows.where("u is not null and i is not null and t is not null")


def find_vote_files(spark: SparkSession, raw: str) -> tuple[str, str]:
    """(friends, votes) of a raw folder: the CSV pair, whose ids match, before the column exports."""
    pairs = [(f"{raw}/{a}", f"{raw}/{b}") for a, b in VOTE_FILES]
    for friends, votes_path in pairs:
        found = located(spark, friends), located(spark, votes_path)
        if all(found):
            return found
    raise FileNotFoundError(f"{raw} holds no pair of friends and votes files; looked for " + ", ".join(f"{a} with {b}" for a, b in VOTE_FILES))


def vote_attributes(first: DataFrame, buckets: int = 32, draws: int = 2) -> DataFrame:
    """(i, attrs of strings): popularity decile, life span by powers of two of minutes, three-hour band and weekday of
    the first vote (UTC), decile of the share of votes in the first hour, and draws hashes of the id."""
    start = first.groupBy("i").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    early = first.join(start, "i").where("t - t0 <= 3600").groupBy("i").agg(F.count("*").alias("early"))
    rows = start.join(early, "i").join(logs.popularity(first, descending=False), "i")
    minutes = F.floor(F.log2((F.col("t1") - F.col("t0")) / 60 + 1))
    tags = [
        ("popular", F.col("decile")),
        ("life", F.least(minutes, F.lit(11))),
        ("band", F.floor(F.pmod(F.col("t0"), F.lit(VOTE_DAY)) / 10_800)),
        ("weekday", F.pmod(F.floor(F.col("t0") / VOTE_DAY) + 4, F.lit(7))),
        ("burst", F.least(F.floor(F.col("early") * 10 / F.col("n")), F.lit(9))),
        *[(f"id{k}", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "i", F.lit(k)).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(buckets))) for k in range(draws if buckets > 0 else 0)],
    ]
    return rows.select("i", F.array_sort(F.array(*[F.concat(F.lit(f"{name}:"), value.cast("string")) for name, value in tags])).alias("attrs"))


def epoch(text: Column) -> Column:
    """Unix seconds of a date with or without a time, in UTC; 0 for anything else."""
    day = F.when(F.length(F.trim(text)) == 10, F.concat(F.trim(text), F.lit(" 00:00:00"))).otherwise(F.trim(text))
    seconds = F.try_to_timestamp(F.concat(day, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    return F.coalesce(F.unix_seconds(seconds), F.lit(0).cast("long"))


def names(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "None")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", quote="")


def review_tables(spark: SparkSession, raw: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(business (b, attrs), review (k, b, t), friend (k, list)) of the JSON export, else of its streamed TSVs."""
    official = {n: located(spark, f"{raw}/yelp_academic_dataset_{n}.json") for n in ("business", "review", "user")}
    if all(official.values()):
        business = json_lines(spark, official["business"], "business_id string, categories string").select(F.col("business_id").alias("b"), names(F.col("categories")).alias("attrs"))
        review = json_lines(spark, official["review"], "user_id string, business_id string, date string").select(F.col("user_id").alias("k"), F.col("business_id").alias("b"), epoch(F.col("date")).alias("t"))
        friend = json_lines(spark, official["user"], "user_id string, friends string").select(F.col("user_id").alias("k"), names(F.col("friends")).alias("list"))
        return business, review, friend
    for root in (f"{raw}/stream", raw):
        found = {n: located(spark, f"{root}/{n}.tsv") for n in ("businesses", "reviews", "friends", "categories")}
        if all(found.values()):
            cat = tsv(spark, found["categories"], "c string, name string")
            ids = tsv(spark, found["businesses"], "b string, cats string").select("b", F.posexplode_outer(names(F.col("cats"))).alias("pos", "c"))
            business = ids.join(F.broadcast(cat), "c", "left").groupBy("b").agg(F.array_distinct(F.collect_list("name")).alias("attrs"))
            review = tsv(spark, found["reviews"], "k string, b string, t long")
            friend = tsv(spark, found["friends"], "k string, list string").select("k", names(F.col("list")).alias("list"))
            return business, review, friend
    raise FileNotFoundError(f"{raw} holds neither the JSON export (business, review, user) nor its streamed tables")


def friendships(friend: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v) both ways for each pair of known users of whom one lists the other."""
    rows = friend.select(F.col("k").alias("x"), F.explode("list").alias("y")).where("x <> y")
    rows = rows.join(known.toDF("x"), "x", "left_semi").join(known.toDF("y"), "y", "left_semi")
    pair = rows.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    return pair.union(pair.select("v", "u"))


def cut(edges: DataFrame, first: DataFrame, users: int, links: int, items: int) -> tuple[DataFrame, DataFrame]:
    """The active users' dense core, thinned arcs and most adopted items; a target of 0 or less cuts nothing."""
    keep = logs.active_users(first, edges).distinct()
    edges, first = subsample.induced(edges, keep), first.join(keep, "u", "left_semi")
    if users > 0:
        core = subsample.dense_core(edges, logs.activity(first), users)
        edges, first = subsample.induced(edges, core), first.join(core, "u", "left_semi")
    if links > 0:
        edges = subsample.thin(edges, logs.activity(first), links)
    if items > 0:
        first = first.join(F.broadcast(logs.top_items(first, items).select("i")), "i", "left_semi")
    return edges, first


def prepare_votes(spark: SparkSession, friends: str, votes_path: str, users: int = 0, links: int = 0, items: int = 0, buckets: int = 64) -> Dataset:
    """Votes are required: adoptions are never made up in silence."""
    edges = friend_arcs(spark, friends).distinct()
    first = logs.first_adoption(votes(spark, votes_path))
    edges, first = cut(edges, first, users, links, items)
    return renumber(edges, first, vote_attributes(first, buckets), {"name": "votes"})


def prepare_reviews(spark: SparkSession, raw: str, users: int = 0, links: int = 0, items: int = 0, prefilter: int = 0) -> Dataset:
    """A user's review of a known business is an adoption at its earliest date."""
    business, review, friend = review_tables(spark, raw)
    business = business.groupBy("b").agg(F.min("attrs").alias("attrs"))
    first = review.where("k is not null and b is not null").join(business.select("b"), "b", "left_semi").groupBy(F.col("k").alias("u"), F.col("b").alias("i")).agg(F.min("t").alias("t"))
    if prefilter > 0 or users > 0:
        first = first.join(subsample.top_active(logs.activity(first), prefilter or 2 * users), "u", "left_semi")
    known = first.select(F.col("u").alias("k")).distinct()
    edges = friendships(friend, known)
    if max(users, links, items) > 0:
        flat = renumber(edges, first, business.select(F.col("b").alias("i"), "attrs"), {"name": "reviews"})
        e, f = cut(flat.edges, flat.adoptions, users, links, items)
        return renumber(e, f, flat.items, {"name": "reviews"})
    return renumber(edges, first, business.select(F.col("b").alias("i"), "attrs"), {"name": "reviews"})

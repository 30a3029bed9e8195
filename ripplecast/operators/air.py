"""The topic-aware influence model: trials from logs, EM in relational steps, and its edge weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.functions.randomness import u01
from ripplecast.operators.lineage import release, stable
from ripplecast.operators.logs import least_hashed
from ripplecast.operators.model import grid, vector, with_each

LOW = 1e-9


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LOW)), F.lit(1 - LOW))


def trials(adoptions: DataFrame, edges: DataFrame, positives: DataFrame, per_positive: int | None = None, seed: int = 0) -> DataFrame:
    """(u, v, i, y): logs are successes; other out-edges of an item's adopters are failures, per_positive for each of
    the item's successes at most, a uniform sample by seeded hash order.

    The logs are derived once.  Edges, logs and their items are merged: an estimate of their size (derived edges may be
    many times what they are read from, and rows many times the file that holds them) never sends them through the driver.
    """
    pos = stable(positives.select("u", "v", "i").distinct())
    items = pos.select("i").distinct()
    adopters = adoptions.select("u", "i").join(items.hint("merge"), "i", "left_semi").distinct()
    neg = adopters.join(edges.select("u", "v").distinct().hint("merge"), "u").select("u", "v", "i").join(pos.hint("merge"), ["u", "v", "i"], "left_anti")
    if per_positive is not None:
        caps = pos.groupBy("i").agg((F.count("*") * per_positive).alias("cap"))
        neg = least_hashed(neg, "i", caps, u01(seed, F.col("u"), F.col("v"), F.col("i")), ["u", "v"])
    return pos.withColumn("y", F.lit(1)).union(neg.withColumn("y", F.lit(0)))


def start(keys: DataFrame, key: str, Z: int, seed: int, tag: str, scale: float) -> DataFrame:
    """(key, z, p): scale times a hash uniform in (0.5, 1.5), the start of a parameter."""
    rows = keys.select(key).distinct().crossJoin(grid(keys.sparkSession, Z, "z"))
    return rows.select(key, "z", (scale * (0.5 + u01(seed, tag, F.col(key), F.col("z")))).alias("p"))


def initial(tr: DataFrame, Z: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A (u, z, p), I (v, z, p), gamma (i, z, p)."""
    g = start(tr, "i", Z, seed, "g", 1.0)
    total = g.groupBy("i").agg(F.sum("p").alias("t"))
    return start(tr, "u", Z, seed, "a", 0.25), start(tr, "v", Z, seed, "b", 0.25), g.join(total, "i").select("i", "z", (F.col("p") / F.col("t")).alias("p"))


def responsibilities(tr: DataFrame, A: DataFrame, I: DataFrame, gamma: DataFrame) -> DataFrame:  # noqa: E741
    """(u, v, i, y, a, b, w): each trial with its ends' parameters and its joint weights, arrays over topics."""
    ab = vector(A, "u", "z").toDF("u", "a"), vector(I, "v", "z").toDF("v", "b")
    rows = tr.join(ab[0], "u").join(ab[1], "v").join(vector(gamma, "i", "z").toDF("i", "g"), "i")
    both = F.zip_with("a", "b", lambda x, y: F.when(F.col("y") == 1, x * y).otherwise(1 - x * y))
    return rows.select("u", "v", "i", "y", "a", "b", F.zip_with("g", both, lambda g, x: g * x).alias("w"))


def total(values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def log_posterior(tr: DataFrame, A: DataFrame, I: DataFrame, gamma: DataFrame, prior_a: float = 0.5, prior_b: float = 1.5, prior_gamma: float = 0.5) -> float:  # noqa: E741
    like = responsibilities(tr, A, I, gamma).agg(F.sum(F.ln(F.greatest(total("w"), F.lit(LOW)))).alias("l")).first()[0] or 0.0
    return like + log_prior(A, I, gamma, prior_a, prior_b, prior_gamma)


def log_prior(A: DataFrame, I: DataFrame, gamma: DataFrame, prior_a: float = 0.5, prior_b: float = 1.5, prior_gamma: float = 0.5) -> float:  # noqa: E741
    beta = lambda df: df.agg(F.sum(prior_a * F.ln(F.greatest("p", F.lit(LOW))) + prior_b * F.ln(F.greatest(1 - F.col("p"), F.lit(LOW))))).first()[0] or 0.0
    g = gamma.agg(F.sum(prior_gamma * F.ln(F.greatest("p", F.lit(LOW))))).first()[0] or 0.0
    return beta(A) + beta(I) + g


def shares(tr: DataFrame, A: DataFrame, I: DataFrame, gamma: DataFrame) -> DataFrame:  # noqa: E741
    """(u, v, i, r, na, nb, l) as a table: each trial's topics, its counts for both ends and its log likelihood."""
    rows = responsibilities(tr, A, I, gamma).withColumn("t", total("w"))
    rows = rows.withColumn("r", F.transform("w", lambda x: F.when(F.col("t") > 0, x / F.col("t")).otherwise(0.0)))
    # A failure counts for a topic by the chance that this side would have done its part, the other not.
    part_of = lambda x, y: F.zip_with(F.zip_with(x, y, lambda p, q: F.when(1 - p * q > LOW, p * (1 - q) / (1 - p * q)).otherwise(0.0)), "r", lambda share, r: F.when(F.col("y") == 1, r).otherwise(r * share))
    return stable(rows.select("u", "v", "i", "r", part_of("a", "b").alias("na"), part_of("b", "a").alias("nb"), F.ln(F.greatest("t", F.lit(LOW))).alias("l")))


def em_step(tr: DataFrame, A: DataFrame, I: DataFrame, gamma: DataFrame, Z: int, prior_a: float = 0.5, prior_b: float = 1.5, prior_gamma: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: E741
    """One closed-form sweep: a trial is one row whatever the number of topics, and each parameter one aggregation of it."""
    return maximised(shares(tr, A, I, gamma), Z, prior_a, prior_b, prior_gamma)


def maximised(rows: DataFrame, Z: int, prior_a: float = 0.5, prior_b: float = 1.5, prior_gamma: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(A, I, gamma) of shares."""
    sums = lambda name: F.array(*[F.sum(F.get(F.col(name), F.lit(z))) for z in range(Z)])

    def part(key: str, num: str) -> DataFrame:
        found = rows.groupBy(key).agg(sums(num).alias("n"), sums("r").alias("d"))
        flat = found.select(key, F.posexplode(F.zip_with("n", "d", lambda n, d: (n + prior_a) / (d + prior_a + prior_b))).alias("z", "p"))
        return flat.select(key, "z", clamp(F.col("p")).alias("p"))

    g = rows.groupBy("i").agg(F.transform(sums("r"), lambda x: x + prior_gamma).alias("g"))
    return part("u", "na"), part("v", "nb"), g.select("i", F.posexplode(F.transform("g", lambda x: x / total("g"))).alias("z", "p"))


def fit(tr: DataFrame, Z: int, sweeps: int, seed: int, tol: float = 1e-4, last: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    """(A, I, gamma, objective a sweep); ends when the relative gain falls below tol.

    An objective is summed from the shares that the next sweep takes; without last, that after the last sweep is left out.
    """
    tr = stable(tr)
    found = tuple(stable(x) for x in initial(tr, Z, seed))
    seen: list[float] = []
    for _ in range(sweeps):
        rows = shares(tr, *found)
        seen.append((rows.agg(F.sum("l")).first()[0] or 0.0) + log_prior(*found))
        if settled(seen, tol):
            release(rows)
            return *found, seen
        new = tuple(stable(x) for x in maximised(rows, Z))
        release(rows, *found)
        found = new
    if last:
        seen.append(log_posterior(tr, *found))
    return *found, seen


def settled(seen: list[float], tol: float) -> bool:
    return len(seen) > 1 and seen[-1] - seen[-2] < tol * max(1.0, abs(seen[-2]))


def edge_weights(edges: DataFrame, items: DataFrame, A: DataFrame, I: DataFrame, gamma: DataFrame, Z: int) -> DataFrame:  # noqa: E741
    """(item, u, v, pp) for every edge and item: sum of gamma A I, clamped; unseen users and items take 0.25 and 1/Z."""
    flat = lambda p: F.array_repeat(F.lit(p), Z)
    a, b = vector(A, "u", "z").toDF("u", "a"), vector(I, "v", "z").toDF("v", "b")
    g = items.select("item").join(vector(gamma, "i", "z").toDF("item", "g"), "item", "left").select("item", F.coalesce("g", flat(1.0 / Z)).alias("g"))
    rows = edges.join(a, "u", "left").join(b, "v", "left").select("u", "v", F.zip_with(F.coalesce("a", flat(0.25)), F.coalesce("b", flat(0.25)), lambda x, y: x * y).alias("ab"))
    dot = F.aggregate(F.zip_with("ab", "g", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return with_each(rows, g).select("item", "u", "v", F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0)).alias("pp"))

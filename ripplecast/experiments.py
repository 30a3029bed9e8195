"""Experiments: prepare a dataset, fit the model, sweep methods over seed counts and the model over its sizes, judge.

Every relation stays a DataFrame; only seeds (k a run), points (one a run) and model sizes reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast import harness
from ripplecast.operators import air, cascade, communities, gibbs, logs, model, spread
from ripplecast.operators.lineage import stable
from ripplecast.sources.datasets import Dataset

#: Methods in the order in which their spread is expected to fall.
METHODS = ("model", "model_cga", "air_cga", "cinema", "greedy")
USERS_A_COMMUNITY, DAY = 40, 86_400
PARAMETER = "value int, spread double, fit_seconds double, select_seconds double, n_runs int, n_communities long, pp_max double, degenerate boolean, status string"


@dataclass(frozen=True)
class Config:
    C: int = 100
    Z: int = 8
    ks: tuple[int, ...] = (1, 11, 21, 31, 41, 51)
    methods: tuple[str, ...] = METHODS
    seed: int = 42
    n_items: int = 10
    runs: int = 200
    topic_sweeps: int = 200
    community_sweeps: int = 200
    exact: bool = True
    exact_communities: bool = True
    h: float = 0.1
    literal: bool = False
    delta: int = 30 * DAY
    cap: int = 0
    zeta: float = 1.0
    em_sweeps: int = 50
    top_c: int = 0
    z_grid: tuple[int, ...] = (2, 4, 6, 8, 10, 12, 14, 16)
    c_grid: tuple[int, ...] = (25, 50, 75, 100, 125, 150)
    k_of_grids: int = 20
    sweeps: tuple[str, ...] = ("k", "Z", "C")
    notes: tuple[str, ...] = ()

    def quick(self) -> Config:
        """The same experiment with fewer sweeps, samples, items and logs an item."""
        return replace(self, topic_sweeps=min(self.topic_sweeps, 30), community_sweeps=min(self.community_sweeps, 30), runs=min(self.runs, 20), n_items=min(self.n_items, 3), em_sweeps=min(self.em_sweeps, 8), cap=self.cap if self.cap > 0 else 20)

    def fitted_to(self, n_users: int) -> Config:
        """C lowered, never raised, to a community for every USERS_A_COMMUNITY users (two at least); its grid keeps its shape."""
        most = max(2, min(self.C, n_users // USERS_A_COMMUNITY))
        if most >= self.C:
            return self
        grid = sorted({max(2, round(most * c / self.C)) for c in self.c_grid} | {most})
        return replace(self, C=most, c_grid=tuple(grid), notes=(*self.notes, f"C lowered from {self.C} to {most}: the graph has {n_users} users"))

    def seed_of(self, k: int, item: int) -> int:
        return (self.seed * 31 + k) * 1_000_003 + item


@dataclass
class Experiment:
    """A prepared dataset with lazily fitted methods."""

    spark: SparkSession
    ds: Dataset
    config: Config
    seconds: dict[str, float] = field(default_factory=dict)

    def timed(self, name: str, work: Callable):
        began = time.time()
        out = work()
        self.seconds[name] = self.seconds.get(name, 0.0) + time.time() - began
        return out

    @cached_property
    def logs(self) -> DataFrame:
        """(u, v, i, split): potential-influence logs, capped an item if asked, split by hash order."""
        def make() -> DataFrame:
            found = logs.influence_logs(self.ds.adoptions, self.ds.edges, self.config.delta)
            if self.config.cap > 0:
                found = logs.cap_per_item(found, self.config.cap, self.config.seed)
            return stable(logs.split_logs(found, self.config.seed))

        return self.timed("logs", make)

    @cached_property
    def train_logs(self) -> DataFrame:
        return self.logs.where("split = 'train'").select("u", "v", "i")

    @cached_property
    def items(self) -> list[int]:
        """Items with most test logs; where there are none, with most logs, then with most adopters."""
        def most(rows: DataFrame) -> list[int]:
            return [r.i for r in rows.groupBy("i").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "i").limit(self.config.n_items).collect()]

        return most(self.logs.where("split = 'test'")) or most(self.logs) or most(self.ds.adoptions.select("u", "i").distinct())

    @cached_property
    def item_table(self) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in self.items], "item long")

    def fit(self, C: int, Z: int) -> gibbs.Model:
        cfg, ds = self.config, self.ds
        tokens = ds.items.select("i", F.posexplode("attrs").alias("pos", "w"))
        every = self.spark.range(ds.meta["n_items"]).select(F.col("id").alias("i"))
        return self.timed(f"fit C={C} Z={Z}", lambda: gibbs.train(ds.users, every, tokens, ds.edges, self.train_logs, max(1, ds.meta["n_attrs"]), C, Z, cfg.topic_sweeps, cfg.community_sweeps, cfg.seed, cfg.zeta, cfg.exact))

    def weights_of(self, m: gibbs.Model) -> DataFrame:
        return stable(model.edge_weights(self.ds.edges, self.item_table, m.pi, m.eta, m.theta, m.phi, self.config.top_c))

    @cached_property
    def model(self) -> gibbs.Model:
        return self.fit(self.config.C, self.config.Z)

    @cached_property
    def weights(self) -> DataFrame:
        """The reference model's (item, u, v, pp, raw): all methods are scored by these."""
        return self.weights_of(self.model)

    @cached_property
    def evaluate(self) -> Callable[[int, DataFrame], float]:
        return harness.evaluator(self.weights, self.config.h)

    @cached_property
    def labels(self) -> DataFrame:
        return stable(model.detect_communities(self.model.pi).toDF("u", "c"))

    @cached_property
    def blind(self) -> DataFrame:
        """(u, v, pp): weights averaged over the items, for methods that don't look at topics."""
        return stable(model.averaged_pp(self.weights, len(self.items)))

    @cached_property
    def found_communities(self) -> DataFrame:
        return self.timed("modularity", lambda: stable((communities.exact if self.config.exact_communities else communities.merged)(self.ds.edges, self.ds.users, self.config.C)))

    @cached_property
    def air_weights(self) -> DataFrame:
        def make() -> DataFrame:
            cfg = self.config
            tr = air.trials(self.ds.adoptions, self.ds.edges, self.train_logs, per_positive=3, seed=cfg.seed)
            A, I, gamma, _ = air.fit(tr, cfg.Z, cfg.em_sweeps, cfg.seed)  # noqa: E741
            return stable(air.edge_weights(self.ds.edges, self.item_table, A, I, gamma, cfg.Z))

        return self.timed("em", make)

    @cached_property
    def conformity_weights(self) -> DataFrame:
        """blind scaled by profiles from adoptions of items that are not scored."""
        def make() -> DataFrame:
            kept = self.ds.adoptions.join(F.broadcast(self.item_table.toDF("i")), "i", "left_anti")
            profile = logs.conformity(kept, self.ds.edges, self.ds.users, self.config.delta, 5.0)
            return stable(cascade.conformity_pp(self.blind, profile))

        return self.timed("conformity", make)

    def of_item(self, weights: DataFrame, item: int) -> DataFrame:
        return weights.where(F.col("item") == item).select("u", "v", "pp")

    def select(self, method: str, k: int, item: int) -> DataFrame:
        """(rank, u)"""
        cfg, seed = self.config, self.config.seed_of(k, item) % (1 << 31)
        if method == "model":
            return spread.select_seeds(self.of_item(self.weights, item), self.labels, cfg.h, k, cfg.literal)
        if method == "model_cga":
            return cascade.select_cga(self.of_item(self.weights, item), self.labels, k, cfg.runs, seed)
        if method == "air_cga":
            return cascade.select_cga(self.of_item(self.air_weights, item), self.found_communities, k, cfg.runs, seed)
        if method == "cinema":
            return cascade.select_cinema(self.conformity_weights, self.found_communities, k, cfg.runs, seed)
        if method == "greedy":
            return cascade.monte_carlo_greedy(self.blind, self.ds.users, k, cfg.runs, seed).select("rank", "u")
        raise ValueError(f"unknown method: {method}")

    def k_sweep(self) -> DataFrame:
        """harness.POINT rows; a method blind to topics selects once for each k and is scored on all items."""
        methods = {m: (lambda item, k, m=m: self.select(m, k, item)) for m in self.config.methods}
        return harness.sweep(self.spark, methods, list(self.config.ks), self.items, self.evaluate, once=("cinema", "greedy"))

    def parameter_sweep(self, name: str) -> DataFrame:
        """PARAMETER rows: the model refitted at each value of C or Z, its seeds scored by the reference weights."""
        cfg, out = self.config, []
        for value in cfg.c_grid if name == "C" else cfg.z_grid:
            C, Z = (value, cfg.Z) if name == "C" else (cfg.C, value)
            began = time.time()
            try:
                m = self.model if (C, Z) == (cfg.C, cfg.Z) else self.fit(C, Z)
                w = self.weights if m is self.model else self.weights_of(m)
                fitted = self.seconds.get(f"fit C={C} Z={Z}", 0.0)
                labels = self.labels if m is self.model else stable(model.detect_communities(m.pi).toDF("u", "c"))
                top = self.of_item(w, self.items[0]).agg(F.coalesce(F.max("pp"), F.lit(0.0))).first()[0]
                spreads, took = [], 0.0
                for item in self.items:
                    start = time.time()
                    seeds = spread.select_seeds(self.of_item(w, item), labels, cfg.h, cfg.k_of_grids, cfg.literal)
                    took += time.time() - start
                    spreads.append(float(self.evaluate(item, seeds.select("u"))))
                out.append((value, sum(spreads) / len(spreads), fitted, took / len(spreads), len(spreads), labels.select("c").distinct().count(), float(top), top < cfg.h, "ok"))
            except harness.RECORDED as e:
                out.append((value, None, time.time() - began, None, 0, None, None, None, harness.failure(e)))
        return self.spark.createDataFrame(out, PARAMETER)

    def diagnostics(self) -> DataFrame:
        return harness.diagnostics(self.model.pi, self.of_item(self.weights, self.items[0]), self.config.h, self.config.C)

    def run(self) -> Results:
        cfg = self.config
        return Results(cfg, self.ds.meta | {"logs": self.logs.count(), "items": self.items}, self.diagnostics().first().asDict(), self.k_sweep() if "k" in cfg.sweeps else None, {n: self.parameter_sweep(n) for n in ("Z", "C") if n in cfg.sweeps}, dict(self.seconds))


@dataclass(frozen=True)
class Results:
    config: Config
    dataset: dict
    diagnostics: dict
    points: DataFrame | None
    grids: dict[str, DataFrame]
    seconds: dict[str, float]


def prepare(spark: SparkSession, ds: Dataset, config: Config) -> Experiment:
    return Experiment(spark, ds, config.fitted_to(ds.meta["n_users"]))


@dataclass(frozen=True)
class Claim:
    key: str
    text: str
    holds: bool | None
    detail: str


def claims(results: Results) -> list[Claim]:
    """Four verdicts; holds is None where a claim can't be judged."""
    cfg = results.config
    cells = {}
    if results.points is not None:
        cells = {(r.method, r.k): r for r in harness.summary(results.points).collect()}
    return [order_claim(cells, cfg), speed_claim(cells, cfg), plateau_claim(results.grids.get("Z")), peak_claim(results.grids.get("C"), cfg.C)]


def order_claim(cells: dict, cfg: Config) -> Claim:
    text = "spread: " + METHODS[0] + " >= " + " > ".join(METHODS[1:])
    if not cells or set(METHODS) - set(cfg.methods):
        return Claim("a", text, None, "needs a sweep of all methods")
    broken = []
    for k in cfg.ks:
        for better, worse in zip(METHODS, METHODS[1:], strict=False):
            a, b = cells.get((better, k)), cells.get((worse, k))
            if a is None or b is None:
                broken.append(f"k={k}: {better} or {worse} is missing")
            elif not (a.spread >= b.spread - 1e-9 if better == METHODS[0] else a.spread > b.spread + 1e-9):
                broken.append(f"k={k}: {better} {a.spread:.1f}, {worse} {b.spread:.1f}")
    return Claim("a", text, not broken, "; ".join(broken) or f"at every k of {list(cfg.ks)}")


def speed_claim(cells: dict, cfg: Config) -> Claim:
    """By selection seconds: fastest at every k, and ten times as fast as the slowest other at the largest."""
    text = f"{METHODS[0]} selects fastest, by ten times against the slowest at the largest k"
    ratios = {}
    for k in cfg.ks:
        own = cells.get((METHODS[0], k))
        if own is not None and own.seconds > 0:
            others = [(cells[m, k].seconds / own.seconds, m) for m in cfg.methods if m != METHODS[0] and (m, k) in cells]
            if others:
                ratios[k] = others
    if not ratios:
        return Claim("b", text, None, "needs the model and another method")
    least, most = min(x for r in ratios.values() for x in r), max(ratios[max(ratios)])
    return Claim("b", text, least[0] >= 1 and most[0] >= 10, f"least {least[0]:.2f} times ({least[1]}), {most[0]:.1f} times ({most[1]}) at k={max(ratios)}")


def plateau_claim(grid: DataFrame | None, share: float = 0.25, knee: int = 8) -> Claim:
    """From the knee on spread varies by at most share of its rise up to it; degenerate points don't count."""
    text = "spread rises with Z, then stays"
    rows = [] if grid is None else sorted(grid.where("status = 'ok' AND NOT degenerate").collect(), key=lambda r: r.value)
    if len(rows) < 3:
        return Claim("c", text, None, f"needs three usable points, has {len(rows)}")
    at = knee if any(r.value == knee for r in rows) else rows[len(rows) // 2].value
    head, tail = [r.spread for r in rows if r.value <= at], [r.spread for r in rows if r.value >= at]
    if len(tail) < 2:
        return Claim("c", text, None, f"needs two usable points from Z={at} on")
    rise, varies = head[-1] - head[0], max(tail) - min(tail)
    return Claim("c", text, rise > 0 and varies <= share * max(abs(rise), 1e-9), f"rise {rise:+.1f} up to Z={at}, then varies by {varies:.1f}")


def peak_claim(grid: DataFrame | None, C: int) -> Claim:
    text = f"spread is largest at C={C}"
    rows = [] if grid is None else sorted(grid.where("status = 'ok'").collect(), key=lambda r: r.value)
    if len(rows) < 2 or all(r.value != C for r in rows):
        return Claim("d", text, None, f"needs two points, C={C} among them")
    best = max(rows, key=lambda r: r.spread)
    return Claim("d", text, best.value == C, f"largest at C={best.value} ({best.spread:.1f})")

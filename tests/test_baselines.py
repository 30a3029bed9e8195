"""Samplers, cascades, communities, thinning, sources, streams and the harness on hand fixtures."""

import gzip
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplecast import harness
from ripplecast.operators import air, cascade, communities, gibbs, graph, logs, model, spread, subsample
from ripplecast.plans import registry
from ripplecast.sources import datasets, social, synthetic
from ripplecast.streaming import adoptions as streams

SF = "/root/testdata/sf0.001"
CHAIN = [(0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.5)]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def weights(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, pp double")


def test_topic_sampler_keeps_tokens_and_finds_planted_topics(spark):
    rows = [(i, pos, (i % 2) * 5 + (7 * i + 3 * pos) % 5) for i in range(40) for pos in range(20)]
    tok = spark.createDataFrame(rows, "i long, pos int, w long")
    h = model.Hyper(2, 2, 25.0, 0.5, 0.01, 0.5, 1.0, 0.1)
    found = gibbs.sample_topics(tok, 10, h, 15, 3)
    assert found.count() == len(rows)
    phi = {(r.i, r.z): r.p for r in model.phi(found, tok.select("i").distinct(), h).collect()}
    side = [phi[i, 0] > 0.5 for i in range(40)]
    assert all(s == side[i % 2] for i, s in enumerate(side)) and side[0] != side[1]


@pytest.mark.parametrize("exact", [True, False])
def test_community_sweep_keeps_events(spark, exact):
    edges = spark.createDataFrame([(u, v) for u in range(8) for v in range(8) if u != v and u // 4 == v // 4], "u long, v long")
    logs = spark.createDataFrame([(0, 1, 0), (5, 6, 1)], "u long, v long, i long")
    topics = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 0, 0.1), (1, 1, 0.9)], "i long, z int, p double")
    h = model.Hyper(2, 2, 0.1, 0.5, 0.01, 0.5, 1.0, 0.1)
    ev = gibbs.sample_communities(edges, logs, topics, h, 3, 5, exact)
    assert {tuple(r) for r in ev.select("kind", "u", "v", "i").collect()} == {tuple(r) for r in gibbs.events(edges, logs, 2, 5).select("kind", "u", "v", "i").collect()}
    assert ev.where("cp < 0 or cp > 1 or c < 0 or c > 1").count() == 0


def test_pick_follows_the_weights():
    w = np.tile([1.0, 0.0, 3.0], (4, 1))
    assert gibbs.pick(w, np.array([0.0, 0.24, 0.26, 0.999])).tolist() == [0, 0, 2, 2]


def test_model_saves_and_loads(spark, tmp_path):
    users, items = spark.range(4).toDF("u"), spark.range(2).toDF("i")
    tok = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "i long, pos int, w long")
    edges, logs = spark.createDataFrame([(0, 1), (2, 3)], "u long, v long"), spark.createDataFrame([(0, 1, 0)], "u long, v long, i long")
    m = gibbs.train(users, items, tok, edges, logs, 2, 2, 2, 1, 1, 7)
    m.save(str(tmp_path / "m"))
    back = gibbs.Model.load(spark, str(tmp_path / "m"))
    assert back.h == m.h and sorted(back.pi.collect()) == sorted(m.pi.collect())
    spark.createDataFrame([(json.dumps({"format": "other"}),)], "value string").write.mode("overwrite").text(str(tmp_path / "m/manifest"))
    with pytest.raises(ValueError):
        gibbs.Model.load(spark, str(tmp_path / "m"))


def test_objective_of_em_never_falls(spark):
    rng = random.Random(1)
    tr = spark.createDataFrame([(u, v, i, int(rng.random() < 0.4)) for u in range(5) for v in range(5, 9) for i in range(3)], "u long, v long, i long, y int")
    *_, seen = air.fit(tr, 2, 5, 1, tol=0)
    assert len(seen) > 2 and all(b >= a - 1e-9 for a, b in zip(seen, seen[1:], strict=False))


@pytest.mark.parametrize("per_positive", [None, 2])
def test_edges_of_trials_are_not_broadcast(spark, per_positive, monkeypatch):
    """Edges made of one short row each look small; a broadcast of them took the driver's memory."""
    plans = []
    keep = logs.stable
    watched = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or keep(df)
    for module in (air, logs):
        monkeypatch.setattr(module, "stable", watched)
    edges = spark.range(3).select(F.col("id").alias("u"), F.explode(F.array(*[F.col("id") + k for k in range(1, 4)])).alias("v"))
    a = spark.createDataFrame([(0, 7, 1), (1, 7, 5), (2, 8, 2), (0, 8, 9)], "u long, i long, t long")
    tr = air.trials(a, edges, logs.influence_logs(a, edges, 10), per_positive)
    assert (0, 1, 7, 1) in {tuple(r) for r in tr.collect()}
    plans.append(tr._jdf.queryExecution().sparkPlan().toString())
    assert sum(len(re.findall(r"SortMergeJoin \[u#\d+L\], \[u#\d+L\], Inner", p)) for p in plans) >= 2
    assert not any(re.search(r"BroadcastHashJoin \[u#\d+L\], \[u#\d+L\], Inner", p) for p in plans)


def test_nothing_of_capped_trials_is_broadcast(spark, monkeypatch):
    """Logs, their items, caps and cells of the cap grow with the data, and each went through the driver."""
    plans = []
    keep = logs.stable
    watched = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or keep(df)
    for module in (air, logs):
        monkeypatch.setattr(module, "stable", watched)
    rng = random.Random(7)
    edges = spark.createDataFrame([(u, v) for u in range(40) for v in range(40) if u != v and rng.random() < 0.3], "u long, v long")
    a = spark.createDataFrame([(u, i, rng.randrange(9)) for u in range(40) for i in range(3)], "u long, i long, t long")
    met = logs.influence_logs(a, edges, 1)
    tr = air.trials(a, edges, met, 2, 5)
    ran = tr.collect()
    plans.append(tr._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)
    every = air.trials(a, edges, met, None, 5).withColumn("h", logs.u01(5, F.col("u"), F.col("v"), F.col("i"))).collect()
    pos = [r for r in every if r.y == 1]
    want = {(r.u, r.v, r.i, 1) for r in pos}
    for i in range(3):
        failures = sorted((r.h, r.u, r.v) for r in every if r.y == 0 and r.i == i)
        want |= {(u, v, i, 0) for _, u, v in failures[: 2 * sum(r.i == i for r in pos)]}
    assert len(ran) == len(want) < len(every) and {tuple(r) for r in ran} == want


def test_cascade_spread_nears_the_exact_one(spark):
    got = cascade.ic_spread(weights(spark, CHAIN), spark.range(1).toDF("u"), 4000, 1).first()[0]
    assert abs(got - 1.875) < 0.06
    assert cascade.ic_spread(weights(spark, CHAIN), spark.range(3).toDF("u"), 0, 1).first()[0] == 3


def test_monte_carlo_greedy_on_certain_edges(spark):
    w = weights(spark, [(0, 1, 1.0), (0, 2, 1.0), (3, 4, 1.0), (5, 5, 0.0)])
    found = [tuple(r) for r in cascade.monte_carlo_greedy(w, spark.range(6).toDF("u"), 4, 2, 1).orderBy("rank").collect()]
    assert found == [(1, 0, 3.0), (2, 3, 2.0), (3, 5, 1.0), (4, 1, 0.0)]


def test_reach_counts():
    assert cascade.reach_counts([0, 1, 2, 3], {0: [1], 1: [2], 2: [0, 3]}) == {0: 4, 1: 4, 2: 4, 3: 1}
    rng = random.Random(2)
    for _ in range(50):
        out = {u: [v for v in range(9) if rng.random() < 0.15] for u in range(9)}
        assert cascade.reach_counts(list(range(9)), out) == {u: len(cascade.reach([u], out)) for u in range(9)}


def test_curves_and_budgets():
    out = {0: [(1, 1.0), (2, 1.0)], 3: [(4, 1.0)]}
    assert cascade.mixed_greedy_curve([0, 1, 2, 3, 4], out, 2, 3, 1) == [(0, 3.0), (3, 2.0)]
    assert cascade.lazy_curve([0, 1, 2, 3, 4], out, 5, 3, 1) == [(0, 3.0), (3, 2.0)]
    assert cascade.split_budget({0: [(1, 3.0), (2, 1.0)], 1: [(7, 2.0), (8, 3.0)]}, 2)[1] == 5.0
    assert cascade.allocate_positive({0: [(1, 3.0), (2, 0.0)], 1: [(7, 2.0)]}, 5) == [1, 7]


def plain_curve(members, out, k, runs, seed):
    """mixed_greedy_curve with a reach a user and sample, and a look at every user for the best."""
    rng, curve, chosen = random.Random(seed), [], []
    first = dict.fromkeys(members, 0.0)
    for _ in range(runs):
        g = cascade.sample(out, rng)
        for u in members:
            first[u] += len(cascade.reach([u], g)) / runs
    order = {u: (first[u], 0) for u in members}
    while order and len(curve) < k:
        graphs = None
        while order[u := min(order, key=lambda x: (-order[x][0], x))][1] != len(curve):
            graphs = graphs or [(g, cascade.reach(chosen, g)) for g in (cascade.sample(out, rng) for _ in range(runs))]
            order[u] = sum(len(cascade.reach([u], g, b)) for g, b in graphs) / runs, len(curve)
        chosen.append(u)
        curve.append((u, order.pop(u)[0]))
    return curve


def random_arcs(rng, n, share):
    rows = {u: [(v, rng.random()) for v in range(n) if v != u and rng.random() < share] for u in range(n)}
    return {u: row for u, row in rows.items() if row}


def test_curves_of_small_reaches_pass_no_masks(monkeypatch):
    """Each sample of a community went over all of it once for every BLOCK_BITS users."""
    monkeypatch.setattr(cascade, "reach_counts", None)
    rng = random.Random(4)
    for n, share in ((1, 0), (20, 0.05), (60, 0.01), (60, 0.02)):
        out = random_arcs(rng, n, share)
        assert cascade.mixed_greedy_curve(list(range(n)), out, 6, 4, 9) == plain_curve(list(range(n)), out, 6, 4, 9)


def test_curves_of_wide_reaches(monkeypatch):
    monkeypatch.setattr(cascade, "NEAR_NODES", 3)
    monkeypatch.setattr(cascade, "NEAR_ROOTS", 7)
    rng = random.Random(6)
    for n, share in ((20, 0.05), (40, 0.1), (40, 0.5)):
        out = random_arcs(rng, n, share)
        assert cascade.mixed_greedy_curve(list(range(n)), out, 5, 3, 8) == plain_curve(list(range(n)), out, 5, 3, 8)


def test_logs_of_few_and_of_many_items(spark):
    """A signature drops no log, be it full or nearly empty."""
    rng = random.Random(8)
    rows = [(u, i, rng.randrange(50)) for u, n in ((0, 2000), (1, 1500), (2, 3), (3, 1), (4, 40)) for i in rng.sample(range(3000), n)]
    arcs = [(u, v) for u in range(5) for v in range(5) if u != v]
    at = {(u, i): t for u, i, t in rows}
    want = {(u, v, i) for (u, i), t in at.items() for v in range(5) if 0 < at.get((v, i), t) - t <= 20}
    found = logs.influence_logs(spark.createDataFrame(rows, "u long, i long, t long"), spark.createDataFrame(arcs, "u long, v long"), 20).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_fit_has_the_objective_of_each_sweep(spark):
    rng = random.Random(9)
    tr = spark.createDataFrame([(u, v, i, int(rng.random() < 0.3)) for u in range(4) for v in range(4, 8) for i in range(3)], "u long, v long, i long, y int")
    found = air.initial(tr, 2, 1)
    want = [air.log_posterior(tr, *found)]
    for _ in range(2):
        found = air.em_step(tr, *found, 2)
        want.append(air.log_posterior(tr, *found))
    for last, n in ((True, 3), (False, 2)):
        A, _, _, seen = air.fit(tr, 2, 2, 1, tol=0, last=last)
        assert seen == pytest.approx(want[:n])
        assert {(r.u, r.z): round(r.p, 9) for r in A.collect()} == {(r.u, r.z): round(r.p, 9) for r in found[0].collect()}


def test_global_greedy_and_marginal_gain(spark):
    w = weights(spark, [(0, 1, 0.5), (1, 2, 0.4), (5, 6, 0.9)])
    assert [(r.u, round(r.gain, 6)) for r in spread.greedy(w, 0.01, 2).orderBy("rank").collect()] == [(5, 1.9), (0, 1.7)]
    trees = spread.arborescences(w, 0.01, spark.createDataFrame([(x,) for x in (0, 1, 2, 5, 6)], "u long"))
    seeds = spark.createDataFrame([(0,)], "u long")
    both = spread.influence(trees, w, spark.createDataFrame([(0,), (1,)], "u long"))
    assert abs(spread.marginal_gain(trees, w, seeds, 1) - (both - spread.influence(trees, w, seeds))) < 1e-9
    assert spread.marginal_gain(trees, w, seeds, 0) == 0.0 and spread.marginal_gain(trees, w, seeds, 77) == 0.0


def loose_graph(spark):
    """Four random parts, apart from each other, users without links and a link to nobody known."""
    rng = random.Random(5)
    ids = rng.sample(range(1000), 200)
    rows = [(low + rng.randrange(n), low + rng.randrange(n)) for low, n, links in ((0, 30, 60), (30, 20, 30), (50, 25, 70), (75, 10, 12)) for _ in range(links)]
    e = spark.createDataFrame([(ids[a], ids[b]) for a, b in [*rows, (150, 151)]], "u long, v long")
    return e, spark.createDataFrame([(x,) for x in ids[:90]], "u long")


def labels_of(df):
    return {r.u: r.c for r in df.collect()}


def test_agglomeration_by_component_is_that_of_one_task(spark):
    e, users = loose_graph(spark)
    assert labels_of(communities.exact(e, users)) == labels_of(communities.agglomerated(e, users, small=85))
    with pytest.raises(ValueError):
        communities.agglomerated(e, users, small=20)


def test_forced_targets_by_component_are_those_of_one_task(spark):
    e, users = loose_graph(spark)
    for target in (3, 12, 25):
        assert labels_of(communities.exact(e, users, target)) == labels_of(communities.agglomerated(e, users, target, small=85))
    assert labels_of(communities.exact(e, users, 25, False)) == labels_of(communities.agglomerated(e, users, 25, False, 85))


@pytest.mark.parametrize("name", ["air_cga_seeds", "cinema_seeds"])
def test_seeds_of_a_graph_beyond_one_task(spark, monkeypatch, name):
    """Communities for the seeds of more pairs than one task takes were an error."""
    want = registry.QUERIES[name](spark, SF).collect()
    monkeypatch.setattr(communities, "EXACT_EDGES", 10)
    assert registry.QUERIES[name](spark, SF).collect() == want


def test_agglomeration_finds_cliques(spark):
    rows = [(a, b) for s in (0, 5) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 5)]
    e, users = spark.createDataFrame(rows, "u long, v long"), spark.range(11).toDF("u")
    want = [{0, 1, 2, 3, 4}, {5, 6, 7, 8, 9}, {10}]
    for found in (communities.exact(e, users), communities.parallel(e, users)):
        parts: dict = {}
        for r in found.collect():
            parts.setdefault(r.c, set()).add(r.u)
        assert sorted(parts.values(), key=min) == want
    assert communities.exact(e, users, 2).select("c").distinct().count() == 2
    assert communities.exact(e, users, 1, force=False).select("c").distinct().count() == 2


def test_dense_core_and_snowball(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (1, 0), (2, 1), (0, 2)] + [(k, k + 1) for k in range(2, 10)], "u long, v long")
    act = spark.createDataFrame([(0, 1)], "u long, n long")
    assert {r.u for r in subsample.dense_core(e, act, 3).collect()} == {0, 1, 2}
    assert subsample.snowball(list(range(7)), {0: {1, 2, 3, 4, 5, 6}}, 4, {x: (0,) for x in range(7)}) == [0, 1, 2, 3]


def test_thinning_keeps_target_and_repairs(spark):
    e = spark.createDataFrame([(a, b) for a in range(10) for b in range(10) if a != b], "u long, v long")
    act = spark.createDataFrame([(0, 5)], "u long, n long")
    kept = subsample.thin(e, act, 20).collect()
    assert len(kept) == 20 and {r.u for r in kept} == set(range(10))
    star = spark.createDataFrame([(0, k) for k in range(1, 8)] + [(8, 9), (9, 8)], "u long, v long")
    kept = subsample.thin(star, act, 4).collect()
    assert {x for r in kept for x in (r.u, r.v)} == set(range(10))


def test_conformity_without_profile_changes_nothing(spark):
    profile = spark.createDataFrame([(0, 0.0, 0.0)], "u long, influence double, conformity double")
    assert sorted(cascade.conformity_pp(weights(spark, CHAIN), profile).collect()) == sorted(weights(spark, CHAIN).collect())


def test_dataset_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    logs = spark.createDataFrame([(1, 0, 20), (0, 0, 10)], "u long, i long, t long")
    items = spark.createDataFrame([(0, [3, 1, 3])], "i long, attrs array<long>")
    meta = datasets.widened(edges, logs, items, {"name": "x", "n_items": 2})
    datasets.save(datasets.Dataset(edges, logs, items, meta), str(tmp_path / "d"))
    back = datasets.load(spark, str(tmp_path / "d"))
    assert back.meta == meta and sorted(back.edges.collect()) == sorted(edges.collect()) and sorted(back.adoptions.collect()) == sorted(logs.collect())
    assert {r.i: list(r.attrs) for r in back.items.collect()} == {0: [3, 1, 3], 1: []}


def test_dataset_text_quirks(spark, tmp_path):
    (tmp_path / "graph.tsv.gz").write_bytes(gzip.compress(b"# arcs\n0\t1\n\n0\t1\n"))
    (tmp_path / "logs.tsv").write_text("0\t0\t5\n7\t0\t9\n")
    ds = datasets.load(spark, str(tmp_path))
    assert ds.edges.count() == 1 and ds.meta["n_users"] == 8 and ds.meta["name"] == tmp_path.name


def test_vote_files(spark, tmp_path):
    friends, votes = tmp_path / "friends.csv", tmp_path / "votes.csv"
    friends.write_bytes(b'"mutual","friend_date","user_id","friend_id"\r\n"0","1","10","20"\r\n"0","1","10","10"\r\n"1","2","10","30"\r\n')
    votes.write_bytes(b'"vote_date","voter_id","story_id"\r"900","10","1"\r"950","20","1"\r"999","10","1"\r')
    assert {tuple(r) for r in social.friend_arcs(spark, str(friends)).collect()} == {(20, 10), (30, 10)}
    assert {tuple(r) for r in social.votes(spark, str(votes)).collect()} == {(10, 1, 900), (20, 1, 950), (10, 1, 999)}
    ds = social.prepare_votes(spark, str(friends), str(votes))
    assert ds.meta["n_users"] == 2 and {tuple(r) for r in ds.edges.collect()} == {(1, 0)} and {tuple(r) for r in ds.adoptions.collect()} == {(0, 0, 900), (1, 0, 950)}
    columns = tmp_path / "out.votes"
    columns.write_text("% header\n5 7 1 1246573330\n5 7\n")
    assert [tuple(r) for r in social.votes(spark, str(columns)).collect()] == [(5, 7, 1246573330)]


def test_review_files(spark, tmp_path):
    one = lambda name, rows: (tmp_path / f"yelp_academic_dataset_{name}.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n\n")
    one("business", [{"business_id": "a", "categories": "Food, Bars"}, {"business_id": "b", "categories": None}])
    one("review", [{"user_id": "x", "business_id": "a", "date": "2016-03-09 20:56:34"}, {"user_id": "x", "business_id": "a", "date": "2016-03-09"}, {"user_id": "y", "business_id": "b", "date": "bad"}, {"user_id": "y", "business_id": "q", "date": "2016-03-09"}])
    one("user", [{"user_id": "x", "friends": "y, z"}, {"user_id": "y", "friends": "None"}])
    ds = social.prepare_reviews(spark, str(tmp_path))
    assert {tuple(r) for r in ds.edges.collect()} == {(0, 1), (1, 0)}
    assert {tuple(r) for r in ds.adoptions.collect()} == {(0, 0, 1457481600), (1, 1, 0)}
    assert {r.i: len(r.attrs) for r in ds.items.collect()} == {0: 2, 1: 0}
    with pytest.raises(FileNotFoundError):
        social.prepare_reviews(spark, str(tmp_path / "none"))


def test_synthetic_has_its_sizes(spark):
    ds = synthetic.generate(spark, 40, 150, 10, 12, 4, 3, 1)
    assert ds.edges.distinct().count() == 150 and ds.edges.where("u = v").count() == 0
    assert ds.adoptions.count() == ds.adoptions.select("u", "i").distinct().count() > 0
    assert ds.items.count() == 10 and ds.meta["n_users"] == 40
    with pytest.raises(ValueError):
        synthetic.community_edges(spark, 4, 13, 2, 0.5, 1)


def test_stream_of_influence_logs(spark, tmp_path):
    rows = spark.createDataFrame([(0, 7, 100), (1, 7, 150), (2, 7, 400), (0, 7, 120)], "u long, i long, t long")
    rows.select("u", "i", F.timestamp_seconds("t").alias("at")).write.parquet(str(tmp_path / "in"))
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0)], "u long, v long")
    source = spark.readStream.schema("u long, i long, at timestamp").parquet(str(tmp_path / "in"))
    run = streams.influence_logs(source, edges, 100).writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.u, r.v, r.i) for r in spark.table("met").collect()} == {(0, 1, 7)}


def test_tables_and_claims(spark):
    points = spark.createDataFrame([("a", 2, 0, 5.0, 2, 0.1, "ok"), ("b", 2, 0, 4.0, 2, 0.1, "ok"), ("b", 2, 1, None, 0, 0.1, "failed: x")], harness.POINT)
    s = harness.summary(points)
    assert {(r.method, r.spread) for r in s.collect()} == {("a", 5.0), ("b", 4.0)}
    assert harness.chain_holds(s, "a", "b").first().holds and not harness.chain_holds(s, "b", "a").first().holds
    assert harness.ascii_table(["name", "n"], [["x", 1.5], [None, 20]]).splitlines()[2:] == ["| x    | 1.5 |", "|      |  20 |"]


def test_cascades_are_the_same_held_in_a_task_or_joined(spark):
    rng = random.Random(4)
    w = weights(spark, [(u, v, 0.3) for u in range(14) for v in range(14) if u != v and rng.random() < 0.2])
    seeds, everyone = spark.range(2).toDF("u"), spark.range(14).toDF("u")
    assert cascade.ic_spread(w, seeds, 15, 6).first() == cascade.ic_spread(w, seeds, 15, 6, local_rows=0).first()
    both = [sorted(tuple(r) for r in cascade.monte_carlo_greedy(w, everyone, 4, 6, 7, **how).collect()) for how in ({}, {"local_rows": 0})]
    assert both[0] == both[1]


def test_reach_counts_in_blocks(monkeypatch):
    monkeypatch.setattr(cascade, "BLOCK_BITS", 3)
    rng = random.Random(5)
    out = {u: [v for v in range(20) if rng.random() < 0.07] for u in range(20)}
    assert cascade.reach_counts(list(range(20)), out) == {u: len(cascade.reach([u], out)) for u in range(20)}


def test_agglomeration_of_a_contracted_graph_goes_on_as_the_whole():
    """Two cliques, one contracted to a node whose inner weight is an arc to itself."""
    clique = [(a, b, 1.0) for a in range(5, 9) for b in range(a + 1, 9)]
    assert communities.agglomerate([0, 5, 6, 7, 8], [(0, 0, 6.0), (0, 5, 1.0), *clique]) == {0: 0, 5: 1, 6: 1, 7: 1, 8: 1}


def test_parallel_merging_ends_in_one_task_or_in_rounds(spark):
    rows = [(a, b) for s in (0, 5) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 5)]
    e, users = spark.createDataFrame(rows, "u long, v long"), spark.range(11).toDF("u")
    for small in (0, 12, 100):
        parts: dict = {}
        for r in communities.parallel(e, users, small=small).collect():
            parts.setdefault(r.c, set()).add(r.u)
        assert parts == {0: {0, 1, 2, 3, 4}, 5: {5, 6, 7, 8, 9}, 10: {10}}


def test_large_graphs_meet_the_target_too(spark, monkeypatch):
    cliques = [(a, b) for base, size in ((0, 5), (10, 4), (20, 3), (30, 3)) for a in range(base, base + size) for b in range(a + 1, base + size)]
    e = spark.createDataFrame(cliques, "u long, v long")
    users = spark.createDataFrame([(x,) for x in sorted({x for c in cliques for x in c} | {40, 41})], "u long")
    for target in (2, 3, 5):
        want = {(r.u, r.c) for r in communities.exact(e, users, target).collect()}
        got = {(r.u, r.c) for r in communities.merged(e, users, target, small=12).collect()}
        assert got == want and {c for _, c in got} == set(range(target))
    monkeypatch.setattr(communities, "EXACT_EDGES", 12)
    with pytest.raises(ValueError):
        communities.exact(e, users)

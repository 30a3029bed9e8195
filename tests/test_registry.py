"""Every registered query against its SQL at the smallest scale, and hand fixtures."""

import math
import random

import pytest

from compare import differences
from ripplecast.operators import graph, lineage, logs, model, spread
from ripplecast.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.SQL[name], SF) == []


def test_influence_follows_edges_and_the_clock(spark):
    """Item 7: 10 at 50 (again at 300), 11 and 13 at 80, 12 at 200; item 8: 12 at 10, 10 and 11 at 40; item 9: 13 alone."""
    edges = spark.createDataFrame([(10, 11), (11, 12), (10, 12), (12, 10), (13, 11), (10, 11)], "u long, v long")
    a = spark.createDataFrame([(10, 7, 300), (10, 7, 50), (11, 7, 80), (12, 7, 200), (13, 7, 80), (12, 8, 10), (10, 8, 40), (11, 8, 40), (13, 9, 5)], "u long, i long, t long")
    found = lambda d: sorted(tuple(r) for r in logs.influence_logs(a, edges, d).collect())
    near = [(10, 11, 7), (12, 10, 8)]
    assert found(29) == [] and found(30) == near
    assert found(120) == sorted([*near, (11, 12, 7)]) and found(150) == sorted([*near, (11, 12, 7), (10, 12, 7)]) == found(10**9)
    with pytest.raises(ValueError):
        logs.influence_logs(a, edges, -1)


LINE = [(0, 1, 0.8), (1, 2, 0.5)]
DIAMOND = [(0, 1, 0.6), (0, 2, 0.5), (1, 3, 0.7), (2, 3, 0.9)]


@pytest.mark.parametrize(
    "rows, h, seeds, want",
    [
        (LINE, 0.2, [0], 1 + 0.8 + 0.4),
        (LINE, 0.45, [0], 1 + 0.8),  # the path of 0.4 is cut
        (DIAMOND, 0.1, [0], 1 + 0.6 + 0.5 + 0.45),  # 0 reaches 3 by 2, so 1 brings it nothing
        (DIAMOND, 0.1, [0, 1], 1 + 1 + 0.5 + 1 - 0.55 * 0.3),
        (DIAMOND, 0.95, [0, 3], 2),
    ],
)
def test_spread_by_hand(spark, rows, h, seeds, want):
    w = spark.createDataFrame(rows, "u long, v long, pp double")
    users = spark.range(max(v for _, v, _ in rows) + 1).toDF("u")
    trees = spread.arborescences(w, h, users)
    got = spread.activation(trees, w, spark.createDataFrame([(s,) for s in seeds], "u long")).agg({"ap": "sum"}).first()[0]
    assert abs(got - want) < 1e-9


def test_certain_edges_in_a_ring_make_a_tree(spark):
    w = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "u long, v long, pp double")
    trees = spread.arborescences(w, 0.5, spark.range(3).toDF("u")).collect()
    assert {(r.root, r.node, r.hops) for r in trees} == {(r, (r - k) % 3, k) for r in range(3) for k in range(3)}


@pytest.mark.parametrize("local_arcs", [100, 0])
def test_cores_and_components(spark, local_arcs):
    """Four users who all know each other, a path of two on from one of them, and a pair."""
    rows = [(1, 2), (1, 3), (4, 1), (2, 3), (2, 4), (3, 4), (4, 5), (5, 6), (8, 9), (9, 8), (9, 9)]
    e = spark.createDataFrame(rows, "u long, v long")
    want = {(u, 3) for u in (1, 2, 3, 4)} | {(u, 1) for u in (5, 6, 8, 9)}
    assert {tuple(r) for r in graph.core_numbers(e, local_arcs).collect()} == want
    assert graph.core_numbers(e.where("false"), local_arcs).count() == 0
    found = {tuple(r) for r in graph.components(e, spark.range(10).toDF("u")).collect()}
    assert found == {(0, 0), (7, 7), (8, 8), (9, 8)} | {(u, 1) for u in range(1, 7)}


def test_cores_of_long_paths_take_few_tables(spark, monkeypatch):
    """Values fall by two nodes a round along a path: rounds of h-indices would write 100 tables here."""
    keep, calls = graph.stable, []

    def counted(df):
        calls.append(1)
        assert len(calls) < 40
        return keep(df)

    monkeypatch.setattr(graph, "stable", counted)
    e = spark.createDataFrame([(low + x, low + x + 1) for low in (0, 1000) for x in range(200)], "u long, v long")
    assert {tuple(r) for r in graph.core_numbers(e, local_arcs=0).collect()} == {(low + x, 1) for low in (0, 1000) for x in range(201)}


@pytest.mark.parametrize("component_arcs", [0, 4, 9])
def test_cores_by_rounds_and_by_components_agree(spark, component_arcs):
    rng = random.Random(3)
    rows = [(low + rng.randrange(12), low + rng.randrange(12)) for low in (0, 20) for _ in range(30)] + [(50, 51), (51, 52), (50, 52), (60, 61)]
    e = spark.createDataFrame(rows, "u long, v long")
    assert {tuple(r) for r in graph.core_numbers(e, 0, component_arcs).collect()} == {tuple(r) for r in graph.core_numbers(e).collect()}


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 400)
    path = list(zip(names[:200], names[1:200]))
    star = [(names[200], x) for x in names[201:]]
    e = spark.createDataFrame(path + star, "u long, v long")
    found = {r.u: r.component for r in graph.components(e, spark.createDataFrame([(x,) for x in names], "u long")).collect()}
    assert found == {x: min(names[:200]) for x in names[:200]} | {x: min(names[200:]) for x in names[200:]}


@pytest.mark.parametrize("local_arcs", [0, 40, 150, 1000])
def test_components_by_rounds_and_ended_in_one_task_agree(spark, local_arcs):
    rng = random.Random(6)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    least = {x: x for x in range(300)}
    for _ in least:
        for a, b in rows:
            least[a] = least[b] = min(least[a], least[b])
    found = graph.components(spark.createDataFrame(rows, "u long, v long"), spark.range(300).toDF("u"), local_arcs)
    assert {r.u: r.component for r in found.collect()} == least


def test_components_of_few_arcs_take_no_rounds(spark, monkeypatch):
    """Each round wrote two tables: on small graphs the rounds took most of the time."""
    keep, calls = graph.stable, []
    monkeypatch.setattr(graph, "stable", lambda df: calls.append(1) or keep(df))
    e = spark.createDataFrame([(x, x + 1) for x in range(200)], "u long, v long")
    assert {tuple(r) for r in graph.components(e, spark.range(201).toDF("u")).collect()} == {(x, 0) for x in range(201)}
    assert len(calls) == 2
    assert {r.core for r in graph.core_numbers(e, local_arcs=0).collect()} == {1} and len(calls) == 7


def test_priors_by_the_sizes():
    h = model.Hyper.make(20, 5, 1000, 4000, 2500)
    assert (h.rho, h.alpha, h.omega, h.warning) == (2.5, 10.0, 10.0, "")
    assert abs(h.eps0 - math.log((999_000 * 1.625 - 6500) / 400)) < 1e-12
    few = model.Hyper.make(60, 2, 6, 5, 1)
    assert few.eps0 == 1e-3 and few.warning


def test_stable_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Remote:
        conf = type("Conf", (), {"get": staticmethod(lambda name, other=None: other)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        lineage.shared_folder(Remote)
    one = lineage.stable(spark.range(3))
    assert one.count() == 3
    lineage.release(one, spark.range(1))
    with pytest.raises(Exception):
        one.count()


def test_greedy_curve_and_allocation():
    out, into = {0: [(1, 0.5)], 1: [(2, 0.4)]}, {1: [(0, 0.5)], 2: [(1, 0.4)]}
    curve = spread.greedy_curve([0, 1, 2], out, into, 0.01, 3)
    assert [u for u, _ in spread.greedy_curve([0, 1, 2], out, into, 0.01, 3, {1, 2})] == [1, 2]
    assert curve[0][0] == 0 and abs(curve[0][1] - 1.7) < 1e-9 and abs(sum(g for _, g in curve) - 3) < 1e-9
    assert len(set(spread.allocate({0: [(1, 3.0), (2, 1.0)], 1: [(7, 2.0), (8, 1.5)]}, 4))) == 4


def test_only_candidates_are_chosen(spark):
    w = spark.createDataFrame([(0, 1, 0.8), (1, 2, 0.5), (3, 4, 0.9)], "u long, v long, pp double")
    labels = spark.createDataFrame([(u, u // 3) for u in range(5)], "u long, c long")
    some = spark.createDataFrame([(1,), (4,), (9,)], "u long")
    assert [r.u for r in spread.select_seeds(w, labels, 0.1, 3).orderBy("rank").collect()][:2] == [0, 3]
    assert {r.u for r in spread.select_seeds(w, labels, 0.1, 3, candidates=some).collect()} == {1, 4}

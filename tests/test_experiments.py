"""Experiments, reports, the command line, sequential chains, audits, simulation and archives."""

import io
import json
import random
import tarfile
import zipfile
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from ripplecast import __main__ as command
from ripplecast import experiments, harness, reports
from ripplecast.operators import air, cascade, gibbs, logs, model
from ripplecast.sources import archive, datasets, social, synthetic

SMALL = experiments.Config(C=3, Z=2, ks=(2,), runs=3, n_items=1, topic_sweeps=1, community_sweeps=1, em_sweeps=1, h=0.01, delta=30 * 86_400, z_grid=(2, 3), c_grid=(3,), k_of_grids=2)


@pytest.fixture(scope="module")
def dataset(spark):
    return synthetic.generate(spark, 130, 700, 12, 12, 3, 2, 1, base=0.2)


@pytest.fixture(scope="module")
def results(spark, dataset):
    return experiments.prepare(spark, dataset, SMALL).run()


def test_an_experiment_scores_every_method(results, tmp_path_factory):
    points = results.points.collect()
    assert {r.status for r in points} == {"ok"}, [r.status for r in points]
    assert {(r.method, r.k, r.item) for r in points} == {(m, k, i) for m in experiments.METHODS for k in (2,) for i in results.dataset["items"]}
    assert all(r.spread >= r.seeds - 1e-9 and r.seeds <= r.k for r in points)
    assert {n: [(r.value, r.status) for r in g.orderBy("value").collect()] for n, g in results.grids.items()} == {"Z": [(2, "ok"), (3, "ok")], "C": [(3, "ok")]}
    folder = tmp_path_factory.mktemp("out")
    files = reports.write(results, str(folder))
    assert files == ["points.csv", "spread.svg", "seconds.svg", "sweep_Z.csv", "sweep_Z.svg", "sweep_C.csv", "sweep_C.svg", "report.md"]
    text = (folder / "report.md").read_text()
    assert all(f"## {t}" in text for t in ("Configuration", "Dataset", "Preparation", "Model", "Spread by number of seeds", "Claims", "Files"))
    assert len(pd.read_csv(folder / "points.csv")) == len(experiments.METHODS)


def test_configurations_shrink():
    quick = experiments.Config().quick()
    assert (quick.topic_sweeps, quick.runs, quick.n_items, quick.em_sweeps, quick.cap) == (30, 20, 3, 8, 20)
    assert replace(experiments.Config(), cap=7).quick().cap == 7
    fitted = experiments.Config().fitted_to(400)
    assert fitted.C == 10 and fitted.c_grid == (2, 5, 8, 10, 12, 15) and fitted.notes
    assert experiments.Config().fitted_to(4000).C == 100 and experiments.Config().fitted_to(5).C == 2


def judged(spark, points=(), grids=None, **config):
    rows = [(m, k, 0, s, k, t, "ok") for m, k, s, t in points]
    frame = spark.createDataFrame(rows, harness.POINT) if rows else None
    grids = {n: spark.createDataFrame([(v, s, 1.0, 1.0, 1, 2, 0.5, bad, "ok") for v, s, bad in g], experiments.PARAMETER) for n, g in (grids or {}).items()}
    return {c.key: c.holds for c in experiments.claims(experiments.Results(replace(experiments.Config(ks=(2,), C=10), **config), {}, {}, frame, grids, {}))}


def test_claims(spark):
    falling = [(m, 2, 50.0 - 10 * n, 1.0 + 4 * n) for n, m in enumerate(experiments.METHODS)]
    assert judged(spark) == dict.fromkeys("abcd")
    got = judged(spark, falling, {"Z": [(2, 10.0, False), (8, 50.0, False), (12, 48.0, False), (14, 2.0, True)], "C": [(5, 3.0, False), (10, 9.0, False)]})
    assert got == dict.fromkeys("abcd", True)
    got = judged(spark, [(m, k, -s, 1.0) for m, k, s, _ in falling], {"Z": [(2, 10.0, False), (8, 50.0, False), (12, 20.0, False)], "C": [(5, 30.0, False), (10, 9.0, False)]})
    assert got == dict.fromkeys("abcd", False)
    assert judged(spark, falling[:2], methods=experiments.METHODS[:2])["a"] is None and judged(spark, grids={"C": [(5, 3.0, False), (6, 9.0, False)]})["d"] is None


def test_charts_and_tables():
    svg = reports.line_chart("a < b", "x", "y", {"one": [(1, 10.0), (2, 1000.0), (3, 0.0), (4, float("nan"))]}, log_y=True)
    assert svg.startswith("<svg") and svg.endswith("</svg>") and "2 points left out" in svg and "a &lt; b" in svg and ">1000<" in svg
    assert reports.line_chart("t", "x", "y", {}).endswith("</svg>")
    assert reports.ticks(0, 9.5) == [0, 2, 4, 6, 8, 10]
    assert reports.csv_text(["a", "b"], [[None, 0.1], ['x,"', 2]]) == 'a,b\n,0.1\n"x,""",2\n'
    assert "50.0%" in reports.comparison("t", {"users": 5}, {"users": 10, "links": 3})


def test_the_command_line(spark, dataset, tmp_path, monkeypatch, capsys):
    assert command.methods("*") == experiments.METHODS and command.methods("Air+CGA, model") == ("air_cga", "model")
    with pytest.raises(SystemExit):
        command.main(["run", "x", "--methods", "none such"])
    assert command.main(["prepare", "votes", "--raw", str(tmp_path), "--out", str(tmp_path / "o")]) == 2
    assert command.main(["prepare", "synthetic", "--users", "60", "--links", "200", "--items", "6", "--out", str(tmp_path / "d")]) == 0
    assert "n_links" in capsys.readouterr().out
    assert command.main(["run", str(tmp_path / "d"), "--out", str(tmp_path / "r"), "--quick", "--methods", "cinema", "--ks", "2", "--sweeps", "k", "--Z", "2", "--runs", "2", "--topic-sweeps", "1", "--community-sweeps", "1", "--n-items", "1"]) == 0
    assert (tmp_path / "r" / "report.md").exists()


def blocks(spark, n=24, seed=2):
    rng = random.Random(seed)
    rows = [(u, v) for u in range(n) for v in range(n) if u != v and rng.random() < (0.5 if u * 2 // n == v * 2 // n else 0.02)]
    topics = spark.createDataFrame([(i, z, 0.9 if z == i % 2 else 0.1) for i in range(4) for z in range(2)], "i long, z int, p double")
    found = spark.createDataFrame([(u, v, (u * 2 // n) + 2 * (v % 2)) for u, v in rows if u * 2 // n == v * 2 // n], "u long, v long, i long")
    return spark.createDataFrame(rows, "u long, v long"), found, topics


@pytest.mark.parametrize("exact", [True, False])
def test_the_chain_in_turn_finds_blocks(spark, exact):
    edges, found, topics = blocks(spark)
    h = model.Hyper(2, 2, 0.5, 0.5, 0.01, 0.5, 5.0, 0.1)
    ev = gibbs.sample_communities_in_turn(edges, found, topics, h, 40, 3, exact).collect()
    assert len(ev) == edges.count() + found.count()
    votes = np.zeros((24, 2))
    for r in ev:
        votes[r.u, r.cp] += 1
        votes[r.v, r.c] += 1
    side = votes.argmax(axis=1)
    assert (side[:12] == np.bincount(side[:12]).argmax()).mean() >= 0.85 and (side[12:] == np.bincount(side[12:]).argmax()).mean() >= 0.85
    assert np.bincount(side[:12]).argmax() != np.bincount(side[12:]).argmax()


def test_the_chain_in_turn_has_no_bound_on_events(spark, monkeypatch):
    monkeypatch.setattr(gibbs, "SEQUENTIAL_EVENTS", 10, raising=False)
    monkeypatch.setattr(gibbs, "CHUNK", 7, raising=False)
    edges, found, topics = blocks(spark)
    h = model.Hyper(2, 2, 0.5, 0.5, 0.01, 0.5, 5.0, 0.1)
    ev = gibbs.sample_communities_in_turn(edges, found, topics, h, 2, 3)
    key = ["kind", "u", "v", "i"]
    assert sorted(map(tuple, ev.select(*key).collect())) == sorted(map(tuple, gibbs.events(edges, found, 2, 3).select(*key).collect()))


def test_counts_of_the_chain_stay_those_of_a_recount():
    rows = pd.DataFrame([(0, 0, 1, -1, 0, 1), (1, 1, 2, 5, 1, 1), (1, 0, 2, 5, 0, 0)], columns=["kind", "u", "v", "i", "cp", "c"])
    chain = gibbs.Chain(rows, {5: np.array([0.3, 0.7])}, model.Hyper(2, 2, 0.5, 0.5, 0.01, 0.5, 1.0, 0.1), 1)
    for exact in (True, False):
        chain.sweep(exact, 2)
    again = gibbs.Chain(rows.assign(cp=[x for x, _ in chain.at], c=[y for _, y in chain.at]), chain.topics, chain.h, 1)
    assert all(np.allclose(a, b) for a, b in zip((chain.node, chain.pair, chain.soft, chain.target), (again.node, again.pair, again.soft, again.target)))


def test_audits_name_what_differs(spark):
    edges, found, _ = blocks(spark)
    ev = gibbs.events(edges, found, 2, 1)
    counts = gibbs.event_counts(ev)
    assert gibbs.validate_counts(ev, counts).count() == 0
    wrong = counts.where("NOT (name = 'pair' AND a = 0 AND b = 1)")
    assert [(r.name, r.a, r.b, r.have) for r in gibbs.validate_counts(ev, wrong).collect()] == [("pair", 0, 1, 0)]


def test_hill_climbing_by_any_oracle():
    sets = {0: {1, 2, 3}, 1: {3, 4}, 2: {4, 5, 6}, 3: {1}, 4: {7}}
    oracle = lambda seeds: len(set().union(*[sets[s] for s in seeds]))
    (plain, all_calls), (lazy, few_calls) = (cascade.hill_climb(list(sets), oracle, 4, lazy) for lazy in (False, True))
    assert plain == lazy == [(0, 3.0), (2, 3.0), (4, 1.0), (1, 0.0)]
    assert few_calls["evaluations"] < all_calls["evaluations"] == 5 + 4 + 3 + 2 and few_calls["saved"] > 0 == all_calls["saved"]
    assert [u for u, _ in cascade.hill_climb([1, 3], oracle, 9)[0]] == [1, 3]


def test_sampled_failures_keep_each_items_share(spark):
    edges = spark.createDataFrame([(0, v) for v in range(1, 40)], "u long, v long")
    adoptions = spark.createDataFrame([(0, 7, 10), (1, 7, 20), (2, 7, 30), (0, 8, 10), (3, 8, 20)], "u long, i long, t long")
    pos = logs.influence_logs(adoptions, edges, 100)
    rows = air.trials(adoptions, edges, pos, per_positive=3, seed=1).collect()
    assert sorted((r.i, r.y) for r in rows) == [(7, 0)] * 6 + [(7, 1)] * 2 + [(8, 0)] * 3 + [(8, 1)]
    whole = {(r.u, r.v, r.i) for r in air.trials(adoptions, edges, pos).collect()}
    assert {(r.u, r.v, r.i) for r in rows} <= whole and len(whole) == 78


def test_medians_without_a_sort(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 40):
        values = [rng.choice([0.1, 0.25, rng.random()]) for _ in range(n)]
        frame = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        assert harness.upper_median(frame, "x").first()[0] == (sorted(values)[n // 2] if n else 0.0)


def test_simulated_adoptions(spark):
    edges, users = spark.createDataFrame([(u, (u + k) % 50) for u in range(50) for k in (1, 2, 3)], "u long, v long"), spark.range(50).toDF("u")
    rows = synthetic.simulate_adoptions(edges, users, 30, 1, base=0.3).collect()
    assert {r.i for r in rows} == set(range(30)) and len({(r.u, r.i) for r in rows}) == len(rows)
    hub = spark.createDataFrame([(0, v) for v in range(1, 200)] + [(1, 2)], "u long, v long")
    starts = [r.u for r in synthetic.simulate_adoptions(hub, users, 60, 2, base=0.0, starts=1).collect()]
    assert len(starts) == 60 and starts.count(0) > 50
    with pytest.raises(ValueError):
        synthetic.simulate_adoptions(edges.where("false"), users, 3, 1)


def test_vote_attributes(spark):
    first = spark.createDataFrame([(u, 1, t) for u, t in ((1, 900), (2, 950), (3, 999))] + [(u, 2, t) for u, t in ((1, 800), (2, 90_000))] + [(1, 3, 10)], "u long, i long, t long")
    got = {r.i: dict(x.split(":") for x in r.attrs) for r in social.vote_attributes(first).collect()}
    keys = ("popular", "life", "band", "weekday", "burst")
    assert {i: tuple(x[k] for k in keys) for i, x in got.items()} == {1: ("6", "1", "0", "4", "9"), 2: ("3", "10", "0", "4", "5"), 3: ("0", "0", "0", "4", "9")}
    assert all(len(x) == 7 for x in got.values())


def test_an_archive_within_an_archive(spark, tmp_path):
    tables = {
        "business": [{"business_id": "a", "categories": "Food, Bars"}, {"business_id": "b", "categories": None}],
        "review": [{"user_id": "x", "business_id": "a", "date": "2016-03-09 20:56:34"}, {"user_id": "x", "business_id": "a", "date": "2016-03-09"}, {"user_id": "y", "business_id": "b", "date": "bad"}, {"user_id": "y", "business_id": "b", "date": "2016-03-10"}],
        "user": [{"user_id": "x", "friends": "y, z"}, {"user_id": "y", "friends": "None"}],
    }
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as tar:
        for name, rows in tables.items():
            text = ("\n".join(map(json.dumps, rows)) + "\nnot json\n").encode()
            info = tarfile.TarInfo(f"in/yelp_academic_dataset_{name}.json")
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as outer:
        outer.writestr("readme.txt", "x")
        outer.writestr("data.tar", packed.getvalue())
    assert archive.stream(str(tmp_path / "a.zip"), str(tmp_path / "stream")) == {"businesses": 2, "reviews": 3, "friends": 2, "categories": 2}
    ds = social.prepare_reviews(spark, str(tmp_path))
    assert {tuple(r) for r in ds.edges.collect()} == {(0, 1), (1, 0)} and {r.i: len(r.attrs) for r in ds.items.collect()} == {0: 2, 1: 0}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as outer:
        outer.writestr("readme.txt", "x")
    with pytest.raises(FileNotFoundError):
        archive.stream(str(tmp_path / "b.zip"), str(tmp_path / "none"))


def test_a_saved_dataset_reads_back(spark, dataset, tmp_path):
    datasets.save(dataset, str(tmp_path / "d"))
    assert datasets.load(spark, str(tmp_path / "d")).meta == dataset.meta

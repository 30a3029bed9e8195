"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.functions.randomness import u01, u01_sql
from ripplecast import harness
from ripplecast.operators import air, cascade, communities, gibbs, graph, logs, model, spread, subsample, summary
from ripplecast.operators.lineage import stable
from ripplecast.plans import derived as d
from ripplecast.plans.derived import C, DELTA, Z, sql
from ripplecast.sources import synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text)
        return f

    return add


def rounded(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


def d_logs(s: SparkSession, p: str) -> DataFrame:
    return logs.influence_logs(d.adoptions(s, p), d.edges(s, p), DELTA)


def labels5(s: SparkSession, p: str) -> DataFrame:
    c = d.read(s, p, "customer").select(F.col("c_custkey").alias("u"), "c_mktsegment")
    seg = c.select("c_mktsegment").distinct().withColumn("c", F.dense_rank().over(model_window()) - 1)
    return c.join(F.broadcast(seg), "c_mktsegment").select("u", "c")


def model_window():
    from pyspark.sql import Window

    return Window.orderBy("c_mktsegment")


def hyper(s: SparkSession, p: str, n_edges: int | None = None, n_logs: int | None = None) -> model.Hyper:
    e, n = n_edges or d.edges(s, p).count(), d_logs(s, p).count() if n_logs is None else n_logs
    return model.Hyper.make(C, Z, d.users(s, p).count(), e, n)


def fitted(s: SparkSession, p: str) -> dict[str, DataFrame]:
    """The model's matrices; links and logs are derived once, as tables that every matrix reads."""
    found, e = stable(d_logs(s, p)), stable(d.edges(s, p))
    h, ev, tok = hyper(s, p, e.count(), found.count()), stable(d.events(e, found)), d.tokens(s, p)
    phi = stable(model.phi(tok, tok.select("i").distinct(), h))
    return {"h": h, "phi": phi, "pi": model.pi(ev, d.users(s, p), h), "eta": model.eta(ev, h), "theta": model.theta(ev.where("kind = 1"), phi, h), "edges": e, "logs": found}


def weights(s: SparkSession, p: str, m: dict | None = None) -> DataFrame:
    m = m or fitted(s, p)
    tops = logs.top_items(d.adoptions(s, p), 3).select(F.col("i").alias("item"))
    return model.edge_weights(m["edges"], tops, m["pi"], m["eta"], m["theta"], m["phi"])


def hash_weights(s: SparkSession, p: str) -> DataFrame:
    """(u, v, pp): ring edges with probabilities by hash."""
    return d.ring(s, p).withColumn("pp", F.lit(0.05) + F.lit(0.4) * u01(9, F.col("u"), F.col("v")))


RING_PP = f"w AS (SELECT u, v, 0.05+0.4*{u01_sql('9', 'u', 'v')} AS pp FROM ring)"


@query("SELECT u, v, i FROM logs")
def influence_logs(s, p):
    return d_logs(s, p)


@query("SELECT i, count(*) AS n FROM logs GROUP BY i ORDER BY n DESC, i LIMIT 20")
def influence_top_items(s, p):
    return d_logs(s, p).groupBy("i").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "i").limit(20)


@query("SELECT a.u, e.v, a.i FROM buy a JOIN ring e ON a.u=e.u JOIN buy b ON b.i=a.i AND b.u=e.v WHERE b.t>a.t")
def influence_logs_ring(s, p):
    return logs.influence_logs(d.purchases(s, p), d.ring(s, p), 1 << 40)


@query(f"SELECT u, v, i FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY {u01_sql('4', 'u', 'v', 'i')}, u, v) AS r FROM logs) WHERE r<=1")
def influence_logs_capped(s, p):
    return logs.cap_per_item(d_logs(s, p), 1, 4)


@query(f"SELECT u, v, i, CASE WHEN r<=floor(n*0.6) THEN 'train' WHEN r<=floor(n*0.6)+floor(n*0.2) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY {u01_sql('5', 'u', 'v', 'i')}, u, v, i) AS r, count(*) OVER () AS n FROM logs)")
def log_split(s, p):
    return logs.split_logs(d_logs(s, p), 5)


@query("SELECT u, i, t FROM adopt")
def first_adoption(s, p):
    return logs.first_adoption(d.adoptions(s, p))


@query("SELECT u, count(*) AS n FROM adopt GROUP BY u")
def activity(s, p):
    return logs.activity(logs.first_adoption(d.adoptions(s, p)))


@query("SELECT i, count(*) AS adopters FROM adopt GROUP BY i ORDER BY adopters DESC, i LIMIT 50")
def top_items(s, p):
    return logs.top_items(d.adoptions(s, p), 50)


@query("SELECT DISTINCT u FROM (SELECT u FROM edge UNION SELECT v FROM edge) WHERE u IN (SELECT u FROM adopt)")
def active_users(s, p):
    return logs.active_users(d.adoptions(s, p), d.edges(s, p))


@query("""SELECT direction, avg(n) AS mean, median(n) AS median, max(n) AS max, min(n) AS min, count(*) FILTER (n=0) AS zeros FROM (
 SELECT 'out' AS direction, users.u, count(v) AS n FROM users LEFT JOIN edge ON edge.u=users.u GROUP BY users.u UNION ALL
 SELECT 'in', users.u, count(edge.u) FROM users LEFT JOIN edge ON edge.v=users.u GROUP BY users.u) GROUP BY direction""")
def degree_stats(s, p):
    return graph.degree_stats(d.edges(s, p), d.users(s, p))


DEGREES = ", ".join(f"(SELECT {f} FROM deg WHERE d='{d}') AS {d}_deg_{n}" for d in ("out", "in") for n, f in (("mean", "avg(n)"), ("median", "median(n)"), ("max", "max(n)"), ("min", "min(n)"), ("zeros", "count(*) FILTER (n=0)")))


@query(f"""SELECT * FROM (WITH deg AS (SELECT 'out' AS d, users.u, count(v) AS n FROM users LEFT JOIN edge ON edge.u=users.u GROUP BY users.u UNION ALL SELECT 'in', users.u, count(edge.u) FROM users LEFT JOIN edge ON edge.v=users.u GROUP BY users.u),
 l AS (SELECT count(*) AS n_logs, count(DISTINCT u) AS n_adopters, count(DISTINCT i) AS n_adopted_items, min(t) AS t_min, max(t) AS t_max FROM adoptions)
 SELECT (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM edge) AS n_links, (SELECT count(*) FROM part) AS n_items, (SELECT count(*) FROM tok0) AS n_attr_tokens, (SELECT count(*)/(SELECT count(*) FROM part) FROM tok0) AS attrs_per_item_mean, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT i FROM tok0)) AS n_items_no_attrs,
 l.*, n_logs/n_adopted_items AS logs_per_item_mean, n_logs/n_adopters AS logs_per_user_mean, (t_max-t_min)/86400.0::DOUBLE AS t_span_days, {DEGREES}, (SELECT count(*) FROM edge)/((SELECT count(*) FROM users)*((SELECT count(*) FROM users)-1.0::DOUBLE)) AS density FROM l)""")
def dataset_summary(s, p):
    items = d.tokens(s, p).groupBy("i").agg(F.collect_list("label").alias("attrs"))
    return summary.summarize(d.edges(s, p), d.adoptions(s, p), items, d.users(s, p))


@query("SELECT least(u,v) AS a, greatest(u,v) AS b, count(*) AS w FROM ring WHERE u<>v GROUP BY 1, 2")
def undirected_projection(s, p):
    return graph.projection(d.ring(s, p))


@query("SELECT u, v FROM edge UNION SELECT v, u FROM edge")
def undirected_neighbours(s, p):
    return graph.neighbours(d.edges(s, p))


@query("""SELECT round(sum(l/m-(dd/(2*m))**2),9) AS q FROM (SELECT c, sum(dd)::DOUBLE AS dd, sum(l)::DOUBLE AS l, (SELECT count(*) FROM edge)::DOUBLE AS m FROM (
 SELECT x.c, 1 AS dd, CASE WHEN x.c=y.c THEN 1 ELSE 0 END AS l FROM edge JOIN labels5 x ON x.u=edge.u JOIN labels5 y ON y.u=edge.v UNION ALL
 SELECT y.c, 1, 0 FROM edge JOIN labels5 y ON y.u=edge.v) GROUP BY c)""")
def modularity(s, p):
    return graph.modularity(d.edges(s, p), labels5(s, p)).select(F.round("q", 9).alias("q"))


@query("SELECT c, count(*) AS n FROM labels5 GROUP BY c")
def community_sizes(s, p):
    return labels5(s, p).groupBy("c").agg(F.count("*").alias("n"))


@query("""SELECT u, v FROM (SELECT e.u, e.v, row_number() OVER (PARTITION BY e.u ORDER BY a.act+b.act DESC, a.deg+b.deg DESC, e.v) AS r FROM edge e JOIN node a ON a.u=e.u JOIN node b ON b.u=e.v)
 WHERE r<=2""".replace("SELECT u, v FROM (", "SELECT u, v FROM (WITH node AS (SELECT u, count(*) AS deg, coalesce(max(n),0) AS act FROM (SELECT u FROM edge UNION ALL SELECT v FROM edge) LEFT JOIN (SELECT u, count(*) AS n FROM adopt GROUP BY u) USING (u) GROUP BY u) ", 1))
def thin_arcs_quota(s, p):
    n = d.users(s, p).count()
    return graph.thin_by_quota(d.edges(s, p), logs.activity(logs.first_adoption(d.adoptions(s, p))), 2 * n, n)


@query("SELECT label, w FROM attr")
def dense_ids(s, p):
    return d.attributes(d.tokens(s, p)).select("label", "w")


@query("SELECT i, least(9, (row_number() OVER (ORDER BY n DESC, i)-1)*10//count(*) OVER ()) AS decile FROM (SELECT i, count(*) AS n FROM adopt GROUP BY i)")
def popularity_decile(s, p):
    return logs.popularity(logs.first_adoption(d.adoptions(s, p)))


@query("SELECT rho, alpha, beta, omega, round(eps0,9) AS eps0, eps1 FROM hyp")
def hyper_parameters(s, p):
    h = hyper(s, p)
    return s.createDataFrame([(h.rho, h.alpha, h.beta, h.omega, round(h.eps0, 9), h.eps1)], "rho double, alpha double, beta double, omega double, eps0 double, eps1 double")


@query("SELECT i, z, round(p,9) AS p FROM phi")
def phi(s, p):
    t = d.tokens(s, p)
    return model.phi(t, t.select("i").distinct(), hyper(s, p)).select("i", "z", *rounded("p", digits=9))


@query("SELECT z, w, round(p,9) AS p FROM psi")
def psi(s, p):
    t = d.tokens(s, p)
    a = d.attributes(t)
    return model.psi(t.join(F.broadcast(a), "label"), a, a.count(), hyper(s, p)).select("z", "w", *rounded("p", digits=9))


@query("SELECT v, c, round(p,9) AS p FROM pi")
def pi(s, p):
    return fitted(s, p)["pi"].select("v", "c", *rounded("p", digits=9))


@query("SELECT cp, c, round(p,9) AS p FROM eta")
def eta(s, p):
    return fitted(s, p)["eta"].select("cp", "c", *rounded("p", digits=9))


@query("SELECT c, z, round(p,9) AS p FROM theta")
def theta(s, p):
    return fitted(s, p)["theta"].select("c", "z", *rounded("p", digits=9))


@query("SELECT eta.cp, eta.c, z, round(eta.p*theta.p,9) AS p FROM eta JOIN theta USING (c)")
def community_strength(s, p):
    m = fitted(s, p)
    return model.community_strength(m["eta"], m["theta"]).select("cp", "c", "z", *rounded("p", digits=9))


@query("SELECT item, u, v, round(least(greatest(raw,0),1),8) AS pp FROM pp")
def edge_weights(s, p):
    return weights(s, p).select("item", "u", "v", *rounded("pp", digits=8))


@query("SELECT u, v, round(sum(least(greatest(raw,0),1))/3,8) AS pp FROM pp GROUP BY u, v")
def topic_averaged_pp(s, p):
    return model.averaged_pp(weights(s, p), 3).select("u", "v", *rounded("pp", digits=8))


@query("SELECT item, count(*) FILTER (raw<0 OR raw>1) AS n_clamped, round(max(raw),8) AS raw_max, round(min(raw),8) AS raw_min, round(avg(raw),8) AS raw_mean FROM pp GROUP BY item")
def clamp_report(s, p):
    w = weights(s, p)
    return w.groupBy("item").agg(F.count_if((F.col("raw") < 0) | (F.col("raw") > 1)).alias("n_clamped"), F.round(F.max("raw"), 8).alias("raw_max"), F.round(F.min("raw"), 8).alias("raw_min"), F.round(F.avg("raw"), 8).alias("raw_mean"))


@query("SELECT v, c FROM (SELECT v, c, row_number() OVER (PARTITION BY v ORDER BY p DESC, c) AS r FROM pi) WHERE r=1")
def detect_communities(s, p):
    return model.detect_communities(fitted(s, p)["pi"])


@query(f"""SELECT u, nf AS n_follow, na AS n_adopt, ns AS n_succ, na*dg AS n_opp, round((nf+5.0*gf)/(na+5.0),9) AS conformity, round((ns+5.0*gi)/(na*dg+5.0),9) AS influence FROM (
 SELECT *, sum(nf) OVER ()/sum(na) OVER () AS gf, sum(ns) OVER ()/sum(na*dg) OVER () AS gi FROM (SELECT users.u, coalesce(nf,0) AS nf, coalesce(na,0) AS na, coalesce(ns,0) AS ns, coalesce(dg,0) AS dg FROM users
 LEFT JOIN (SELECT v AS u, count(DISTINCT i) AS nf FROM logs GROUP BY v) USING (u) LEFT JOIN (SELECT u, count(*) AS ns FROM logs GROUP BY u) USING (u)
 LEFT JOIN (SELECT u, count(*) AS na FROM adopt GROUP BY u) USING (u) LEFT JOIN (SELECT u, count(*) AS dg FROM edge GROUP BY u) USING (u)))""")
def conformity(s, p):
    return logs.conformity(d.adoptions(s, p), d.edges(s, p), d.users(s, p), DELTA, 5.0).select("u", "n_follow", "n_adopt", "n_succ", "n_opp", *rounded("conformity", "influence", digits=9))


@query(f"SELECT k AS sim, u, v FROM (WITH {RING_PP} SELECT * FROM w), range(4) r(k) WHERE {u01_sql('6', 'k', 'u', 'v')}<pp".replace("k AS sim", "CAST(k AS INT) AS sim"))
def live_edges(s, p):
    return spread.live_edges(hash_weights(s, p), 4, 6)


@query("SELECT u, min(c) AS component FROM (WITH RECURSIVE near AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge), reach(u, c) AS (SELECT u, u FROM users UNION SELECT near.v, reach.c FROM reach JOIN near ON near.u=reach.u) SELECT * FROM reach) GROUP BY u")
def weak_components(s, p):
    return graph.components(d.edges(s, p), d.users(s, p))


@query("""SELECT u, core FROM (WITH RECURSIVE near AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge), st(step, u, core) AS (SELECT 0, u, count(*) FROM near GROUP BY u
 UNION ALL SELECT s.step+1, s.u, least(s.core, x.h) FROM st s JOIN (SELECT u, max(r) AS h FROM (SELECT near.u, t.core AS cv, row_number() OVER (PARTITION BY near.u ORDER BY t.core DESC) AS r FROM near JOIN st t ON t.u=near.v) WHERE cv>=r GROUP BY u) x USING (u) WHERE s.step<80)
 SELECT u, core FROM st WHERE step=80)""")
def core_numbers(s, p):
    return graph.core_numbers(d.edges(s, p))


@query(SQL["core_numbers"].split(f"{d.CTES} ", 1)[1])
def core_numbers_in_rounds(s, p):
    """The same as for a graph beyond one task: by components, those that no task holds by rounds of h-indices."""
    return graph.core_numbers(d.edges(s, p), local_arcs=0)


@query("SELECT v, c, u0 AS n FROM (SELECT x.c AS v, y.c, count(*) AS u0 FROM labels5 x JOIN (SELECT v AS u, c FROM (SELECT v, c, row_number() OVER (PARTITION BY v ORDER BY p DESC, c) AS r FROM pi) WHERE r=1) y USING (u) GROUP BY x.c, y.c)")
def contingency(s, p):
    found = model.detect_communities(fitted(s, p)["pi"]).toDF("u", "c")
    return labels5(s, p).toDF("u", "v").join(found, "u").groupBy("v", "c").agg(F.count("*").alias("n"))


@query("""SELECT round((ab-sa*sb/n)/((sa+sb)/2-sa*sb/n),9) AS ari FROM (WITH y AS (SELECT v AS u, c FROM (SELECT v, c, row_number() OVER (PARTITION BY v ORDER BY p DESC, c) AS r FROM pi) WHERE r=1), x AS (SELECT labels5.u, labels5.c AS a, y.c AS b FROM labels5 JOIN y USING (u))
 SELECT (SELECT sum(k*(k-1)/2) FROM (SELECT count(*)::DOUBLE AS k FROM x GROUP BY a, b)) AS ab, (SELECT sum(k*(k-1)/2) FROM (SELECT count(*)::DOUBLE AS k FROM x GROUP BY a)) AS sa, (SELECT sum(k*(k-1)/2) FROM (SELECT count(*)::DOUBLE AS k FROM x GROUP BY b)) AS sb, (SELECT count(*)::DOUBLE*(count(*)-1)/2 FROM x) AS n)""")
def adjusted_rand(s, p):
    found = model.detect_communities(fitted(s, p)["pi"])
    return graph.adjusted_rand(labels5(s, p), found).select(F.round("ari", 9).alias("ari"))


@query(f"""SELECT root, node, round(min(dist),9) AS dist FROM (WITH {RING_PP}, path(root, node, dist) AS (SELECT u, u, 0.0::DOUBLE FROM users UNION ALL SELECT root, w.u, dist-ln(pp) FROM path JOIN w ON w.v=path.node WHERE dist-ln(pp)<=-ln(0.1)) SELECT * FROM path) GROUP BY root, node""".replace("(WITH ", "(WITH RECURSIVE ", 1))
def miia_nodes(s, p):
    return spread.arborescences(hash_weights(s, p), 0.1, d.users(s, p)).select("root", "node", *rounded("dist", digits=9))


@query(f"""SELECT root, node, round(min(dist),9) AS dist FROM (WITH {RING_PP}, path(root, node, dist) AS (SELECT u, u, 0.0::DOUBLE FROM users UNION ALL SELECT root, w.v, dist-ln(pp) FROM path JOIN w ON w.u=path.node WHERE dist-ln(pp)<=-ln(0.1)) SELECT * FROM path) GROUP BY root, node""".replace("(WITH ", "(WITH RECURSIVE ", 1))
def mioa_nodes(s, p):
    return spread.arborescences(hash_weights(s, p), 0.1, d.users(s, p), inward=False).select("root", "node", *rounded("dist", digits=9))


@query(f"""SELECT round(sum(CASE WHEN u IS NOT NULL THEN 1 ELSE 1-coalesce(f0,1) END),6) AS spread FROM (WITH RECURSIVE {RING_PP}, seeds AS (SELECT u FROM users ORDER BY u LIMIT 10),
 path(root, node, dist, hops, parent) AS (SELECT u, u, 0.0::DOUBLE, 0, NULL::BIGINT FROM users UNION ALL SELECT root, w.u, dist-ln(pp), hops+1, path.node FROM path JOIN w ON w.v=path.node WHERE dist-ln(pp)<=-ln(0.1) AND w.u<>root),
 tree AS (SELECT root, node, first(hops ORDER BY dist, hops, parent) AS hops, first(parent ORDER BY dist, hops, parent) AS parent FROM path GROUP BY root, node),
 two AS (SELECT root, parent AS node, product(1-pp) AS f FROM tree JOIN w ON w.u=node AND w.v=parent WHERE hops=2 AND node IN (SELECT u FROM seeds) GROUP BY 1, 2),
 one AS (SELECT tree.root, product(1-pp*(CASE WHEN tree.node IN (SELECT u FROM seeds) THEN 1 ELSE 1-coalesce(f,1) END)) AS f0 FROM tree JOIN w ON w.u=tree.node AND w.v=tree.parent LEFT JOIN two ON two.root=tree.root AND two.node=tree.node WHERE hops=1 GROUP BY 1)
 SELECT f0, seeds.u FROM users LEFT JOIN one ON one.root=users.u LEFT JOIN seeds ON seeds.u=users.u)""")
def influence_spread(s, p):
    w = stable(hash_weights(s, p))
    trees = spread.arborescences(w, 0.1, d.users(s, p))
    seeds = d.users(s, p).orderBy("u").limit(10)
    return spread.activation(trees, w, seeds).agg(F.round(F.sum("ap"), 6).alias("spread"))


@query(f"SELECT v, round(1-exp(sum(ln(1-pp*0.5))),9) AS ap FROM (WITH {RING_PP} SELECT * FROM w) GROUP BY v")
def noisy_or(s, p):
    return hash_weights(s, p).groupBy("v").agg((1 - F.product(1 - F.col("pp") * 0.5)).alias("ap")).select("v", *rounded("ap", digits=9))


@query()
def community_seeds(s, p):
    return spread.select_seeds(hash_weights(s, p), labels5(s, p), 0.1, 10)


@query("SELECT u, v, z, round(sum(a*s*b),9) AS p FROM (SELECT e.u, e.v, t.z, x.p AS a, eta.p*t.p AS s, y.p AS b FROM edge e JOIN pi x ON x.v=e.u JOIN eta ON eta.cp=x.c JOIN theta t ON t.c=eta.c JOIN pi y ON y.v=e.v AND y.c=eta.c) GROUP BY u, v, z")
def user_to_user_topic(s, p):
    m = fitted(s, p)
    return model.user_to_user(m["edges"], m["pi"], m["eta"], m["theta"]).select("u", "v", "z", *rounded("p", digits=9))


@query("""SELECT item, u, v, round(least(greatest(raw,0),1),8) AS pp FROM (WITH pit AS (SELECT v, c, CASE WHEN row_number() OVER (PARTITION BY v ORDER BY p DESC, c)<=2 THEN p ELSE 0 END AS p FROM pi), aut AS (SELECT v AS u, eta.c, sum(pit.p*eta.p) AS a FROM pit JOIN eta ON eta.cp=pit.c GROUP BY v, eta.c)
 SELECT item, e.u, e.v, sum(a*pit.p*b) AS raw FROM edge e JOIN aut ON aut.u=e.u JOIN pit ON pit.v=e.v AND pit.c=aut.c JOIN bar ON bar.c=aut.c GROUP BY item, e.u, e.v)""")
def edge_weights_top2(s, p):
    """Weights by each user's two largest communities alone."""
    m = fitted(s, p)
    tops = logs.top_items(d.adoptions(s, p), 3).select(F.col("i").alias("item"))
    return model.edge_weights(m["edges"], tops, m["pi"], m["eta"], m["theta"], m["phi"], top_c=2).select("item", "u", "v", *rounded("pp", digits=8))


@query("SELECT u, v, i FROM logs WHERE i NOT IN (SELECT item FROM tops)")
def holdout_logs(s, p):
    """Logs of items that are not scored."""
    tops = logs.top_items(d.adoptions(s, p), 3).select("i")
    return d_logs(s, p).join(F.broadcast(tops), "i", "left_anti").select("u", "v", "i")


@query("""SELECT 'user' AS name, v AS a, c AS b, count(*) AS n FROM side GROUP BY v, c UNION ALL SELECT 'pair', cp, c, count(*) FROM ev GROUP BY cp, c UNION ALL SELECT 'item', i, c, count(*) FROM ev WHERE kind=1 GROUP BY i, c""")
def event_counts(s, p):
    m = fitted(s, p)
    return gibbs.event_counts(d.events(m["edges"], m["logs"]))


@query("SELECT item, u, v, round(raw,8) AS p FROM pp")
def edge_weights_naive(s, p):
    m = fitted(s, p)
    tops = logs.top_items(d.adoptions(s, p), 3).select(F.col("i").alias("item"))
    return model.user_to_user_item(model.user_to_user(m["edges"], m["pi"], m["eta"], m["theta"]), m["phi"], tops).select("item", "u", "v", *rounded("p", digits=8))


def dense_tokens(s: SparkSession, p: str) -> DataFrame:
    tok = d.tokens(s, p)
    return tok.join(F.broadcast(d.attributes(tok)), "label").select("i", "pos", "w", "z")


@query(f"""SELECT i, pos, w, CAST(least(count(*) FILTER (cum<=r*total), {Z - 1}) AS INT) AS z FROM (
 SELECT *, sum(q) OVER (PARTITION BY i, pos ORDER BY k) AS cum, sum(q) OVER (PARTITION BY i, pos) AS total, {u01_sql('21', '1', 'i', 'pos')} AS r FROM (
  SELECT x.i, x.pos, x.w, zs.z AS k, (coalesce(iz.n,0)-own+omega)*(coalesce(zw.n,0)-own+beta)/(nz.n-own+f*beta) AS q
  FROM (SELECT *, (SELECT count(*) FROM attr) AS f FROM tok JOIN attr USING (label)) x CROSS JOIN zs CROSS JOIN hyp CROSS JOIN LATERAL (SELECT CAST(x.z=zs.z AS INT) AS own) o
  LEFT JOIN (SELECT i, z, count(*) AS n FROM tok GROUP BY i, z) iz ON iz.i=x.i AND iz.z=zs.z LEFT JOIN (SELECT w, z, count(*) AS n FROM tok JOIN attr USING (label) GROUP BY w, z) zw ON zw.w=x.w AND zw.z=zs.z
  JOIN (SELECT z, count(*) AS n FROM tok GROUP BY z) nz ON nz.z=zs.z)) GROUP BY i, pos, w""")
def gibbs_topic_sweep(s, p):
    tok = dense_tokens(s, p)
    return gibbs.topic_sweep(tok, tok.select("w").distinct().count(), hyper(s, p), 21, 1)


@query()
def gibbs_communities(s, p):
    """Sizes of the community pairs after three exact sweeps."""
    m = fitted(s, p)
    ev = gibbs.sample_communities(m["edges"], m["logs"], m["phi"], m["h"], 3, 22)
    return ev.groupBy("kind", "cp", "c").agg(F.count("*").alias("n"))


@query()
def train_model(s, p):
    """The largest community of each user by a model of five topic and three community sweeps."""
    tok = dense_tokens(s, p).drop("z")
    n = tok.select("w").distinct().count()
    found = gibbs.train(d.users(s, p), tok.select("i").distinct(), tok, d.edges(s, p), d_logs(s, p), n, C, Z, 5, 3, 23, exact=False)
    return model.detect_communities(found.pi)


TRIALS = "neg AS (SELECT a.u, e.v, a.i FROM adopt a JOIN edge e USING (u) WHERE a.i IN (SELECT i FROM logs) EXCEPT SELECT u, v, i FROM logs), tr AS (SELECT DISTINCT u, v, i, 1 AS y FROM logs UNION ALL SELECT u, v, i, 0 FROM neg)"


@query(f"SELECT u, v, i, y FROM (WITH {TRIALS} SELECT * FROM tr)")
def air_trials(s, p):
    return air.trials(d.adoptions(s, p), d.edges(s, p), d_logs(s, p))


@query(f"SELECT u, v, i, y FROM (WITH {TRIALS} SELECT *, row_number() OVER (PARTITION BY i, y ORDER BY {u01_sql('33', 'u', 'v', 'i')}, u, v) AS r, sum(y) OVER (PARTITION BY i) AS pos FROM tr) WHERE y=1 OR r<=2*pos")
def air_trials_capped(s, p):
    """At most two failures for each success of an item."""
    return air.trials(d.adoptions(s, p), d.edges(s, p), d_logs(s, p), per_positive=2, seed=33)


def em_sql(key: str, num: str) -> str:
    return f"SELECT '{key}' AS side, {key} AS id, z, round(least(greatest((sum({num})+0.5)/(sum(r)+2.0),1e-9),1-1e-9),9) AS p FROM em GROUP BY {key}, z"


@query(f"""SELECT * FROM (WITH {TRIALS}, g0 AS (SELECT i, z, 0.5+{u01_sql('31', "'g'", 'i', 'z')} AS g FROM (SELECT DISTINCT i FROM tr), zs),
 g1 AS (SELECT i, z, g/sum(g) OVER (PARTITION BY i) AS g FROM g0),
 w0 AS (SELECT *, 0.25*(0.5+{u01_sql('31', "'a'", 'u', 'z')}) AS a, 0.25*(0.5+{u01_sql('31', "'b'", 'v', 'z')}) AS b FROM tr JOIN g1 USING (i)),
 w1 AS (SELECT *, CASE WHEN y=1 THEN g*a*b ELSE g*(1-a*b) END AS w FROM w0), em0 AS (SELECT *, w/sum(w) OVER (PARTITION BY u, v, i) AS r FROM w1),
 em AS (SELECT *, CASE WHEN y=1 THEN r ELSE r*a*(1-b)/(1-a*b) END AS na, CASE WHEN y=1 THEN r ELSE r*b*(1-a)/(1-a*b) END AS nb FROM em0)
 {em_sql('u', 'na')} UNION ALL {em_sql('v', 'nb')} UNION ALL SELECT 'i', i, z, round((sum(r)+0.5)/sum(sum(r)+0.5) OVER (PARTITION BY i),9) FROM em GROUP BY i, z)""")
def air_em_step(s, p):
    tr = stable(air.trials(d.adoptions(s, p), d.edges(s, p), d_logs(s, p)))
    A, I, gamma = air.em_step(tr, *air.initial(tr, Z, 31), Z)  # noqa: E741
    one = lambda df, side: df.select(F.lit(side).alias("side"), F.col(side).alias("id"), "z", *rounded("p", digits=9))
    return one(A, "u").union(one(I, "v")).union(one(gamma, "i"))


def air_fit(s: SparkSession, p: str, e: DataFrame) -> DataFrame:
    """Weights of the edges e; first adoptions are derived once."""
    first = logs.first_by_user(d.adoptions(s, p))
    A, I, gamma, _ = air.fit(air.trials(first, e, logs.logs_of_first(first, e, DELTA)), Z, 5, 31, last=False)  # noqa: E741
    tops = logs.most_adopted(first, 1).select(F.col("i").alias("item"))
    return air.edge_weights(e, tops, A, I, gamma, Z).select("u", "v", "pp")


@query(f"""SELECT u, v, round(least(greatest(raw*(avg(base) OVER ()/avg(raw) OVER ()),0),1),9) AS pp FROM (SELECT w.u, w.v, w.pp AS base, w.pp*x.influence/m.mi*y.conformity/m.mc AS raw FROM (WITH {RING_PP} SELECT * FROM w) w
 JOIN prof x ON x.u=w.u JOIN prof y ON y.u=w.v CROSS JOIN (SELECT avg(influence) AS mi, avg(conformity) AS mc FROM prof) m)""".replace("prof", "(SELECT u, (nf+5.0*gf)/(na+5.0) AS conformity, (ns+5.0*gi)/(na*dg+5.0) AS influence FROM (SELECT *, sum(nf) OVER ()/sum(na) OVER () AS gf, sum(ns) OVER ()/sum(na*dg) OVER () AS gi FROM (SELECT users.u, coalesce(nf,0) AS nf, coalesce(na,0) AS na, coalesce(ns,0) AS ns, coalesce(dg,0) AS dg FROM users LEFT JOIN (SELECT v AS u, count(DISTINCT i) AS nf FROM logs GROUP BY v) USING (u) LEFT JOIN (SELECT u, count(*) AS ns FROM logs GROUP BY u) USING (u) LEFT JOIN (SELECT u, count(*) AS na FROM adopt GROUP BY u) USING (u) LEFT JOIN (SELECT u, count(*) AS dg FROM edge GROUP BY u) USING (u))))"))
def conformity_pp(s, p):
    profile = logs.conformity(d.adoptions(s, p), d.edges(s, p), d.users(s, p), DELTA, 5.0)
    return cascade.conformity_pp(hash_weights(s, p), profile).select("u", "v", *rounded("pp", digits=9))


@query(f"""SELECT count(*)/20.0::DOUBLE AS spread FROM (WITH RECURSIVE {RING_PP}, reach(sim, u) AS (SELECT CAST(k AS INT), u FROM (SELECT u FROM users ORDER BY u LIMIT 10), range(20) r(k)
 UNION SELECT sim, w.v FROM reach JOIN w USING (u) WHERE {u01_sql('41', 'sim', 'w.u', 'w.v')}<pp) SELECT * FROM reach)""")
def mc_ic_spread(s, p):
    return cascade.ic_spread(hash_weights(s, p), d.users(s, p).orderBy("u").limit(10), 20, 41)


@query()
def greedy_seeds(s, p):
    return cascade.monte_carlo_greedy(hash_weights(s, p), d.users(s, p), 5, 10, 42)


@query()
def cga_seeds(s, p):
    return cascade.select_cga(hash_weights(s, p), labels5(s, p), 10, 20, 43)


@query()
def cinema_seeds(s, p):
    profile = logs.conformity(d.adoptions(s, p), d.edges(s, p), d.users(s, p), DELTA, 5.0)
    w = stable(cascade.conformity_pp(hash_weights(s, p), profile))
    return cascade.select_cinema(w, communities.agglomerated(d.edges(s, p), d.users(s, p), C), 10, 20, 44)


@query()
def air_cga_seeds(s, p):
    e = stable(d.edges(s, p))
    return cascade.select_cga(stable(air_fit(s, p, e)), communities.agglomerated(e, d.users(s, p), C), 10, 20, 45)


@query()
def model_cga_seeds(s, p):
    m = fitted(s, p)
    w = stable(weights(s, p, m).groupBy("u", "v").agg(F.max("pp").alias("pp")))
    return cascade.select_cga(w, model.detect_communities(m["pi"]).toDF("u", "c"), 10, 20, 46)


@query()
def modularity_communities(s, p):
    return communities.agglomerated(d.edges(s, p), d.users(s, p))


@query()
def modularity_communities_parallel(s, p):
    """Parallel rounds down to half of the pairs, the rest in one task."""
    return communities.parallel(d.edges(s, p), d.users(s, p), small=d.edges(s, p).count() // 2)


@query()
def dense_core(s, p):
    n = d.users(s, p).count()
    return subsample.dense_core(d.edges(s, p), logs.activity(d.adoptions(s, p)), n // 3)


@query("""SELECT u, v FROM (WITH t AS (SELECT 3*count(*) AS n FROM users), node AS (SELECT u, count(*) AS deg, coalesce(max(n),0) AS act FROM (SELECT u FROM edge UNION ALL SELECT v FROM edge) LEFT JOIN (SELECT u, count(*) AS n FROM adoptions GROUP BY u) USING (u) GROUP BY u),
 sc AS (SELECT e.u, e.v, -(a.act+b.act) AS s1, -(a.deg+b.deg) AS s2 FROM edge e JOIN node a ON a.u=e.u JOIN node b ON b.u=e.v),
 q AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY u ORDER BY s1, s2, v)<=greatest(1, (SELECT n FROM t)//(SELECT count(*) FROM node)) THEN 0 ELSE 1 END AS f FROM sc),
 kept AS (SELECT u, v, s1, s2 FROM (SELECT *, row_number() OVER (ORDER BY f, s1, s2, u, v) AS r FROM q) WHERE r<=(SELECT n FROM t)),
 lost AS (SELECT u AS x FROM node WHERE u NOT IN (SELECT u FROM kept UNION SELECT v FROM kept)),
 back AS (SELECT DISTINCT u, v, s1, s2 FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s1, s2, u, v) AS r FROM (SELECT u AS x, q.* FROM q UNION ALL SELECT v, q.* FROM q) WHERE x IN (SELECT x FROM lost)) WHERE r=1),
 whole AS (SELECT *, 0 AS added FROM kept UNION ALL SELECT *, 1 FROM back),
 hold AS (SELECT DISTINCT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY x ORDER BY s1, s2, u, v) AS r FROM (SELECT u AS x, whole.* FROM whole UNION ALL SELECT v, whole.* FROM whole)) WHERE r=1),
 gone AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY s1 DESC, s2 DESC, u DESC, v DESC) AS r FROM whole ANTI JOIN hold USING (u, v) WHERE added=0) WHERE r<=(SELECT count(*) FROM whole)-(SELECT n FROM t))
 SELECT u, v FROM whole ANTI JOIN gone USING (u, v))""")
def thin_arcs(s, p):
    return subsample.thin(d.edges(s, p), logs.activity(d.adoptions(s, p)), 3 * d.users(s, p).count())


@query()
def synthetic_dataset(s, p):
    """Adopters of each item of a generated dataset of as many users as there are customers."""
    n = d.users(s, p).count()
    ds = synthetic.generate(s, n, 5 * n, 50, 40, C, Z, 51)
    return ds.adoptions.groupBy("i").agg(F.count("*").alias("adopters"))


FIRST_ITEM = "(SELECT i FROM adopt GROUP BY i ORDER BY count(*) DESC, i LIMIT 1)"


@query(f"""SELECT round(mean_top,9) AS mean_top, 1/{C}.0::DOUBLE AS uniform, n_communities, round(pp_max,8) AS pp_max, round(pp_min,8) AS pp_min, round(pp_mean,8) AS pp_mean, round(share_of_h,8) AS share_of_h, round(pp_median,8) AS pp_median, share_of_h=0 AS degenerate FROM
 (SELECT avg(p) AS mean_top, count(DISTINCT c) AS n_communities FROM (SELECT p, c, row_number() OVER (PARTITION BY v ORDER BY p DESC, c) AS r FROM pi) WHERE r=1),
 (SELECT max(w) AS pp_max, min(w) AS pp_min, avg(w) AS pp_mean, avg(CAST(w>=0.01 AS INT)) AS share_of_h, max(w) FILTER (r=n//2+1) AS pp_median FROM (SELECT w, row_number() OVER (ORDER BY w) AS r, count(*) OVER () AS n FROM (SELECT least(greatest(raw,0),1) AS w FROM pp WHERE item={FIRST_ITEM})))""")
def model_diagnostics(s, p):
    m = fitted(s, p)
    own = weights(s, p, m).join(F.broadcast(logs.top_items(d.adoptions(s, p), 1).select(F.col("i").alias("item"))), "item", "left_semi")
    found = harness.diagnostics(m["pi"], stable(own), 0.01, C)
    return found.select(F.round("mean_top", 9).alias("mean_top"), "uniform", "n_communities", *rounded("pp_max", "pp_min", "pp_mean", "share_of_h", "pp_median", digits=8), "degenerate")


@query()
def gibbs_in_turn(s, p):
    """Sizes of the community pairs after two sweeps that draw one event after the other."""
    m = fitted(s, p)
    ev = gibbs.sample_communities_in_turn(m["edges"], m["logs"], m["phi"], m["h"], 2, 24)
    return ev.groupBy("kind", "cp", "c").agg(F.count("*").alias("n"))


@query()
def simulated_adoptions(s, p):
    """Adopters of 20 made-up items on the ring."""
    found = synthetic.simulate_adoptions(d.ring(s, p), d.users(s, p), 20, 53, base=0.05)
    return found.groupBy("i").agg(F.count("*").alias("adopters"))


@query()
def method_sweep(s, p):
    """Spread of two selection methods over two budgets, on the ring's weights."""
    w = stable(hash_weights(s, p).withColumn("item", F.lit(0).cast("long")))
    flat = w.select("u", "v", "pp")
    methods = {"communities": lambda item, k: spread.select_seeds(flat, labels5(s, p), 0.1, k), "sampled": lambda item, k: cascade.select_cga(flat, labels5(s, p), k, 10, 52)}
    points = harness.sweep(s, methods, [2, 4], [0], harness.evaluator(w, 0.1))
    return points.select("method", "k", "item", F.round("spread", 6).alias("spread"), "seeds", "status")

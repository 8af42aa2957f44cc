"""All queries of the engine by name, with their SQL where it can express them.

Results are rounded to six digits on both sides, as sums of floating-point
numbers depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names, scores
from plumbline.operators import graph as gr
from plumbline.operators import history, mutate, policy, test_suite
from plumbline.operators import statistics as st
from plumbline.operators import traversal as tr
from plumbline.plans import engine
from plumbline.plans import fixtures as fx
from plumbline.plans.lineage import materialize, shared_dir
from plumbline.sources import code, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["stability"](spark, sf_dir)


# --- graph metrics ----------------------------------------------------------------------------------------------------

_PACKAGES = """p AS (SELECT id, array_to_string(string_split(id,'.')[1:2],'.') AS pkg FROM nodes),
x AS (SELECT a.pkg ps, b.pkg pt FROM trade JOIN p a ON src=a.id JOIN p b ON tgt=b.id WHERE a.pkg<>b.pkg),
i AS (SELECT pkg AS package, coalesce(ca,0) AS fan_in, coalesce(ce,0) AS fan_out, coalesce(coalesce(ce,0)/nullif(coalesce(ce,0)+coalesce(ca,0),0),0.5) AS instability
FROM (SELECT DISTINCT pkg FROM p) LEFT JOIN (SELECT ps pkg, count(*) ce FROM x GROUP BY 1) USING (pkg) LEFT JOIN (SELECT pt pkg, count(*) ca FROM x GROUP BY 1) USING (pkg))"""
_DEGREES = """d AS (SELECT id, coalesce(i,0) AS fan_in, coalesce(o,0) AS fan_out, coalesce(coalesce(o,0)/nullif(coalesce(o,0)+coalesce(i,0),0),0.5) AS instability
FROM nodes LEFT JOIN (SELECT tgt id, count(*) i FROM {0} GROUP BY 1) USING (id) LEFT JOIN (SELECT src id, count(*) o FROM {0} GROUP BY 1) USING (id))"""
_REACH = """r(a,b) AS (SELECT src,tgt FROM hops UNION SELECT r.a,h.tgt FROM r JOIN hops h ON r.b=h.src),
c AS (SELECT x.a AS id, min(x.b) AS cycle, count(*) AS size FROM r x JOIN r y ON x.a=y.b AND x.b=y.a GROUP BY 1 HAVING count(*)>1)"""


@query("stability", f"WITH {fx.TRADE}, {_PACKAGES} SELECT 'g' AS graph_id, round(CASE WHEN count(*)<=1 THEN 0.0 ELSE least(1.0, var_pop(instability)/0.25) END,6) AS stability FROM i")
def _(spark, d):
    return gr.stability(fx.trade(spark, d))


@query("package_instability", f"WITH {fx.TRADE}, {_PACKAGES} SELECT 'g' AS graph_id, package, fan_in, fan_out, round(instability,6) AS instability FROM i")
def _(spark, d):
    return gr.package_instability(fx.trade(spark, d))


@query("instability_variance", f"WITH {fx.TRADE}, {_DEGREES.format('trade')} SELECT 'g' AS graph_id, round(least(1.0, var_pop(instability)/0.25),6) AS instability_variance FROM d")
def _(spark, d):
    return gr.instability_variance(fx.trade(spark, d))


@query("degrees", f"WITH {fx.TRADE}, {_DEGREES.format('trade')} SELECT 'g' AS graph_id, id, fan_in, fan_out FROM d")
def _(spark, d):
    return gr.degrees(fx.trade(spark, d))


@query("boundary_crossing", f"WITH {fx.TRADE} SELECT 'g' AS graph_id, round(1.0-avg(CASE WHEN array_to_string(string_split(src,'.')[1:2],'.')<>array_to_string(string_split(tgt,'.')[1:2],'.') THEN 1.0 ELSE 0.0 END),6) AS boundary_crossing FROM trade")
def _(spark, d):
    return gr.boundary_crossing(fx.trade(spark, d))


@query("module_summary", f"""WITH RECURSIVE {fx.HOPS}, {_DEGREES.format('hops')}, {_REACH}
SELECT 'g' AS graph_id, count(*) AS n_modules, round(avg(fan_in),6) AS avg_fan_in, max(fan_in) AS max_fan_in, round(avg(fan_out),6) AS avg_fan_out, max(fan_out) AS max_fan_out,
round(stddev_samp(fan_out),6) AS fan_out_std, count(c.id) AS n_in_scc, round(count(c.id)/count(*),6) AS scc_fraction FROM d LEFT JOIN c USING (id)""")
def _(spark, d):
    g = fx.hops(spark, d)
    return gr.module_summary(gr.module_metrics(g, tr.cycles(g.inner_edges())))


@query("top_modules", f"""WITH RECURSIVE {fx.HOPS}, {_DEGREES.format('hops')}, {_REACH}
SELECT 'g' AS graph_id, id, fan_in, fan_out, round(instability,6) AS instability, cycle IS NOT NULL AS in_cycle, row_number() OVER (ORDER BY fan_out DESC, id)::INT AS place FROM d LEFT JOIN c USING (id) QUALIFY place<=50""")
def _(spark, d):
    g = fx.hops(spark, d)
    return gr.top_modules(gr.module_metrics(g, tr.cycles(g.inner_edges())))


@query("cycles", f"WITH RECURSIVE {fx.HOPS}, {_REACH} SELECT 'g' AS graph_id, id, least(id, cycle) AS cycle, size FROM c")
def _(spark, d):
    return tr.cycles(fx.hops(spark, d).edges)


@query("acyclicity", f"WITH RECURSIVE {fx.HOPS}, {_REACH} SELECT 'g' AS graph_id, round(1.0-coalesce((SELECT max(size) FROM c),0)/(SELECT count(*) FROM nodes),6) AS acyclicity")
def _(spark, d):
    return tr.acyclicity(fx.hops(spark, d))


@query("acyclicity_by_joins", f"WITH RECURSIVE {fx.HOPS}, {_REACH} SELECT 'g' AS graph_id, round(1.0-coalesce((SELECT max(size) FROM c),0)/(SELECT count(*) FROM nodes),6) AS acyclicity")
def _(spark, d):
    return tr.acyclicity(fx.hops(spark, d), small=0)


_CCD = f"""WITH RECURSIVE {fx.HOPS}, {_REACH}, t AS (SELECT (SELECT count(*) FROM r WHERE a<>b)+count(*) AS raw, count(*) AS n FROM nodes)
SELECT 'g' AS graph_id, raw AS ccd_raw, round(least(10.0, raw/(n*log2(n+1))),6) AS ccd_norm, round(raw/n,6) AS avg_reachable FROM t"""


@query("cumulative_dependency", _CCD)
def _(spark, d):
    return tr.cumulative_dependency(fx.hops(spark, d))


@query("cumulative_dependency_by_joins", _CCD)
def _(spark, d):
    return tr.cumulative_dependency(fx.hops(spark, d), small=0)


_SIMILAR = f"""WITH {fx.HOPS}, u AS (SELECT src a, tgt w FROM hops UNION SELECT tgt, src FROM hops), k AS (SELECT a, count(*) n FROM u GROUP BY 1),
s AS (SELECT src, tgt, (SELECT count(*) FROM u x JOIN u y ON x.w=y.w WHERE x.a=src AND y.a=tgt) AS shared, p.n+q.n AS both_n FROM hops JOIN k p ON p.a=src JOIN k q ON q.a=tgt)"""


@query("edge_similarity", f"{_SIMILAR} SELECT 'g' AS graph_id, src, tgt, shared, round(shared/(both_n-shared),6) AS similarity FROM s")
def _(spark, d):
    return gr.edge_similarity(fx.hops(spark, d))


@query("indirect_coupling", f"{_SIMILAR}, v AS (SELECT shared/(both_n-shared) x FROM s) SELECT 'g' AS graph_id, round(coalesce(avg(x),0),6) AS mean_ic, round(coalesce(max(x),0),6) AS max_ic, round(coalesce(avg(CASE WHEN x>0.5 THEN 1.0 ELSE 0.0 END),0),6) AS ic_above_05, count(*) AS n_pairs FROM v")
def _(spark, d):
    return gr.indirect_coupling(fx.hops(spark, d))


_PROFILE = f"WITH {fx.HOPS}, n AS (SELECT src, count(*) n FROM hops GROUP BY 1), q AS (SELECT a.src a, b.src b, count(*) shared FROM hops a JOIN hops b ON a.tgt=b.tgt AND a.src<b.src GROUP BY 1,2), v AS (SELECT a, b, shared, shared/(x.n+y.n-shared) s FROM q JOIN n x ON x.src=a JOIN n y ON y.src=b)"


@query("profile_similarity", f"{_PROFILE} SELECT 'g' AS graph_id, a, b, shared, round(s,6) AS similarity FROM v")
def _(spark, d):
    return gr.profile_similarity(fx.hops(spark, d))


@query("profile_coupling", f"{_PROFILE} SELECT 'g' AS graph_id, round(coalesce(avg(s),0),6) AS mean_ic, round(coalesce(max(s),0),6) AS max_ic, round(coalesce(avg(CASE WHEN s>0.5 THEN 1.0 ELSE 0.0 END),0),6) AS ic_above_05, count(*) AS n_pairs FROM v")
def _(spark, d):
    return gr.profile_coupling(fx.hops(spark, d))


@query("lcom4", f"WITH RECURSIVE {fx.LCOM4} SELECT lcom4, count(*) AS n FROM lcom GROUP BY 1")
def _(spark, d):
    return tr.lcom4(fx.classes(spark, d)).groupBy("lcom4").agg(F.count(F.lit(1)).alias("n"))


@query("cohesion", f"WITH RECURSIVE {fx.LCOM4} SELECT 'g' AS graph_id, round(1.0-avg(least(1.0,(lcom4-1)/4.0)),6) AS cohesion FROM lcom")
def _(spark, d):
    return tr.cohesion(tr.lcom4(fx.classes(spark, d)))


@query("newman_q", f"""WITH {fx.TRADE}, p AS (SELECT id, array_to_string(string_split(id,'.')[1:2],'.') AS pkg FROM nodes), e AS (SELECT a.pkg ca, b.pkg cb FROM trade JOIN p a ON a.id=src JOIN p b ON b.id=tgt),
c AS (SELECT pkg, sum(l) l, sum(k) k FROM (SELECT ca pkg, CASE WHEN ca=cb THEN 1 ELSE 0 END l, 1 k FROM e UNION ALL SELECT cb, 0, 1 FROM e) GROUP BY 1), m AS (SELECT count(*) m FROM e)
SELECT 'g' AS graph_id, round(sum(l/m-(k/(2.0*m))*(k/(2.0*m))),6) AS modularity_q FROM c, m""")
def _(spark, d):
    g = fx.trade(spark, d)
    return gr.newman_q(g.edges, g.nodes.select("graph_id", "id", names.package(F.col("id")).alias("community")))


@query("communities")
def _(spark, d):
    return tr.communities(fx.hops(spark, d).edges)


@query("modularity")
def _(spark, d):
    return engine.modularity(fx.hops(spark, d))


def _by_package(g: gr.Graph) -> DataFrame:
    return g.nodes.select("graph_id", "id", names.package(F.col("id")).alias("community"))


_Q = f"""WITH {fx.TRADE}, p AS (SELECT id, array_to_string(string_split(id,'.')[1:2],'.') AS pkg FROM nodes), e AS (SELECT a.pkg ca, b.pkg cb FROM trade JOIN p a ON a.id=src JOIN p b ON b.id=tgt),
c AS (SELECT pkg, sum(l) l, sum(k) k FROM (SELECT ca pkg, CASE WHEN ca=cb THEN 1 ELSE 0 END l, 1 k FROM e UNION ALL SELECT cb, 0, 1 FROM e) GROUP BY 1), m AS (SELECT count(*) m FROM e)
SELECT 'g' AS graph_id, least(1.0, greatest(0.0, sum(l/m-(k/(2.0*m))*(k/(2.0*m))))/0.75) AS modularity FROM c, m"""


@query("modularity_of_packages", f"SELECT graph_id, round(modularity,6) AS modularity FROM ({_Q})")
def _(spark, d):
    g = fx.trade(spark, d)
    return engine.modularity(g, _by_package(g))


@query("measure", f"""SELECT graph_id, nodes, edges, round(modularity,6) AS modularity, 1.0::DOUBLE AS acyclicity, round(stability,6) AS stability, round(cohesion,6) AS cohesion, NULL::VARCHAR AS language, round((modularity+1.0+stability+cohesion)/4,6) AS score
FROM ({_Q}) JOIN (WITH {fx.TRADE}, {_PACKAGES} SELECT 'g' AS graph_id, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM trade) AS edges, least(1.0, var_pop(instability)/0.25) AS stability FROM i) USING (graph_id)
JOIN (WITH RECURSIVE {fx.LCOM4} SELECT 'g' AS graph_id, 1.0-avg(least(1.0,(lcom4-1)/4.0)) AS cohesion FROM lcom) USING (graph_id)""")
def _(spark, d):
    g = fx.trade(spark, d)
    return engine.measure(g, tr.lcom4(fx.classes(spark, d)), membership=_by_package(g))


@query("extended", f"""SELECT * FROM ({_CCD}) JOIN ({_SIMILAR}, v AS (SELECT shared/(both_n-shared) x FROM s) SELECT 'g' AS graph_id, round(coalesce(avg(x),0),6) AS mean_ic, round(coalesce(max(x),0),6) AS max_ic, round(coalesce(avg(CASE WHEN x>0.5 THEN 1.0 ELSE 0.0 END),0),6) AS ic_above_05, count(*) AS n_pairs FROM v) USING (graph_id)
JOIN ({ORACLES['module_summary']}) USING (graph_id) JOIN (WITH {fx.HOPS} SELECT 'g' AS graph_id, round(1.0-avg(CASE WHEN src<>tgt THEN 1.0 ELSE 0.0 END),6) AS boundary_crossing FROM hops) USING (graph_id)""")
def _(spark, d):
    return engine.extended(fx.hops(spark, d))


@query("package_names", f"WITH {fx.TRADE} SELECT id, string_split(id,'.')[1] AS top, array_to_string(string_split(id,'.')[1:2],'.') AS package, replace(id,'.','/') AS path FROM nodes")
def _(spark, d):
    c = F.col("id")
    return fx.trade(spark, d).nodes.select("id", names.top(c).alias("top"), names.package(c).alias("package"), names.path_form(c).alias("path"))


@query("dominant_internal", f"""WITH {fx.TRADE}, r AS (SELECT string_split(id,'.')[1] root, count(*) n FROM nodes GROUP BY 1),
k AS (SELECT root, coalesce(sum(n) OVER (ORDER BY n DESC, root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)/(SELECT sum(n) FROM r) AS b FROM r)
SELECT 'g' AS graph_id, id FROM nodes JOIN k ON string_split(id,'.')[1]=root WHERE b<0.6""")
def _(spark, d):
    return gr.dominant_internal(fx.trade(spark, d))


@query("internal_with_targets", f"""WITH {fx.TRADE}, w AS (SELECT id FROM nodes WHERE id LIKE 'ASIA.%' UNION SELECT tgt FROM trade WHERE src LIKE 'ASIA.%')
SELECT 'g' AS graph_id, src, tgt FROM trade WHERE src IN (SELECT id FROM w) AND tgt IN (SELECT id FROM w)""")
def _(spark, d):
    g = fx.trade(spark, d)
    return gr.internal_with_targets(gr.Graph(g.nodes.withColumn("internal", F.col("id").startswith("ASIA.")), g.edges)).edges


# --- policies ---------------------------------------------------------------------------------------------------------

RULES = (
    {"name": "r1", "type": "forbidden", "from": "ASIA/*", "to": "EUROPE/*"}, {"name": "r2", "type": "forbidden", "from": "*/C1*", "to": "AMERICA/*/S?"},
    {"name": "r3", "type": "forbidden", "from": "AFRICA/*", "to": "[!A]*"}, {"name": "r4", "type": "allowed", "from": "*", "to": "*"},
)
_VIOLATIONS = f"""WITH {fx.TRADE}, w AS (SELECT src, tgt, replace(src,'.','/') a, replace(tgt,'.','/') b FROM trade), v AS (
SELECT 'g' AS graph_id, src, tgt, 'r1' AS name, 'ASIA/*' AS pattern_from, 'EUROPE/*' AS pattern_to FROM w WHERE a GLOB 'ASIA/*' AND b GLOB 'EUROPE/*'
UNION ALL SELECT 'g', src, tgt, 'r2', '*/C1*', 'AMERICA/*/S?' FROM w WHERE a LIKE '%/C1%' AND regexp_full_match(b,'AMERICA/.*/S.')
UNION ALL SELECT 'g', src, tgt, 'r3', 'AFRICA/*', '[!A]*' FROM w WHERE a LIKE 'AFRICA/%' AND b NOT LIKE 'A%')"""
_VIOLATIONS = _VIOLATIONS.replace("a GLOB 'ASIA/*' AND b GLOB 'EUROPE/*'", "a LIKE 'ASIA/%' AND b LIKE 'EUROPE/%'")


@query("violations", f"{_VIOLATIONS} SELECT * FROM v")
def _(spark, d):
    return policy.violations(fx.trade(spark, d).edges, policy.rules_table(spark, RULES))


@query("constraint_score", f"{_VIOLATIONS}, e AS (SELECT count(*) n FROM trade), k AS (SELECT count(*) m FROM v) SELECT 'g' AS graph_id, n AS n_edges, m AS n_violations, round(greatest(0.0,1.0-m/n),6) AS constraint_score FROM e, k")
def _(spark, d):
    edges = fx.trade(spark, d).edges
    return policy.constraint_score(edges, policy.violations(edges, policy.rules_table(spark, RULES)))


def _trade_groups(g: gr.Graph) -> DataFrame:
    """Suppliers and each 40th customer are a group by region, the other customers by nation, so that there are rules of all kinds."""
    part = lambda k: F.element_at(F.split("id", r"\."), k)
    with_suppliers = part(3).startswith("S") | (F.substring(part(3), 2, 20).cast("long") % 40 == 0)
    return g.nodes.select("graph_id", "id", F.when(with_suppliers, F.concat(F.lit("s-"), part(1))).otherwise(F.concat(F.lit("c-"), part(2))).alias("label"))


def _nation_groups(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "supplier").select(F.lit("g").alias("graph_id"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("label"))


_CROSS = f"""WITH {fx.HOPS}, m AS (SELECT 's'||s_suppkey id, 'n'||lpad(CAST(s_nationkey AS VARCHAR),2,'0') label FROM supplier),
j AS (SELECT x.label ls, y.label lt FROM hops JOIN m x ON x.id=src JOIN m y ON y.id=tgt WHERE x.label<>y.label),
k AS (SELECT least(ls,lt) a, greatest(ls,lt) b, count(*) FILTER (WHERE ls<lt) ab, count(*) FILTER (WHERE ls>lt) ba FROM j GROUP BY 1,2),
l AS (SELECT DISTINCT label FROM m), c AS (SELECT x.label a, y.label b, coalesce(ab,0) a_to_b, coalesce(ba,0) b_to_a FROM l x JOIN l y ON x.label<y.label LEFT JOIN k ON k.a=x.label AND k.b=y.label)"""
_SPLIT = "string_split(id,'.')"
_TRADE_CROSS = f"""WITH {fx.TRADE}, m AS (SELECT id, CASE WHEN starts_with({_SPLIT}[3],'S') OR CAST(substr({_SPLIT}[3],2) AS BIGINT)%40=0 THEN 's-'||{_SPLIT}[1] ELSE 'c-'||{_SPLIT}[2] END AS label FROM nodes),
j AS (SELECT x.label ls, y.label lt FROM trade JOIN m x ON x.id=src JOIN m y ON y.id=tgt WHERE x.label<>y.label),
k AS (SELECT least(ls,lt) a, greatest(ls,lt) b, count(*) FILTER (WHERE ls<lt) ab, count(*) FILTER (WHERE ls>lt) ba FROM j GROUP BY 1,2),
l AS (SELECT DISTINCT label FROM m), c AS (SELECT x.label a, y.label b, coalesce(ab,0) a_to_b, coalesce(ba,0) b_to_a FROM l x JOIN l y ON x.label<y.label LEFT JOIN k ON k.a=x.label AND k.b=y.label)"""


@query("cross_edges", f"{_CROSS} SELECT 'g' AS graph_id, a, b, a_to_b, b_to_a FROM c")
def _(spark, d):
    return policy.cross_edges(fx.hops(spark, d), _nation_groups(spark, d))


@query("propose_rules", f"""{_TRADE_CROSS}, t AS (SELECT *, CASE WHEN a_to_b+b_to_a=0 THEN 'isolated' WHEN b_to_a=0 THEN 'a_to_b' WHEN a_to_b=0 THEN 'b_to_a' WHEN greatest(a_to_b,b_to_a)*10>=(a_to_b+b_to_a)*9 THEN CASE WHEN a_to_b>b_to_a THEN 'a_to_b' ELSE 'b_to_a' END ELSE 'bidirectional' END AS direction,
CASE WHEN a_to_b+b_to_a=0 THEN 0.9::DOUBLE WHEN a_to_b=0 OR b_to_a=0 THEN 0.85 WHEN greatest(a_to_b,b_to_a)*10>=(a_to_b+b_to_a)*9 THEN 0.6 ELSE 0.3 END AS confidence FROM c)
SELECT 'g' AS graph_id, a||'/*' AS rule_from, b||'/*' AS rule_to, confidence, direction, a_to_b, b_to_a FROM t WHERE direction IN ('isolated','b_to_a')
UNION ALL SELECT 'g', b||'/*', a||'/*', confidence, direction, a_to_b, b_to_a FROM t WHERE direction IN ('isolated','a_to_b')""")
def _(spark, d):
    g = fx.trade(spark, d)
    return policy.propose_rules(policy.cross_edges(g, _trade_groups(g)))


_RULES = f"""{_TRADE_CROSS}, t AS (SELECT *, CASE WHEN a_to_b+b_to_a=0 THEN 'isolated' WHEN b_to_a=0 THEN 'a_to_b' WHEN a_to_b=0 THEN 'b_to_a' WHEN greatest(a_to_b,b_to_a)*10>=(a_to_b+b_to_a)*9 THEN CASE WHEN a_to_b>b_to_a THEN 'a_to_b' ELSE 'b_to_a' END ELSE 'bidirectional' END AS direction FROM c),
w AS (SELECT a AS f, b AS o, * FROM t WHERE direction IN ('isolated','b_to_a') UNION ALL SELECT b, a, * FROM t WHERE direction IN ('isolated','a_to_b')), sizes AS (SELECT label, count(*) AS size FROM m GROUP BY 1)"""


@query("explain_rules", f"""{_RULES} SELECT 'g' AS graph_id, f||'/*' AS rule_from, o||'/*' AS rule_to, CASE WHEN direction='isolated' THEN 0.9::DOUBLE WHEN least(a_to_b,b_to_a)=0 THEN 0.85 ELSE 0.6 END AS confidence, direction, x.size AS size_from, y.size AS size_to, a_to_b, b_to_a,
CASE WHEN direction='isolated' THEN f||' and '||o||' don''t depend on each other' ELSE o||' depends on '||f||' by '||greatest(a_to_b,b_to_a)||' of '||(a_to_b+b_to_a)||' edges' END AS rationale
FROM w JOIN sizes x ON x.label=f JOIN sizes y ON y.label=o""")
def _(spark, d):
    g = fx.trade(spark, d)
    return engine.discovery(g, membership=_trade_groups(g))[1]


@query("discovery_summary", f"""{_RULES}
SELECT 'g' AS graph_id, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM trade) AS edges, (SELECT count(*) FROM sizes) AS clusters, (SELECT count(*) FROM w) AS rules, (SELECT count(*) FROM w WHERE direction='isolated' OR least(a_to_b,b_to_a)=0) AS sure_rules""")
def _(spark, d):
    g = fx.trade(spark, d)
    return engine.discovery(g, membership=_trade_groups(g))[2].drop("internal_nodes")


@query("label_communities", f"""WITH {fx.TRADE}, q AS (SELECT id, string_split(id,'.')[1] AS r, array_to_string(string_split(id,'.')[1:2],'.') AS p FROM nodes), n AS (SELECT r, count(*) AS size FROM q GROUP BY 1),
t AS (SELECT r, p, count(*) AS k FROM q GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, p)=1)
SELECT 'g' AS graph_id, r AS community, CASE WHEN size>=5 AND k/size>0.4 THEN p ELSE r END AS label, size FROM n JOIN t USING (r)""")
def _(spark, d):
    return policy.label_communities(fx.trade(spark, d).nodes.select("graph_id", "id", names.top(F.col("id")).alias("community")))


@query("discover")
def _(spark, d):
    """Of the trade within a nation, and of each 50th customer also with regions further on in the alphabet."""
    g = fx.trade(spark, d)
    part = lambda c, k: F.element_at(F.split(c, r"\."), k)
    onward = (F.substring(part("src", 3), 2, 20).cast("long") % 50 == 0) & (part("src", 1) < part("tgt", 1))
    return policy.discover(gr.Graph.of_edges(g.edges.where((part("src", 2) == part("tgt", 2)) | onward)))


@query("ratchet", f"""WITH {fx.SCORES} SELECT CAST(name AS VARCHAR) AS graph_id, metric, round(value,6) AS value, round(baseline,6) AS baseline, coalesce(value>=baseline-0.01, true) AS passed FROM (
SELECT name, 'score' AS metric, score AS value, CASE WHEN name%3>0 THEN stability END AS baseline FROM scores UNION ALL SELECT name, 'cohesion', cohesion, CASE WHEN name%3>0 THEN acyclicity END FROM scores)""")
def _(spark, d):
    s = fx.scores(spark, d).withColumn("graph_id", F.col("name").cast("string"))
    return policy.ratchet(s, s.where("name % 3 > 0").select("graph_id", F.col("stability").alias("score"), F.col("acyclicity").alias("cohesion")), ["score", "cohesion"], 0.01)


@query("gate", f"""WITH {fx.SCORES}, k AS (SELECT CAST(name AS VARCHAR) AS graph_id, score>=0.5 AS a, coalesce(score>=CASE WHEN name%2=0 THEN stability END, true) AS b FROM scores)
SELECT graph_id, a AND b AS passed, CAST(CASE WHEN a THEN 0 ELSE 1 END + CASE WHEN b THEN 0 ELSE 1 END AS INT) AS n_failures FROM k""")
def _(spark, d):
    s = fx.scores(spark, d).withColumn("graph_id", F.col("name").cast("string"))
    out = engine.gate(s, 0.5, s.where("name % 2 = 0").select("graph_id", F.col("stability").alias("score")), ["score"])
    return out.select("graph_id", "passed", F.size("failures").alias("n_failures"))


_NODE = "['api','core','db','ui','auth','jobs','util','web'][{0}%8+1]||'.m'||{0}"


def _synthetic_sql(n_nodes: int, n_edges: int) -> str:
    number = lambda salt: f"CAST('0x'||substr(md5('42{salt}'||id),1,8) AS BIGINT)%{n_nodes}"
    return f"""k AS (SELECT id, {number('s')} AS s, {number('t')} AS t FROM range({2 * n_edges}) AS r(id)),
edges AS (SELECT {_NODE.format('s')} AS src, {_NODE.format('t')} AS tgt, min(id) AS id FROM k WHERE s<>t GROUP BY 1, 2 ORDER BY 3 LIMIT {n_edges})"""


def _constraints_sql(n_nodes: int, n_edges: int, n_rules: int) -> str:
    rules = ", ".join(f"('{r['from']}','{r['to']}')" for r in tables.synthetic_rules(n_rules))
    return f"""WITH {_synthetic_sql(n_nodes, n_edges)}, rules AS (SELECT * FROM (VALUES {rules}) AS r(a, b)),
v AS (SELECT count(*) AS m FROM edges JOIN rules ON replace(src,'.','/') GLOB a AND replace(tgt,'.','/') GLOB b), n AS (SELECT count(*) AS n FROM edges)
SELECT 'g' AS graph_id, n AS n_edges, m AS n_violations, round(greatest(0.0,1.0-m/n),6) AS constraint_score FROM n, v"""


def _constraints(n_nodes: int, n_edges: int, n_rules: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges = materialize(tables.synthetic_graph(spark, n_nodes, n_edges))
        found = policy.violations(edges, policy.rules_table(spark, tables.synthetic_rules(n_rules)))
        return policy.constraint_score(edges, found)

    return run


for _case in ((1000, 20_000, 100), (3000, 80_000, 180), (3500, 100_000, 220)):
    query("constraints_" + "_".join(map(str, _case)), _constraints_sql(*_case))(_constraints(*_case))


# --- history ----------------------------------------------------------------------------------------------------------

_GINI = "g AS (SELECT {by}, coalesce(2.0*sum(i*x)/nullif(count(*)*sum(x),0)-(count(*)+1.0)/count(*),0) AS gini FROM (SELECT {by}, {x} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {x}) AS i FROM {t}) GROUP BY {by})"


@query("churn", f"""WITH {fx.TOUCHES}, a AS (SELECT repo, avg(n) m FROM touches GROUP BY 1), s AS (SELECT repo, count(*) AS n_files, avg(n) AS mean_churn, median(n) AS median_churn, max(n) AS max_churn, avg(CASE WHEN n>2*m THEN 1.0 ELSE 0.0 END) AS hotspot_ratio FROM touches JOIN a USING (repo) GROUP BY 1),
v AS (SELECT repo, CASE WHEN count(*)<2 THEN 0.0 ELSE stddev_pop(k)/avg(k) END AS module_cv FROM (SELECT repo, module, sum(n) k FROM touches GROUP BY 1,2) GROUP BY 1), {_GINI.format(by='repo', x='n', t='touches')}
SELECT repo, n_files, round(mean_churn,6) AS mean_churn, round(median_churn,6) AS median_churn, max_churn, round(hotspot_ratio,6) AS hotspot_ratio, round(module_cv,6) AS module_cv, round(gini,6) AS gini FROM s JOIN v USING (repo) JOIN g USING (repo)""")
def _(spark, d):
    return history.churn(fx.touches(spark, d))


@query("hottest_files", f"WITH {fx.TOUCHES} SELECT repo, path, module, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, path)::INT AS place FROM touches QUALIFY place<=5")
def _(spark, d):
    return history.hottest(fx.touches(spark, d)).select("repo", "path", "module", "n", "place")


@query("file_touches", f"WITH {fx.COMMITS} SELECT repo, path, string_split(path,'/')[1] AS module, count(*) AS n FROM commits GROUP BY 1,2,3")
def _(spark, d):
    return history.touches(fx.commits(spark, d))


@query("gini", f"WITH {_GINI.format(by='o_orderpriority', x='o_totalprice', t='orders')} SELECT o_orderpriority, round(gini,6) AS gini FROM g")
def _(spark, d):
    return history.gini(fx.table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


_SIZED = f"WITH {fx.COMMITS}, c AS (SELECT repo, sha, count(*) n, count(DISTINCT string_split(path,'/')[1]) k FROM commits GROUP BY 1,2 HAVING count(*) BETWEEN 2 AND 30)"


@query("cochange_entropy", f"""{_SIZED}, w AS (SELECT repo, path, sum(n-1) w FROM commits JOIN c USING (repo, sha) GROUP BY 1,2), t AS (SELECT repo, sum(w) t FROM w GROUP BY 1),
h AS (SELECT repo, count(*) AS n_files, -sum((w/t)*log2(w/t)) AS e FROM w JOIN t USING (repo) GROUP BY 1), s AS (SELECT repo, count(*) AS n_commits, avg(CASE WHEN k>1 THEN 1.0 ELSE 0.0 END) AS x, avg(n) AS f FROM c GROUP BY 1)
SELECT repo, n_commits, n_files, round(e,6) AS entropy, round(CASE WHEN n_files>1 THEN e/log2(n_files) ELSE 0 END,6) AS entropy_norm, round(x,6) AS cross_package_ratio, round(f,6) AS files_per_commit FROM h JOIN s USING (repo)""")
def _(spark, d):
    return history.cochange(fx.commits(spark, d))


@query("cochange_pairs", f"{_SIZED}, f AS (SELECT repo, sha, path FROM commits SEMI JOIN c USING (repo, sha)) SELECT a.repo, a.path AS a, b.path AS b, count(*) AS n FROM f a JOIN f b ON a.repo=b.repo AND a.sha=b.sha AND a.path<b.path GROUP BY 1,2,3")
def _(spark, d):
    return history.cochange_pairs(fx.commits(spark, d))


URGENT = r"(?i)\b(urgent|high)\b"


@query("bugfix_ratio", "SELECT o_orderstatus AS repo, count(*) AS n_commits, count(*) FILTER (WHERE regexp_matches(o_orderpriority,'(?i)\\b(urgent|high)\\b')) AS n_bugfix, round(avg(CASE WHEN regexp_matches(o_orderpriority,'(?i)\\b(urgent|high)\\b') THEN 1.0 ELSE 0.0 END),6) AS bugfix_ratio FROM orders GROUP BY 1")
def _(spark, d):
    return history.bugfix_ratio(fx.table(spark, d, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderpriority").alias("subject")), URGENT)


@query("blast_radius", f"""WITH {fx.COMMITS}, c AS (SELECT repo, sha, count(DISTINCT path) f, count(DISTINCT string_split(path,'/')[1]) p FROM commits WHERE regexp_matches(subject,'(?i)\\b(urgent|high)\\b') GROUP BY 1,2)
SELECT repo, count(*) AS n_bugfix_commits, round(avg(f),6) AS mean_files, round(median(f),6) AS median_files, round(quantile_cont(f,0.9),6) AS p90_files, max(f) AS max_files, round(100*avg(CASE WHEN p>1 THEN 1.0 ELSE 0.0 END),6) AS cross_package_pct, round(100*avg(CASE WHEN f>5 THEN 1.0 ELSE 0.0 END),6) AS wide_pct FROM c GROUP BY 1""")
def _(spark, d):
    return history.blast_radius(fx.commits(spark, d), pattern=URGENT)


@query("issue_stats", """WITH i AS (SELECT o_orderpriority AS repo, CASE WHEN o_orderstatus='O' THEN 'open' ELSE 'closed' END AS state, o_orderdate AS a, max(l_shipdate) AS b FROM orders LEFT JOIN lineitem ON o_orderkey=l_orderkey WHERE o_orderstatus<>'P' GROUP BY o_orderkey, 1, 2, 3),
d AS (SELECT *, (epoch_us(b)-epoch_us(a))/86400e6 AS x FROM i)
SELECT repo, count(*) AS n_issues, count(*) FILTER (WHERE state='open') AS n_open, count(*) FILTER (WHERE state='closed') AS n_closed, round(count(*)/50.0,6) AS issues_per_kloc, round(median(x) FILTER (WHERE x>=0),6) AS median_days_to_close FROM d GROUP BY 1""")
def _(spark, d):
    shipped = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed_at"))
    o = fx.table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return history.issue_stats(o.select(
        F.col("o_orderpriority").alias("repo"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("closed_at").cast("timestamp").alias("closed_at"), (F.col("o_orderstatus") == "P").alias("is_pull_request"), F.lit(50_000.0).alias("ncloc"),
    ))


# --- statistics -------------------------------------------------------------------------------------------------------

_S = f"WITH {fx.SCORES}"


def _rank(x: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{x}) - 1)/2.0)"


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x},{y})/nullif(stddev_pop({x})*stddev_pop({y}),0)"


@query("average_ranks", f"{_S} SELECT name, language, bugs, round({_rank('bugs', 'language')},6) AS place FROM scores")
def _(spark, d):
    return st.average_ranks(fx.scores(spark, d), ["language"], "bugs", "place").select("name", "language", "bugs", "place")


@query("rank_normalize", f"{_S} SELECT name, round(CASE WHEN count(*) OVER (PARTITION BY language)>=2 THEN ({_rank('bugs', 'language')}-1)/(count(*) OVER (PARTITION BY language)-1) END,6) AS x FROM scores")
def _(spark, d):
    return st.rank_normalize(fx.scores(spark, d), ["language"], "bugs", "x").select("name", "x")


@query("pearson", f"{_S} SELECT language, round(CASE WHEN count(*)>=3 THEN {_corr('score', 'churn')} END,6) AS r, count(*) AS n FROM scores GROUP BY 1")
def _(spark, d):
    return st.pearson(fx.scores(spark, d), ["language"], "score", "churn")


@query("spearman", f"{_S}, k AS (SELECT language, {_rank('score', 'language')} a, {_rank('bugs', 'language')} b FROM scores) SELECT language, round(CASE WHEN count(*)>=3 THEN {_corr('a', 'b')} END,6) AS r, count(*) AS n FROM k GROUP BY 1")
def _(spark, d):
    return st.spearman(fx.scores(spark, d), ["language"], "score", "bugs")


@query("spearman_squares", f"{_S}, k AS (SELECT rank() OVER (ORDER BY score) a, rank() OVER (ORDER BY bugs) b FROM scores) SELECT round(1.0-6.0*sum((a-b)*(a-b))/(count(*)*(count(*)*count(*)-1)),6) AS rho, count(*) AS n FROM k")
def _(spark, d):
    return st.spearman_squares(fx.scores(spark, d), "score", "bugs")


_XS, _YS = ("modularity", "acyclicity", "stability", "cohesion", "score"), ("churn", "bugs", "nodes")


@query("correlation_matrix", f"{_S} " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round({_corr(x, y)},6) AS r, count(*) AS n FROM scores" for x in _XS for y in _YS))
def _(spark, d):
    return st.correlation_matrix(fx.scores(spark, d), _XS, _YS)


@query("correlation_strength", f"{_S}, m AS (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {_corr(x, y)} AS r FROM scores" for x in _XS for y in _YS) + """), b AS (SELECT x, arg_max(y, abs(r)) AS y, arg_max(r, abs(r)) AS r FROM m GROUP BY 1)
SELECT x, y, round(r,6) AS r, CASE WHEN r IS NULL THEN 'n/a' WHEN abs(r)>=0.7 THEN 'very strong' WHEN abs(r)>=0.5 THEN 'strong' WHEN abs(r)>=0.3 THEN 'moderate' WHEN abs(r)>=0.1 THEN 'weak' ELSE 'negligible' END AS strength FROM b""")
def _(spark, d):
    best = st.correlation_matrix(fx.scores(spark, d), _XS, _YS).groupBy("x").agg(F.max_by("y", F.abs("r")).alias("y"), F.max_by("r", F.abs("r")).alias("r"))
    return best.select("x", "y", "r", st.strength(F.col("r")).alias("strength"))


_STEPS = 20_000
_SIMPSON = f"CASE WHEN i IN (0,{_STEPS}) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END"


def _t_tail(r: str, n: str) -> str:
    """Two-sided tail of Student's distribution for a correlation, by Simpson's rule: a scalar subquery over columns of the row."""
    density = f"pow(1+pow(abs({r})*sqrt(({n}-2)/(1-{r}*{r}))*i/{_STEPS},2)/({n}-2),-({n}-1)/2.0)"
    area = f"exp(lgamma(({n}-1)/2.0)-lgamma(({n}-2)/2.0))/sqrt(({n}-2)*pi())*abs({r})*sqrt(({n}-2)/(1-{r}*{r}))/{_STEPS}/3*(SELECT sum({_SIMPSON}*{density}) FROM range({_STEPS + 1}) AS q(i))"
    return f"CASE WHEN {r} IS NULL OR {n}<3 THEN NULL WHEN abs({r})>=1-1e-12 THEN 0.0 ELSE greatest(0.0,1-2*{area}) END"


def _normal_tail(z: str) -> str:
    area = f"abs({z})/sqrt(2*pi())/{_STEPS}/3*(SELECT sum({_SIMPSON}*exp(-pow({z}*i/{_STEPS},2)/2)) FROM range({_STEPS + 1}) AS q(i))"
    return f"greatest(0.0,1-2*{area})"


_MATRIX = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {_corr(x, y)} AS r, count(*) AS n FROM scores" for x in _XS for y in _YS)


@query("correlation_p_values", f"{_S}, m AS ({_MATRIX}) SELECT x, y, round(r,6) AS r, n, round({_t_tail('r', 'n')},6) AS p_value FROM m")
def _(spark, d):
    return st.with_p_value(st.correlation_matrix(fx.scores(spark, d), _XS, _YS))


@query("normal_p_values", f"{_S}, m AS ({_MATRIX}), t AS (SELECT *, r*sqrt((n-2)/(1-r*r)) AS t FROM m) SELECT x, y, round(r,6) AS r, n, round({_normal_tail('t')},6) AS p_normal FROM t")
def _(spark, d):
    return st.with_normal_p(st.correlation_matrix(fx.scores(spark, d), _XS, _YS))


@query("top_correlations", f"""{_S}, m AS ({_MATRIX}) SELECT x, y, round(r,6) AS r, n, CASE WHEN abs(r)>=0.7 THEN 'very strong' WHEN abs(r)>=0.5 THEN 'strong' WHEN abs(r)>=0.3 THEN 'moderate' WHEN abs(r)>=0.1 THEN 'weak' ELSE 'negligible' END AS strength
FROM m WHERE r IS NOT NULL ORDER BY abs(m.r) DESC, x, y LIMIT 12""")
def _(spark, d):
    return st.top_correlations(st.correlation_matrix(fx.scores(spark, d), _XS, _YS))


@query("summary", f"{_S}, v AS (" + " UNION ALL ".join(f"SELECT language, '{x}' AS metric, CAST({x} AS DOUBLE) AS value FROM scores" for x in (*_XS, *_YS)) + """)
SELECT language, metric, count(value) AS n, round(min(value),6) AS least, round(max(value),6) AS most, round(avg(value)+1e-9,6) AS mean, round(stddev_pop(value),6) AS deviation, round(max(value)-min(value),6) AS spread FROM v GROUP BY 1, 2""")
def _(spark, d):
    # The mean of four numbers of six digits may lie halfway between two of them; both sides are moved off that point.
    return st.summary(fx.scores(spark, d), ["language"], [*_XS, *_YS]).withColumn("mean", F.col("mean") + 1e-9)


_STUDY = "s AS (SELECT language AS kind, CAST(name%5 AS DOUBLE) AS dose, score AS x, cohesion AS base FROM scores), a AS (SELECT *, 5 AS need FROM s UNION ALL SELECT 'combined', dose, x, base, 10 FROM s)"


@query("study_verdict", f"""{_S}, {_STUDY}, k AS (SELECT kind, need, {_rank('dose', 'kind')} AS u, {_rank('x', 'kind')} AS v FROM a),
c AS (SELECT kind, need, count(*) AS n, CASE WHEN count(*)>=3 THEN {_corr('u', 'v')} END AS r FROM k GROUP BY 1, 2), p AS (SELECT *, {_t_tail('r', 'n')} AS p FROM c),
e AS (SELECT min(dose) FILTER (WHERE dose>0) AS low, max(dose) AS high FROM s),
f AS (SELECT kind, (avg(base) FILTER (WHERE dose=low)-avg(x) FILTER (WHERE dose=high))/sqrt((pow(coalesce(stddev_samp(base) FILTER (WHERE dose=low),0.01),2)+pow(coalesce(stddev_samp(x) FILTER (WHERE dose=high),0.01),2))/2) AS d FROM s, e GROUP BY 1)
SELECT kind, n, round(r,6) AS r, round(p,6) AS p_value, round(d,6) AS d, CASE WHEN n<need THEN 'SKIP' WHEN r< -0.3 AND p<0.05 THEN 'PASS' ELSE 'FAIL' END AS status FROM p LEFT JOIN f USING (kind)""")
def _(spark, d):
    """As if languages were kinds of mutation and a fifth of the suppliers had each dose."""
    return st.study_verdict(fx.scores(spark, d).withColumn("dose", F.col("name") % 5), "language", "dose", "score", "cohesion")


@query("mann_whitney", f"{_S}, k AS (SELECT language='Python' AS p, {_rank('score')} r FROM scores), s AS (SELECT count(*) FILTER (WHERE p) n1, count(*) FILTER (WHERE NOT p) n2, sum(r) FILTER (WHERE p) r1 FROM k), u AS (SELECT n1, n2, least(r1-n1*(n1+1)/2.0, n1*n2-(r1-n1*(n1+1)/2.0)) u FROM s), z AS (SELECT n1, n2, u, (u-n1*n2/2.0)/sqrt(n1*n2*(n1+n2+1)/12.0) AS z FROM u) SELECT n1, n2, round(u,6) AS u, round(z,6) AS z, round({_normal_tail('z')},6) AS p_value FROM z")
def _(spark, d):
    return st.mann_whitney(fx.scores(spark, d), "language", "Python", "score")


@query("effect_size", f"{_S}, k AS (SELECT avg(score) FILTER (WHERE language='Python') a, avg(score) FILTER (WHERE language<>'Python') b, var_samp(score) FILTER (WHERE language='Python') va, var_samp(score) FILTER (WHERE language<>'Python') vb, count(*) FILTER (WHERE language='Python') n1, count(*) FILTER (WHERE language<>'Python') n2 FROM scores) SELECT round((a-b)/sqrt(((n1-1)*va+(n2-1)*vb)/(n1+n2-2)),6) AS d FROM k")
def _(spark, d):
    return st.effect_size(fx.scores(spark, d), "language", "Python", "score")


@query("mediation", f"{_S}, k AS (SELECT count(*) n, {_corr('stability', 'churn')} a, {_corr('churn', 'bugs')} b, {_corr('stability', 'bugs')} c FROM scores) SELECT n, round(a,6) AS r_a, round(b,6) AS r_b, round(c,6) AS r_c, round(a*b,6) AS indirect, round(a*b/c,6) AS share, round(a*b/sqrt(b*b*(1-a*a)/(n-2)+a*a*(1-b*b)/(n-2)),6) AS sobel_z FROM k")
def _(spark, d):
    return st.mediation(fx.scores(spark, d), "stability", "churn", "bugs")


@query("mediation_verdict", f"""{_S}, k AS (SELECT count(*) AS n, {_corr('stability', 'churn')} AS a, {_corr('churn', 'nodes')} AS b, {_corr('stability', 'nodes')} AS c FROM scores),
z AS (SELECT *, a*b/sqrt(b*b*(1-a*a)/(n-2)+a*a*(1-b*b)/(n-2)) AS z, {_t_tail('a', 'n')} AS p_a, {_t_tail('b', 'n')} AS p_b FROM k)
SELECT n, round(a,6) AS r_a, round(b,6) AS r_b, round(c,6) AS r_c, round(a*b,6) AS indirect, round(a*b/c,6) AS share, round(z,6) AS sobel_z, round(p_a,6) AS p_a, round(p_b,6) AS p_b, round({_normal_tail('z')},6) AS sobel_p,
CASE WHEN p_a<0.05 AND p_b<0.05 AND abs(a*b)>0.1 THEN CASE WHEN abs(c)>=0.3 THEN 'partial_mediation' ELSE 'full_mediation' END WHEN p_a<0.05 AND abs(a)>0.3 THEN 'path_a_significant' ELSE 'no_mediation' END AS verdict FROM z""")
def _(spark, d):
    return st.mediation_verdict(st.mediation(fx.scores(spark, d), "stability", "churn", "nodes"))


@query("composite_ranks", f"{_S}, k AS (SELECT name, (({_rank('churn')}-1)/(count(*) OVER ()-1)+({_rank('bugs')}-1)/(count(*) OVER ()-1))/2 s FROM scores) SELECT name, round(s,6) AS defect_score, round(1-s,6) AS proxy FROM k")
def _(spark, d):
    return st.composite_ranks(fx.scores(spark, d), ["churn", "bugs"]).select("name", "defect_score", "proxy")


@query("distribution", f"{_S} SELECT language, count(score) AS n, min(score) AS least, max(score) AS most, round(avg(score),6) AS mean, round(stddev_pop(score),6) AS deviation, round(max(score)-min(score),6) AS spread FROM scores GROUP BY 1")
def _(spark, d):
    return st.distribution(fx.scores(spark, d), ["language"], "score")


@query("lower_percentile", f"{_S} SELECT language, list_sort(list(bugs))[CAST(floor(0.95*(count(*)-1)) AS INT)+1] AS value FROM scores GROUP BY 1")
def _(spark, d):
    return st.lower_percentile(fx.scores(spark, d), ["language"], "bugs")


@query("percentiles", "SELECT l_returnflag, round(quantile_cont(l_quantity,0.9),6) AS p90, round(median(l_quantity),6) AS mid FROM lineitem GROUP BY 1")
def _(spark, d):
    return fx.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.9).alias("p90"), F.median("l_quantity").alias("mid"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    s = fx.scores(spark, d)
    return s.select("name", F.lit("v1").alias("version"), F.col("stability").alias("x")).union(s.where("name % 4 > 0").select("name", F.lit("v2"), "cohesion"))


@query("version_deltas", f"{_S} SELECT name, stability AS first, CASE WHEN name%4>0 THEN cohesion END AS last, round(CASE WHEN name%4>0 THEN cohesion-stability END,6) AS delta FROM scores")
def _(spark, d):
    return st.version_deltas(_versions(spark, d), "name", "version", "x", "v1", "v2")


@query("compare_runs", f"{_S} SELECT name, CASE WHEN name%4=0 THEN 'MISSING' WHEN abs(stability-cohesion)>0.2 THEN 'DIFF' ELSE 'OK' END AS status FROM scores")
def _(spark, d):
    v = _versions(spark, d)
    return st.compare_runs(v.where("version = 'v1'"), v.where("version = 'v2'"), "name", "x", 0.2)


@query("checks", f"{_S}, k AS (SELECT max(score)-min(score) s, avg(score) m, count(DISTINCT language) l FROM scores) SELECT 'spread' AS id, s>0.05 AS passed FROM k UNION ALL SELECT 'level', m>0.9 FROM k UNION ALL SELECT 'languages', l>=4 FROM k")
def _(spark, d):
    return st.checks(fx.scores(spark, d), {"spread": F.max("score") - F.min("score") > 0.05, "level": F.avg("score") > 0.9, "languages": F.countDistinct("language") >= 4})


@query("lowest_scores", f"{_S} SELECT name, score FROM scores ORDER BY score, name LIMIT 10")
def _(spark, d):
    return fx.scores(spark, d).select("name", "score").orderBy("score", "name").limit(10)


@query("complement", f"{_S}, k AS (SELECT avg(score)-0.5*stddev_pop(score) t FROM scores) SELECT name, score FROM scores, k WHERE score<t AND bugs<=(SELECT median(bugs) FROM scores)")
def _(spark, d):
    s = fx.scores(spark, d)
    limits = s.agg((F.avg("score") - 0.5 * F.stddev_pop("score")).alias("t"), F.median("bugs").alias("b"))
    return s.join(F.broadcast(limits), (F.col("score") < F.col("t")) & (F.col("bugs") <= F.col("b"))).select("name", "score")  # one row


# --- scores -----------------------------------------------------------------------------------------------------------

_Z = "CASE language WHEN 'Python' THEN (score-0.7494)/0.0619 WHEN 'Java' THEN (score-0.6224)/0.0938 WHEN 'Go' THEN (score-0.8166)/0.0627 END"
_FINGERPRINT = "CASE WHEN {a}=1.0 AND {c}>=0.95 AND {s}>0.80 THEN 'CLEAN' WHEN {a}<0.95 AND {c}<0.30 THEN 'TANGLED' WHEN {a}<0.95 THEN 'CYCLIC' WHEN {c}<0.40 THEN 'LOW_COHESION' WHEN {s}<0.30 THEN 'FLAT' WHEN {s}>0.70 AND {c}>=0.50 THEN 'LAYERED' ELSE 'MODERATE' END"
_SEVERITY = "CASE WHEN {x}<=0 THEN 'NONE' WHEN {x}<0.01 THEN 'LOW' WHEN {x}<0.05 THEN 'MEDIUM' WHEN {x}<0.15 THEN 'HIGH' ELSE 'CRITICAL' END"


@query("language_z", f"{_S} SELECT name, language, round({_Z},6) AS z, round(CASE WHEN nodes<10 THEN score ELSE round(least(1.0,greatest(0.0,score*ln(500)/ln(nodes))),4) END,4) AS adjusted FROM scores")
def _(spark, d):
    return fx.scores(spark, d).select("name", "language", scores.language_z(F.col("score"), F.col("language")).alias("z"), F.round(scores.size_adjusted(F.col("score"), F.col("nodes")), 4).alias("adjusted"))


@query("language_percentile", f"""{_S}, z AS (SELECT name, {_Z} AS z FROM scores), t AS (SELECT name, z, 1.0/(1.0+0.3275911*abs(z)/sqrt(2.0)) t FROM z),
h AS (SELECT name, z, 0.5*t*(0.254829592+t*(-0.284496736+t*(1.421413741+t*(-1.453152027+t*1.061405429))))*exp(-z*z/2) h FROM t)
SELECT name, round(CASE WHEN z>=0 THEN 1-h WHEN z<0 THEN h END,5) AS p FROM h""")
def _(spark, d):
    return fx.scores(spark, d).select("name", F.round(scores.normal_cdf(scores.language_z(F.col("score"), F.col("language"))), 5).alias("p"))


@query("fingerprints", f"WITH k AS (SELECT {_FINGERPRINT.format(a='(CASE WHEN l_tax<=0.04 THEN 1.0 ELSE 1.0-l_tax END)', c='(l_quantity/50)', s='(l_discount*10)')} AS f FROM lineitem) SELECT f AS fingerprint, count(*) AS n FROM k GROUP BY 1")
def _(spark, d):
    c = F.col
    f = scores.fingerprint(F.lit(0.5), F.when(c("l_tax") <= 0.04, 1.0).otherwise(1.0 - c("l_tax")), c("l_discount") * 10, c("l_quantity") / 50)
    return fx.table(spark, d, "lineitem").select(f.alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query("cycle_severity", f"{_S} SELECT name, {_SEVERITY.format(x='round(1.0-acyclicity,6)')} AS level, round(1.0-acyclicity,6) AS ratio FROM scores")
def _(spark, d):
    c = scores.cycle_severity(F.col("acyclicity"))
    return fx.scores(spark, d).select("name", c["severity_level"].alias("level"), c["severity_ratio"].alias("ratio"))


@query("churn_risk", f"{_S}, k AS (SELECT name, greatest(0.0,least(1.0,1.0-(0.5*acyclicity+0.3*stability+0.2*modularity))) r FROM scores) SELECT name, round(r,6) AS risk, CASE WHEN r<0.1 THEN 'LOW' WHEN r<0.2 THEN 'MEDIUM' WHEN r<0.3 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM k")
def _(spark, d):
    c = scores.churn_risk(F.col("acyclicity"), F.col("stability"), F.col("modularity"))
    return fx.scores(spark, d).select("name", c["churn_risk_score"].alias("risk"), c["churn_risk_level"].alias("level"))


@query("composite_score", f"{_S} SELECT name, round(modularity*0+acyclicity*0.73/0.95+stability*0.05/0.95+cohesion*0.17/0.95,6) AS score FROM scores")
def _(spark, d):
    return fx.scores(spark, d).select("name", scores.composite([F.col(c) for c in ("modularity", "acyclicity", "stability", "cohesion")], (0, 73, 5, 17)).alias("score"))


_DESCRIBED = "CASE fingerprint " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scores.DESCRIPTIONS.items()) + " END"


@query("enhanced", f"""{_S}, z AS (SELECT *, {_Z} AS z, {_FINGERPRINT.format(a='acyclicity', c='cohesion', s='stability')} AS fingerprint, round(1.0-acyclicity,12) AS share, round(greatest(0.0,least(1.0,1.0-(0.5*acyclicity+0.3*stability+0.2*modularity))),12) AS r FROM scores),
t AS (SELECT *, 1.0/(1.0+0.3275911*abs(z)/sqrt(2.0)) AS t FROM z), h AS (SELECT *, 0.5*t*(0.254829592+t*(-0.284496736+t*(1.421413741+t*(-1.453152027+t*1.061405429))))*exp(-z*z/2) AS h FROM t)
SELECT name, language, round(z,6) AS score_z, round(100*CASE WHEN z>=0 THEN 1-h WHEN z<0 THEN h END,1) AS score_percentile, CASE WHEN nodes<10 THEN score ELSE round(least(1.0,greatest(0.0,score*ln(500)/ln(nodes))),4) END AS score_size_adjusted, fingerprint, {_DESCRIBED} AS fingerprint_description,
{_SEVERITY.format(x='share')} AS severity_level, CASE WHEN share=0 THEN 'no cyclic dependencies' ELSE format('{{:.1f}}% of modules in the largest cycle', (1.0-acyclicity)*100) END AS message, CASE WHEN r<0.1 THEN 'LOW' WHEN r<0.2 THEN 'MEDIUM' WHEN r<0.3 THEN 'HIGH' ELSE 'CRITICAL' END AS churn_risk_level FROM h""")
def _(spark, d):
    return scores.enhance(fx.scores(spark, d)).select("name", "language", "score_z", "score_percentile", "score_size_adjusted", "fingerprint", "fingerprint_description", "cycle_severity.severity_level", "cycle_severity.message", "churn_risk.churn_risk_level")


@query("ratings", f"{_S}, k AS (SELECT name, bugs, nodes, 1.0+4*stability AS r FROM scores) SELECT name, substr('ABCDE', CAST(round_even(r,0) AS INT), 1) AS letter, round(greatest(0.0,least(1.0,1-(r-1)/4)),6) AS quality, round(bugs/(nodes/1000.0),6) AS bugs_per_kloc FROM k")
def _(spark, d):
    r = 1.0 + 4 * F.col("stability")
    return fx.scores(spark, d).select("name", scores.rating_letter(r).alias("letter"), scores.rating_quality(r).alias("quality"), scores.per_kloc(F.col("bugs"), F.col("nodes")).alias("bugs_per_kloc"))


# --- sources ----------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A Python file per supplier that imports the suppliers its orders go on to."""
    g = fx.hops(spark, d)
    imports = g.edges.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("import "), "tgt"))), "\n").alias("text"))
    return g.nodes.join(imports, F.col("id") == F.col("src"), "left").select(F.lit("g").alias("graph_id"), F.concat("id", F.lit(".py")).alias("path"), F.coalesce("text", F.lit("x = 1")).alias("text"))


@query("scan_edges", f"WITH {fx.HOPS} SELECT 'g' AS graph_id, src, tgt FROM hops")
def _(spark, d):
    return engine.scan(_files(spark, d))[0].edges


def _as_language(spark: SparkSession, d: str, ending: str, before: str, imported: str, empty: str) -> DataFrame:
    g = fx.hops(spark, d)
    imports = g.edges.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.format_string(imported, "tgt"))), "\n").alias("text"))
    text = F.concat(F.lit(before), F.coalesce("text", F.lit("")), F.lit(empty))
    return g.nodes.join(imports, F.col("id") == F.col("src"), "left").select(F.lit("g").alias("graph_id"), F.concat("id", F.lit(ending)).alias("path"), text.alias("text"))


@query("scan_java", f"WITH {fx.HOPS} SELECT 'g' AS graph_id, 'app.'||src AS src, 'app.'||tgt AS tgt FROM hops")
def _(spark, d):
    return engine.scan(_as_language(spark, d, ".java", "package app;\n", "import app.%s;", "\nclass X { int a; int get() { return this.a; } }"))[0].edges


@query("scan_go", f"WITH {fx.HOPS} SELECT 'g' AS graph_id, src, tgt FROM hops")
def _(spark, d):
    return engine.scan(_as_language(spark, d, ".go", "package app\nimport (\n", '  "%s"', "\n)\ntype X struct {}\n"))[0].edges


def _classes(spark: SparkSession, d: str, ending: str, head: str, method: str, tail: str) -> DataFrame:
    """A file with one class per supplier; it has six methods that share attributes by their number modulo 1, 2 or 3."""
    k = F.col("s_suppkey")
    methods = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.format_string(method, i, i % (k % 3 + 1))), "\n")
    return fx.table(spark, d, "supplier").select(F.lit("g").alias("graph_id"), F.concat(F.lit("app/s"), k, F.lit(ending)).alias("path"), F.concat(F.lit(head), methods, F.lit(tail)).alias("text"))


_LCOM4_OF_FILES = "SELECT s_suppkey%3+1 AS lcom4, count(*) AS n FROM supplier GROUP BY 1"


@query("scan_lcom4", _LCOM4_OF_FILES)
def _(spark, d):
    files = _classes(spark, d, ".java", "package app;\nclass X {\n int a0; int a1; int a2;\n", " int get%d() { return this.a%d; }", "\n}\n")
    return engine.scan(files)[1].groupBy("lcom4").agg(F.count(F.lit(1)).alias("n"))


@query("scan_lcom4_python", _LCOM4_OF_FILES)
def _(spark, d):
    files = _classes(spark, d, ".py", "class X:\n", "    def get%d(self):\n        return self.a%d", "\n")
    return engine.scan(files)[1].groupBy("lcom4").agg(F.count(F.lit(1)).alias("n"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """A source file per part, in folders and of kinds by its numbers; the brand is the project."""
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/main/java/a", "src/pkg", ".git", "a/target", "a/node_modules/b", "src/test/c", "deep/er/and/er", "docs", "tests", "__pycache__")]), (k % 10 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("__init__.py", "m.py", "Test.java", "x.go", "README.md", "test_m.py", "M.PY")]), (k % 7 + 1).cast("int"))
    return fx.table(spark, d, "part").select(F.col("p_brand").alias("graph_id"), F.concat_ws("/", folder, name).alias("path"), F.col("p_name").alias("text"))


_PATHS = """paths AS (SELECT p_brand AS graph_id, ['src/main/java/a','src/pkg','.git','a/target','a/node_modules/b','src/test/c','deep/er/and/er','docs','tests','__pycache__'][p_partkey%10+1]||'/'||['__init__.py','m.py','Test.java','x.go','README.md','test_m.py','M.PY'][p_partkey%7+1] AS path, p_name AS text FROM part),
e AS (SELECT *, lower(regexp_extract(path,'\\.([A-Za-z0-9]+)$',1)) AS ending FROM paths)"""


@query("kept_sources", f"WITH {_PATHS} SELECT graph_id, path, count(*) AS n FROM e WHERE NOT regexp_matches(path,'(^|/)(\\.[^/]*|target|node_modules|__pycache__)/') AND path NOT LIKE '%/__init__.py' AND NOT (ending='java' AND regexp_matches(path,'(^|/)(src/)?test/')) GROUP BY 1, 2")
def _(spark, d):
    return code.keep_sources(_paths(spark, d)).groupBy("graph_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query("within_depth", f"WITH {_PATHS} SELECT path, count(*) AS n FROM paths WHERE length(path)-length(replace(path,'/',''))<=2 GROUP BY 1")
def _(spark, d):
    return code.within_depth(_paths(spark, d), 3).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("languages_of_projects", f"""WITH {_PATHS}, n AS (SELECT graph_id, count(*) FILTER (WHERE ending='py') p, count(*) FILTER (WHERE ending='java') j, count(*) FILTER (WHERE ending='go') g FROM e WHERE graph_id LIKE '%1' OR ending<>'go' GROUP BY 1)
SELECT graph_id, CASE WHEN g>0 AND g*4>=p AND g>=j THEN 'Go' WHEN j>0 AND j*4>=p THEN 'Java' WHEN p>0 THEN 'Python' END AS language, CASE WHEN greatest(p,j,g)=0 THEN 'Python' WHEN p>=greatest(j,g) THEN 'Python' WHEN j>=g THEN 'Java' ELSE 'Go' END AS common FROM n""")
def _(spark, d):
    files = _paths(spark, d).where((code.extension(F.col("path")) != "go") | F.col("graph_id").endswith("1"))
    return code.detect_language(files).join(code.common_language(files).withColumnRenamed("language", "common"), "graph_id")


@query("source_roots", f"""WITH {_PATHS}, k AS (SELECT graph_id, path FROM paths WHERE (graph_id LIKE '%1' OR path NOT LIKE 'src/main/%') AND (graph_id NOT LIKE '%2' OR path NOT LIKE 'src/%')),
r AS (SELECT graph_id, bool_or(path LIKE 'src/main/java/%') m, bool_or(path LIKE 'src/%') s, list(DISTINCT regexp_extract(path,'^src/([^/]+)/__init__\\.py$',1)) FILTER (WHERE regexp_matches(path,'^src/[^/]+/__init__\\.py$')) ps, min(regexp_extract(path,'^([^/]+)/__init__\\.py$',1)) FILTER (WHERE regexp_matches(path,'^[^/]+/__init__\\.py$') AND NOT regexp_matches(path,'^tests?/')) t FROM k GROUP BY 1)
SELECT graph_id, CASE WHEN m THEN 'src/main/java' WHEN len(ps)=1 THEN 'src/'||ps[1] WHEN s THEN 'src' ELSE coalesce(t,'') END AS root FROM r""")
def _(spark, d):
    files = _paths(spark, d).where((F.col("graph_id").endswith("1") | ~F.col("path").startswith("src/main/")) & (~F.col("graph_id").endswith("2") | ~F.col("path").startswith("src/")))
    return code.source_root(files)


@query("source_paths", f"""WITH {_PATHS} SELECT path, count(*) AS n, regexp_matches(path,'(?i)(^|/)(tests?|testing|conftest\\.py)(/|$)|(^|/)test_[^/]*$|_test\\.[a-z]+$') AS is_test,
NOT (path LIKE '%README.md' OR ending IN ('md','rst','txt','lock') OR path LIKE 'docs/%') AS is_source FROM e GROUP BY 1, ending""")
def _(spark, d):
    p = F.col("path")
    return _paths(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", "n", p.rlike(history.TEST_PATHS).alias("is_test"), history.is_source(p).alias("is_source"))


_SUBJECT = "['Fix a crash','prefix only','hotfix: x','Add patch','debug','a BUG','tissue','Closes issue 3'][p_partkey%8+1]"


@query("bugfix_subjects", f"SELECT p_brand AS repo, count(*) AS n_commits, count(*) FILTER (WHERE p_partkey%8 IN (0,2,3,5,7)) AS n_bugfix, round(avg(CASE WHEN p_partkey%8 IN (0,2,3,5,7) THEN 1.0 ELSE 0.0 END),6) AS bugfix_ratio FROM part GROUP BY 1")
def _(spark, d):
    subject = F.element_at(F.array(*[F.lit(x) for x in ("Fix a crash", "prefix only", "hotfix: x", "Add patch", "debug", "a BUG", "tissue", "Closes issue 3")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return history.bugfix_ratio(fx.table(spark, d, "part").select(F.col("p_brand").alias("repo"), subject.alias("subject")))


@query("finite_numbers", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity::DOUBLE WHEN 4 THEN 1.5::DOUBLE END AS x FROM lineitem")
def _(spark, d):
    n = F.col("l_linenumber")
    text = F.when(n == 1, F.col("l_quantity").cast("double").cast("string")).when(n == 2, "NaN").when(n == 3, "Infinity").when(n == 4, "1.5").when(n == 5, "-Infinity").when(n == 6, "none")
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.finite(text).alias("x"))


def _written(df: DataFrame, column: str) -> str:
    """The documents of a column as files, one a partition."""
    path = shared_dir(df.sparkSession)
    df.select(column).coalesce(1).write.text(path)
    return path


@query("repositories", "SELECT 's'||s_suppkey AS name, 'https://example.com/'||s_nationkey||'/s'||s_suppkey AS url FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = fx.table(spark, d, "supplier").select(F.struct(F.concat(F.lit("s"), k).alias("name"), F.concat_ws("/", F.lit("https://example.com"), F.col("s_nationkey").cast("string"), F.concat(F.lit("s"), k)).alias("url")).alias("r"))
    return tables.read_repositories(spark, _written(rows.agg(F.to_json(F.collect_list("r")).alias("json")), "json")).select("name", "url")


@query("benchmark_results", f"{_S} SELECT CAST(name AS VARCHAR) AS name, round(modularity,6) AS modularity, CASE WHEN name%5>0 THEN round(score,6) END AS agq_score, nodes, language, CASE WHEN name%7>0 THEN round(stability,6) END AS hotspot_ratio FROM scores")
def _(spark, d):
    c = F.col
    agq = F.struct("modularity", F.when(c("name") % 5 > 0, c("score")).alias("agq_score"), "nodes", "language")
    rows = fx.scores(spark, d).select(F.struct(c("name").cast("string").alias("name"), agq.alias("agq"), F.struct(F.when(c("name") % 7 > 0, c("stability")).alias("hotspot_ratio")).alias("churn")).alias("r"))
    found = tables.read_results(spark, _written(rows.agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("json")), "json"))
    return found.select("name", "modularity", "agq_score", "nodes", "language", "hotspot_ratio")


@query("graph_json_read", f"WITH {fx.TRADE} SELECT src, tgt FROM trade")
def _(spark, d):
    return tables.read_graph_json(spark, tables.write_graph_json(fx.trade(spark, d), shared_dir(spark)))[0].edges.select("src", "tgt")


@query("test_quality", """WITH k AS (SELECT s_suppkey k FROM supplier), m AS (SELECT least(avg(k%4)/3.0,1.0) a, least(sum(2+k%4)/sum(1),1.0) r, avg(CASE WHEN k%2=0 THEN 1.0 ELSE 0.0 END) d, avg(CASE WHEN k%5=0 THEN 1.0 ELSE 0.0 END) i, count(*) n FROM k)
SELECT 'g' AS graph_id, round(a,6) AS assertion_density, round(r,6) AS test_to_code_ratio, round(d,6) AS naming_quality, round(i,6) AS isolation_score, 1.0::DOUBLE AS coverage_potential, n AS n_test_files, n AS n_test_functions, round((a+r+d+i+1)/5,6) AS test_score FROM m""")
def _(spark, d):
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 2 == 0, "def test_should_y(").otherwise("def test_x_y("), F.when(k % 5 == 0, "mocker").otherwise(""), F.lit("):\n"), F.repeat(F.lit("    assert 1\n"), (k % 4).cast("int")), F.lit("    pass"))
    rows = fx.table(spark, d, "supplier")
    tests = rows.select(F.lit("g").alias("graph_id"), F.concat(F.lit("tests/test_s"), k, F.lit(".py")).alias("path"), text.alias("text"))
    return test_suite.test_quality(tests.union(rows.select(F.lit("g"), F.concat(F.lit("app/s"), k, F.lit(".py")), F.lit("x = 1"))))


@query("detect_language", f"WITH {fx.HOPS} SELECT 'g' AS graph_id, CASE WHEN count(*)>0 THEN 'Python' END AS language FROM nodes")
def _(spark, d):
    return code.detect_language(_files(spark, d))


@query("file_index", f"WITH {fx.TRADE}, a AS (SELECT id, unnest([array_to_string(string_split(id,'.')[k:],'.') FOR k IN [1,2,3]]) AS alias FROM nodes) SELECT 'g' AS graph_id, alias, min(id) AS path FROM a GROUP BY 2")
def _(spark, d):
    return code.file_index(fx.trade(spark, d).nodes.select("graph_id", F.col("id").alias("module"), F.col("id").alias("path")))


@query("lines_of_code", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')))::INT AS n FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return fx.table(spark, d, "documents").where("text is not null").select("doc_id", code.lines_of_code(F.col("text")).alias("n"))


@query("page_links", "SELECT DISTINCT regexp_extract(url,'://([^/?#]*)',1) AS src, unnest(regexp_extract_all(html,'href=\"([^\"]+)\"',1)) AS tgt FROM pages")
def _(spark, d):
    return tables.links(fx.table(spark, d, "pages"), F.col("url"), F.col("html"))


@query("slugs", "SELECT p_partkey, regexp_replace(p_name||' '||p_brand,'[^a-zA-Z0-9_.-]','_','g')[1:200] AS slug, 'import '||replace(p_brand,'#','.')||';' AS line FROM part")
def _(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", names.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), names.import_line(F.lit("Java"), F.translate("p_brand", "#", ".")).alias("line"))


@query("synthetic_graph", f"WITH {_synthetic_sql(1000, 20_000)} SELECT 'g' AS graph_id, src, tgt FROM edges")
def _(spark, d):
    return tables.synthetic_graph(spark, 1000, 20_000)


@query("graph_json", f"""WITH {fx.HOPS} SELECT 'g' AS graph_id, '{{"nodes":['||(SELECT string_agg('{{"id":"'||id||'","internal":false}}', ',' ORDER BY id) FROM nodes)||'],"edges":['||(SELECT string_agg('["'||src||'","'||tgt||'"]', ',' ORDER BY src, tgt) FROM hops)||']}}' AS json""")
def _(spark, d):
    return tables.graph_json(fx.hops(spark, d))


# --- mutations --------------------------------------------------------------------------------------------------------


def _mutation(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = fx.hops(spark, d) if kind == "cycles" else fx.trade(spark, d)
        if kind == "cohesion":
            return mutate.move_modules(g, 0.1, 1)
        return {"cycles": mutate.inject_cycles, "layers": mutate.inject_layer_violations, "hubs": mutate.create_hubs}[kind](g, 0.5, 1)

    return run


_TOP = "array_to_string(string_split({0},'.')[1:2],'.')"
_MUTATED = {
    "cycles": f"""WITH {fx.HOPS}, w AS (SELECT src, tgt FROM hops a WHERE NOT EXISTS (SELECT 1 FROM hops b WHERE b.src=a.tgt AND b.tgt=a.src))
SELECT 'g' AS graph_id, tgt AS src, src AS tgt FROM w QUALIFY row_number() OVER (ORDER BY md5('1:'||src||':'||tgt), src, tgt)<=greatest(1, floor(count(*) OVER ()*0.5))""",
    "layers": f"""WITH {fx.TRADE}, {_PACKAGES}, k AS (SELECT package, instability, row_number() OVER (ORDER BY instability, package) AS k, count(*) OVER () AS n FROM i), f AS (SELECT pkg AS package, min(id) AS id FROM p GROUP BY 1),
q AS (SELECT a.id AS src, b.id AS tgt FROM k x JOIN f a USING (package), k y JOIN f b USING (package) WHERE x.k<=greatest(1,floor(x.n/3)) AND x.instability<0.4 AND y.k>y.n-greatest(1,floor(y.n/3)) AND y.instability>0.6 AND a.id<>b.id AND NOT EXISTS (SELECT 1 FROM trade t WHERE t.src=a.id AND t.tgt=b.id))
SELECT 'g' AS graph_id, src, tgt FROM q QUALIFY row_number() OVER (ORDER BY md5('1:'||src||':'||tgt), src, tgt)<=greatest(1, floor(count(*) OVER ()*0.5))""",
    "hubs": f"""WITH {fx.TRADE}, h AS (SELECT id AS src FROM nodes QUALIFY row_number() OVER (ORDER BY md5('1:'||id), id)<=greatest(1, floor(count(*) OVER ()*0.5*0.05))), t AS (SELECT id AS tgt FROM nodes QUALIFY row_number() OVER (ORDER BY md5('2:'||id), id)<=40),
f AS (SELECT src, tgt FROM h, t WHERE {_TOP.format('src')}<>{_TOP.format('tgt')} QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5('1:'||tgt), tgt)<=greatest(3, floor(least(20, count(*) OVER (PARTITION BY src))*0.5)))
SELECT 'g' AS graph_id, src, tgt FROM f WHERE NOT EXISTS (SELECT 1 FROM trade e WHERE e.src=f.src AND e.tgt=f.tgt)""",
    "cohesion": f"""WITH {fx.TRADE}, c AS (SELECT id FROM nodes QUALIFY row_number() OVER (ORDER BY md5('1:'||id), id)<=greatest(1, floor(count(*) OVER ()*0.1))), o AS (SELECT DISTINCT {_TOP.format('id')} AS host FROM nodes), s AS (SELECT host, row_number() OVER (ORDER BY host)-1 AS slot, count(*) OVER () AS n FROM o)
SELECT 'g' AS graph_id, id, host||'.'||string_split(id,'.')[-1] AS moved FROM c JOIN s ON slot=CAST('0x'||substr(md5('1:'||id),1,8) AS BIGINT)%n WHERE {_TOP.format('id')}<>host""",
}
for _kind in mutate.TYPES:
    query(f"mutate_{_kind}", _MUTATED[_kind])(_mutation(_kind))


@query("mutation_study")
def _(spark, d):
    """How acyclicity reacts to doses of injected cycles and hubs."""
    g = mutate.study(fx.hops(spark, d), ("cycles", "hubs"), (0.1, 0.5, 1.0), (1, 2))
    part = lambda k: F.element_at(F.split("graph_id", "/"), k)
    acyclicity = materialize(tr.acyclicity(g))  # a row for each graph; the ranks read it several times
    return st.dose_response(acyclicity.select(part(2).alias("mutation"), part(3).cast("double").alias("dose"), "acyclicity"), ["mutation"], "dose", "acyclicity")

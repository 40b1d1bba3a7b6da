"""Queries of graphs and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import graph as gr
from strandloom.operators import pattern
from strandloom.operators.graph import Graph
from strandloom.plans import views as v
from strandloom.plans.base import query

C = F.col


def _ring(s: SparkSession, d: str) -> Graph:
    return Graph.of(v.g_ring(s, d), "edge")


def _parts(s: SparkSession, d: str) -> Graph:
    """Suppliers and, with another range of numbers, the parts that they supply."""
    return Graph.of(v.g_sp(s, d).withColumn("dst", C("dst") + 1_000_000), "edge")


def _exons(s: SparkSession, d: str) -> DataFrame:
    at = C("o_orderkey") % 40 * 10
    return v.t(s, d, "orders").select((C("o_custkey") % 200).alias("cluster"), C("o_orderkey").alias("exon"), at.alias("start"), (at + 5).alias("stop"))


@query("SELECT DISTINCT src AS id FROM g_sp")
def gr_sources(s, d):
    return _parts(s, d).sources()


@query("SELECT src, dst, edge FROM g_ring WHERE src % 7 = 2")
def gr_neighbours(s, d):
    g = _ring(s, d)
    return g.neighbours(g.nodes.where("id % 7 = 2"))


@query("SELECT src, dst + 1000000 AS dst, edge FROM g_sp")
def gr_ordered_edges(s, d):
    return _parts(s, d).ordered_edges()


@query("SELECT edge, src, dst + 1000000 AS dst FROM g_sp WHERE edge IN (2, 4)")
def gr_edge_ends(s, d):
    return _parts(s, d).ends(s.createDataFrame([(2,), (4,), (99,)], "edge long"))


@query("SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(edge) AS edge FROM g_ring GROUP BY ALL")
def gr_undirected(s, d):
    return _ring(s, d).undirected()


@query("SELECT src, dst, edge FROM g_ring WHERE src % 50 IN (3, 4)")
def gr_cluster(s, d):
    g = _ring(s, d)
    return g.cluster(g.nodes.select("id", (C("id") % 50).alias("cluster")), g.nodes.where("id in (3, 4, 103)")).edges


@query("SELECT s_suppkey, s_name, dst + 1000000 AS part, edge AS part_edge FROM supplier LEFT JOIN g_sp ON src = s_suppkey")
def gr_attribute(s, d):
    """What a graph gives for a row, as an attribute of it."""
    return _parts(s, d).attribute(v.t(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "part")


@query("WITH numbers AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey DESC) AS number FROM customer) SELECT a.number AS src, b.number AS dst, edge FROM g_ring JOIN numbers a ON a.id = src JOIN numbers b ON b.id = dst")
def gr_packed(s, d):
    count = v.t(s, d, "customer").agg(F.max("c_custkey")).scalar()  # keys are dense, so a number needs no sort
    numbers = v.t(s, d, "customer").select(C("c_custkey").alias("id"), (count - C("c_custkey") + 1).alias("number"))
    return gr.packed(_ring(s, d), numbers).edges


@query("SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, a.edge AS e0, b.edge AS e1 FROM g_ring a JOIN g_ring b ON a.dst = b.src WHERE a.src <> a.dst AND b.dst <> a.src AND b.dst <> a.dst")
def gr_paths(s, d):
    g = _ring(s, d)
    p = gr.paths(g, g.sources(), 2)
    return p.select(*[F.get("nodes", F.lit(i)).alias(f"n{i}") for i in range(3)], *[F.get("edges", F.lit(i)).alias(f"e{i}") for i in range(2)])


@query("SELECT DISTINCT l_suppkey, l_suppkey % 7 AS kind FROM lineitem")
def gr_unique_keys(s, d):
    return gr.unique_keys(v.t(s, d, "lineitem").select("l_suppkey", (C("l_suppkey") % 7).alias("kind")), ["l_suppkey"], "kind")


@query("SELECT src, dst, edge FROM g_ring WHERE src % 3 > 0 AND dst % 3 > 0")
def gr_missing_nodes(s, d):
    """Edges of nodes that the graph has; with all nodes added, the strict form has nothing to object to."""
    g = _ring(s, d)
    return Graph(g.nodes.where("id % 3 > 0"), g.edges).checked("drop").checked().edges


@query("SELECT src, dst, edge + 1 AS edge FROM g_ring WHERE src % 4 = 0 UNION ALL SELECT src, dst, edge FROM g_ring WHERE src % 4 > 0 UNION ALL SELECT DISTINCT -src, src, 3::BIGINT FROM g_ring")
def gr_add_edges(s, d):
    """Edges added twice over: the last of those with the same ends stays."""
    g = _ring(s, d)
    more = g.edges.where("src % 4 = 0").select("src", "dst", F.explode(F.array(C("edge") - 5, C("edge") + 1)).alias("edge"))
    ends = g.sources().select((-C("id")).alias("src"), C("id").alias("dst"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("edge"))
    return g.with_edges(more).with_edges(ends, "edge").edges


@query("SELECT a.exon AS src, b.exon AS dst FROM exons a JOIN exons b ON a.cluster = b.cluster AND a.stop = b.stop AND a.exon <> b.exon")
def gr_splice_alt3(s, d):
    e = _exons(s, d)
    return gr.splice_graph(e, e.select("cluster", C("exon").alias("splice"), "start", "stop"))[2]


@query("WITH link AS (SELECT DISTINCT a.exon AS src, b.exon AS dst FROM exons a JOIN exons b ON a.cluster = b.cluster AND b.start - a.start IN (40, 80)) SELECT x.src AS n_0, x.dst AS n_1, y.dst AS n_2 FROM link x JOIN link y ON x.dst = y.src JOIN link z ON z.src = x.src AND z.dst = y.dst WHERE x.src <> x.dst AND y.dst <> x.src AND y.dst <> x.dst")
def gq_exon_skip(s, d):
    """An exon that a splice leaves out: a to b, b to c, and a to c.  Exons of the same places have the same links."""
    places = _exons(s, d).groupBy(C("exon").alias("id")).agg(F.sort_array(F.collect_set(F.struct("cluster", "start"))).alias("twin"))
    each = places.select("twin").distinct().select("twin", F.explode("twin").alias("at")).select("twin", "at.*")
    a = each.select("cluster", C("twin").alias("src"), F.explode(F.array(C("start") + 40, C("start") + 80)).alias("start"))
    links = a.join(each.withColumnRenamed("twin", "dst"), ["cluster", "start"]).select("src", "dst")
    return pattern.match_twins(places, links, {0: {1: None, 2: None}, 1: {2: None}, 2: {}})


@query("SELECT a.src AS n_0, b.src AS n_1, a.dst + 1000000 AS n_2, a.edge AS e_0_2, b.edge AS e_1_2 FROM g_sp a JOIN g_sp b ON a.dst = b.dst AND a.src <> b.src")
def gq_two_starts(s, d):
    """Two suppliers of one part: the second start is found backwards, through the part."""
    return pattern.match(_parts(s, d), {0: {2: None}, 1: {2: None}, 2: {}})


@query("SELECT a.src AS n_0, a.dst AS n_1, b.edge AS n_2, a.edge AS e_0_1, b.dst AS e_1_2 FROM g_ring a JOIN g_ring b ON b.src = a.dst WHERE a.src <> a.dst AND b.edge NOT IN (a.src, a.dst)")
def gq_attr(s, d):
    """The entries of a map that the node's row has: keys are nodes, values edges."""
    g = _ring(s, d)
    table = g.edges.groupBy(C("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("edge", "dst"))).alias("by_edge"))
    return pattern.match(g, {0: {1: None}, 1: {2: {"attr": (table, "by_edge")}}, 2: {}})


@query("SELECT src AS n_0, dst AS n_1 FROM g_ring WHERE src <> dst")
def gq_attr_list(s, d):
    """The elements of an array that the node's row has; such edges have nothing to tell."""
    g = _ring(s, d)
    table = g.edges.groupBy(C("src").alias("id")).agg(F.collect_list("dst").alias("out"))
    return pattern.match(g, {0: {1: {"attr": (table, "out")}}, 1: {}}, edges=False)


@F.udtf(returnType="dst: bigint, edge: bigint")
class Steps:
    """The two numbers after a node, with how far they are."""

    def eval(self, node: int):
        yield node + 1, 1
        yield node + 2, 2


@query("SELECT src AS n_0, src + k AS n_1, k::BIGINT AS e_0_1 FROM (SELECT DISTINCT src FROM g_ring), (VALUES (1), (2)) v(k)")
def gq_function(s, d):
    """Neighbours that a table function yields."""
    return pattern.match(_ring(s, d), {0: {1: {"function": Steps}}, 1: {}})


@query("SELECT src AS n_0, src * 2 AS n_1 FROM (SELECT DISTINCT src FROM g_ring) WHERE src <> 0 AND src * 2 % 3 = 1")
def gq_custom_step(s, d):
    """A step of one's own, with a filter behind it."""
    step = lambda rows, src: rows.withColumns({"_dst": C(src) * 2, "_edge": F.lit(None).cast("string")})
    return pattern.match(_ring(s, d), {0: {1: {"expand": step, "filter": lambda to, at, edge, bound: to % 3 == 1}}, 1: {}}, edges=False)


@query("SELECT least(count(*), 500)::BIGINT AS n FROM g_ring a JOIN g_ring b ON a.dst = b.src WHERE a.src <> a.dst AND b.dst <> a.src AND b.dst <> a.dst")
def gq_most(s, d):
    """So many matches and no more: which ones is open, how many is not."""
    return pattern.match(_ring(s, d), {0: {1: None}, 1: {2: None}, 2: {}}, most=500).agg(F.count("*").alias("n"))

"""Directed graphs with at most one edge from a node to another, as tables of nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import products


@dataclass(frozen=True)
class Graph:
    """``nodes(id)`` and ``edges(src, dst, edge)``.  Nothing is changed in place: each method returns a new graph."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, edge: str | None = None) -> Graph:
        """Ends of edges become nodes; without an edge column the edge is null."""
        edges = edges.select("src", "dst", (F.col(edge) if edge else F.lit(None).cast("string")).alias("edge"))
        return Graph(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges)

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(self.nodes.union(nodes.select("id")).distinct(), self.edges)

    def with_edges(self, edges: DataFrame, order: str | None = None) -> Graph:
        """Edges of the same ends are replaced; the ends become nodes.

        Of incoming edges with the same ends one stays: the last by ``order``, a column of
        theirs, or else the one with the largest edge.
        """
        edges = edges.groupBy("src", "dst").agg((F.max_by("edge", order) if order else F.max("edge")).alias("edge"))
        kept = self.edges.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        return Graph(self.nodes.union(ends).distinct(), kept.unionByName(edges.select("src", "dst", "edge")))

    def without_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))

    def without_nodes(self, nodes: DataFrame, incoming: bool = False) -> Graph:
        """Without these nodes and the edges from them; edges to them stay unless ``incoming``."""
        gone = nodes.select("id")
        edges = self.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti")
        if incoming:
            edges = edges.join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), edges.select("src", "dst", "edge"))

    def inverse(self) -> Graph:
        return Graph(self.nodes, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge"))

    def merged(self, other: Graph) -> Graph:
        """Nodes and edges of both; where both have an edge, the other's."""
        return self.with_nodes(other.nodes).with_edges(other.edges)

    def difference(self, other: Graph) -> DataFrame:
        """(what, a, b): nodes and edges that only one of the two has; none if they are equal."""
        out = None
        for one, two in ((self, other), (other, self)):
            nodes = one.nodes.exceptAll(two.nodes).select(F.lit("node").alias("what"), F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
            edges = one.edges.exceptAll(two.edges).select(F.lit("edge"), F.col("src").cast("string"), F.col("dst").cast("string"))
            out = nodes.union(edges) if out is None else out.union(nodes).union(edges)
        return out

    def sources(self) -> DataFrame:
        """Nodes that edges go out from: what iteration over a graph's keys gives."""
        return self.edges.select(F.col("src").alias("id")).distinct()

    def neighbours(self, ids: DataFrame) -> DataFrame:
        """(src, dst, edge) of the nodes ``ids(id)``; edges that lead nowhere (a null target) are left out."""
        return self.edges.where(F.col("dst").isNotNull()).join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")

    def edge(self, src: object, dst: object) -> object:
        """The edge between two nodes; ``KeyError`` unless there is exactly one."""
        found = self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).select("edge").limit(2).collect()
        if len(found) != 1:
            raise KeyError((src, dst))
        return found[0].edge

    def ordered_edges(self) -> DataFrame:
        """All edges by source and target; those with a null target are left out."""
        return self.edges.where(F.col("dst").isNotNull()).orderBy("src", "dst")

    def ends(self, edges: DataFrame) -> DataFrame:
        """(edge, src, dst) of ``edges(edge)``: from edges back to what they join."""
        return self.edges.join(edges.select("edge").distinct(), "edge", "left_semi").select("edge", "src", "dst")

    def checked(self, missing: str = "error") -> Graph:
        """A graph whose edges only join its nodes: others are an error as the query runs, or left out (``drop``), or made nodes (``add``)."""
        if missing == "add":
            ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).where("id is not null")
            return Graph(self.nodes.union(ends).distinct(), self.edges)
        edges = self.edges
        for end in ("src", "dst"):
            known = self.nodes.select(F.col("id").alias(end), F.lit(True).alias("_known"))
            edges = edges.join(known, end, "left" if missing == "error" else "inner")
            if missing == "error":
                sure = F.when(F.col("_known") | F.col(end).isNull(), F.col(end)).otherwise(F.raise_error(F.concat(F.lit("no such node: "), F.col(end).cast("string"))))
                edges = edges.withColumn(end, sure)
            edges = edges.drop("_known")
        return Graph(self.nodes, edges.select("src", "dst", "edge"))

    def undirected(self) -> DataFrame:
        """(a, b, edge): edges by their two ends, the smaller first, one for each pair: that with the largest edge."""
        ends = F.array_sort(F.array("src", "dst"))
        return self.edges.select(ends.alias("ends"), "edge").groupBy("ends").agg(F.max("edge").alias("edge")).select(F.get("ends", F.lit(0)).alias("a"), F.get("ends", F.lit(1)).alias("b"), "edge")

    def cluster(self, clusters: DataFrame, ids: DataFrame) -> Graph:
        """The part of the graph in the clusters of some nodes: ``clusters(id, cluster)``, ``ids(id)``."""
        wanted = clusters.join(ids.select("id").distinct(), "id", "left_semi").select("cluster").distinct()
        nodes = clusters.join(wanted, "cluster", "left_semi").select("id").distinct()
        return Graph(self.nodes.join(nodes, "id", "left_semi"), self.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "edge"))

    def attribute(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with what this graph gives for their ``key`` as an attribute: ``name`` and ``name_edge``; a row for each, one with nulls where there is none."""
        own = self.edges.select(F.col("src").alias(key), F.col("dst").alias(name), F.col("edge").alias(f"{name}_edge"))
        return rows.join(own, key, "left")


def packed(graph: Graph, dictionary: DataFrame) -> Graph:
    """Nodes and edges by the numbers of ``dictionary(id, number)``; ends that it has not are left out."""
    number = lambda end: dictionary.select(F.col("id").alias(end), F.col("number").alias(f"_{end}"))
    edges = graph.edges.join(number("src"), "src").join(number("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "edge")
    return Graph(graph.nodes.join(number("id"), "id").select(F.col("_id").alias("id")), edges)


def paths(graph: Graph, starts: DataFrame, steps: int) -> DataFrame:
    """(nodes, edges): every walk of so many steps from ``starts(id)`` that visits no node twice, as arrays."""
    kind = graph.edges.schema["edge"].dataType.simpleString()
    rows = starts.select(F.array("id").alias("nodes"), F.array().cast(f"array<{kind}>").alias("edges"))
    step = graph.edges.where(F.col("dst").isNotNull())
    for _ in range(steps):
        rows = rows.withColumn("src", F.element_at("nodes", -1)).join(step, "src").where(~F.array_contains("nodes", F.col("dst")))
        rows = rows.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))
    return rows


def unique_keys(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows(keys, value)``, one for each key; a key with two different values is an error as the query runs."""
    out = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    sure = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(F.raise_error(F.lit("a key has two values")))
    return out.select(*keys, sure.alias(value))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``order``; rows are combined before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def splice_graph(exons: DataFrame, splices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next, alt5, alt3) of ``exons(cluster, exon, start, stop)`` and ``splices(cluster, splice, start, stop)``.

    ``next(src, dst, edge)``: exon, following exon, splice; ``alt5``/``alt3(src, dst)``: distinct
    exons of a cluster that share their start or their end.  Only groups of exons and splices
    are shuffled, not the rows that they make.
    """
    of = lambda rows, keys, member, n: products.slabs(rows, ["cluster", *keys], member, products.slab(n))
    s = of(splices, ["start", "stop"], "splice", 3)
    a = of(exons.withColumnRenamed("exon", "src"), ["stop"], "src", 3).withColumnRenamed("stop", "start")
    b = of(exons.withColumnRenamed("exon", "dst"), ["start"], "dst", 3).withColumnRenamed("start", "stop")
    after = s.join(a, ["cluster", "start"]).join(b, ["cluster", "stop"])
    after = products.dealt(after, ["cluster", "start", "stop", "src_slab", "dst_slab", "splice_slab"])
    out = [after.select(F.explode("src").alias("src"), "dst", "splice").select("src", F.explode("splice").alias("edge"), "dst").select("src", F.explode("dst").alias("dst"), "edge")]
    for end in ("start", "stop"):
        a, b = (of(exons.withColumnRenamed("exon", side), [end], side, 2) for side in ("src", "dst"))
        pairs = products.dealt(a.join(b, ["cluster", end]), ["cluster", end, "src_slab", "dst_slab"])
        out.append(pairs.select(F.explode("src").alias("src"), "dst").select("src", F.explode("dst").alias("dst")).where("src <> dst"))
    return tuple(out)


def load_splice_graph(spark: SparkSession, exons: str, splices: str, form: str = "parquet", **options: str) -> tuple[Graph, Graph, Graph]:
    """(next, alt5, alt3) as graphs, of two files (cluster, exon, start, stop) and (cluster, splice, start, stop); see :func:`splice_graph`."""
    tables = [spark.read.format(form).options(**options).load(path) for path in (exons, splices)]
    after, alt5, alt3 = splice_graph(*tables)
    nodes = tables[0].select(F.col("exon").alias("id")).distinct()
    return tuple(Graph.of(e, "edge" if "edge" in e.columns else None).with_nodes(nodes) for e in (after, alt5, alt3))

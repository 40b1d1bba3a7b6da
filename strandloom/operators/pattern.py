"""Pattern queries: a small pattern graph compiled to joins over edge tables.

A pattern is a mapping from each pattern node to its successors, each with a dict of
options or None.  Every assignment of different data nodes to the pattern's nodes under
which each pattern edge is an edge of the data is a result row.  An edge to a new node is
a join on its source, one from a new node a join on its target, and one between bound
nodes, which are taken as early as can be, a join on both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import products
from strandloom.operators.graph import Graph
from strandloom.operators.overlap import clipped, overlap_join


@dataclass(frozen=True)
class Step:
    src: object
    dst: object
    options: Mapping
    closes: bool
    back: bool = False  # the target is bound and the source is found through the edge


def plan(pattern: Mapping, strict: bool = False, bound: Sequence = ()) -> tuple[list, list[Step]]:
    """(start nodes, steps).  Nodes that no start reaches are left out, or an error if ``strict``.

    Start nodes are those that no edge leads to.  Steps follow the first start breadth
    first; another start is entered backwards, through an edge to a node that is bound by
    then, so that it is joined and not paired with everything.  Nodes ``bound`` beforehand
    come first.
    """
    if not pattern:
        raise ValueError("an empty pattern")
    followed = {d for succ in pattern.values() for d in (succ or {})}
    starts = [n for n in pattern if n not in followed] or [next(iter(pattern))]
    for node in starts:
        for dst in pattern[node] or {}:
            if dst not in pattern:
                raise KeyError(f"pattern node {dst!r} has no entry of its own")
    known, steps, done = [n for n in bound if n in pattern], [], set()
    left = [n for n in starts if n not in known]
    reached = set(known) | set(_reached(pattern, [*known, *starts]))
    entered = []
    if not known:
        entered.append(left.pop(0))
        known.append(entered[0])
    while True:
        ready = [(a, b) for a in known for b in (pattern[a] or {}) if (a, b) not in done]
        if ready:
            a, b = next(((a, b) for a, b in ready if b in known), ready[0])  # what closes costs least
            steps.append(Step(a, b, (pattern[a] or {})[b] or {}, b in known))
        else:
            back = [(a, b) for a in reached for b in (pattern[a] or {}) if a not in known and b in known and not (({"expand", "subqueries", "filter"}) & set((pattern[a] or {})[b] or {}))]
            if back:
                a, b = min(back, key=lambda e: list(pattern).index(e[0]))
                steps.append(Step(a, b, (pattern[a] or {})[b] or {}, False, True))
            elif any(n not in known for n in left):
                a, b = next(n for n in left if n not in known), None
                entered.append(a)  # nothing ties it to what is bound so far
            else:
                break
        if b is None:
            known.append(a)
            continue
        done.add((a, b))
        known += [n for n in (a, b) if n not in known]
    if strict and len(known) < len(pattern):
        raise ValueError(f"not reached: {[n for n in pattern if n not in known]}")
    return entered, steps


def _reached(pattern: Mapping, starts: Sequence) -> list:
    found, queue = list(starts), list(starts)
    while queue:
        for dst in pattern[queue.pop(0)] or {}:
            if dst not in pattern:
                raise KeyError(f"pattern node {dst!r} has no entry of its own")
            if dst not in found:
                found.append(dst)
                queue.append(dst)
    return found


def match(graph: Graph, pattern: Mapping, seed: DataFrame | None = None, strict: bool = False, edges: bool = True, most: int | None = None, apart: bool = True) -> DataFrame:
    """All matches: a column ``n_<node>`` for each pattern node and, if ``edges``, ``e_<from>_<to>`` for each edge.

    Options of an edge: ``graph`` searches another graph for it; ``filter`` is called with the
    columns (to, from, edge) and a dict of the bound columns and returns a condition;
    ``attr`` takes the bound node's row in a table ``(id, <column>)``, given as (table,
    column), and goes to the entries of that column: a map's keys with its values as edges,
    or an array's elements without; ``function`` is a table function, called with the bound
    column, that yields rows (dst, edge) or (dst); ``expand`` is called with the rows so far
    and the name of the bound column and returns them with columns ``_dst`` and ``_edge``;
    ``subqueries`` is a sequence of patterns that all start at this edge's target, of whose
    matches the bag union is taken.  ``seed`` binds nodes: its columns are ``n_<node>``;
    rows that bind one data node twice are left out.  ``most``: so many matches at most.
    Without ``apart`` a data node may stand for several of the pattern's.
    """
    given = {str(n): n for n in pattern}
    bound = [] if seed is None else [c[2:] for c in seed.columns if c.startswith("n_")]
    starts, steps = plan(pattern, strict, [given[b] for b in bound if b in given])
    rows = seed
    for n, name in enumerate(bound):
        rows = rows.where(_apart(name, bound[:n] if apart else []))
    for node in starts:
        keys = graph.sources().select(F.col("id").alias(f"n_{node}"))
        if rows is None:
            rows = keys
            bound.append(str(node))
    for step in steps:
        for node in starts:  # a part of the pattern of its own, which no edge ties to the rest
            if str(node) == str(step.src) and str(node) not in bound and not step.back:
                rows = rows.crossJoin(graph.sources().select(F.col("id").alias(f"n_{node}"))).where(_apart(node, bound if apart else []))
                bound.append(str(node))
        rows, bound = _step(rows, bound, graph, step, apart)
    for node in starts:
        if str(node) not in bound:
            rows = rows.crossJoin(graph.sources().select(F.col("id").alias(f"n_{node}"))).where(_apart(node, bound if apart else []))
            bound.append(str(node))
    rows = rows if most is None else rows.limit(most)
    return rows if edges else rows.select(*[c for c in rows.columns if c.startswith("n_")])


def match_twins(members: DataFrame, edges: DataFrame, pattern: Mapping) -> DataFrame:
    """All matches, a column ``n_<node>`` for each pattern node, in a graph whose nodes come in classes of equal edges.

    ``members(id, twin)`` has the class of each node, ``edges(src, dst)`` which classes lead
    to which: each node of the one to each of the other.  The pattern is matched between
    classes, and what that finds stands for every choice of different members; so neither
    edges nor paths of the nodes are ever shuffled.  Null ids match nothing.
    """
    rows = match(Graph.of(edges.distinct()), pattern, edges=False, apart=False)
    nodes = rows.columns
    lists = products.slabs(members.where("id is not null").distinct(), ["twin"], "id", products.slab(len(nodes)))
    for n in nodes:
        rows = rows.join(lists.select(F.col("twin").alias(n), F.col("id").alias(f"_{n}"), F.col("id_slab").alias(f"_slab_{n}")), n)
    rows = products.dealt(rows, [*nodes, *[f"_slab_{n}" for n in nodes]]).select(*[F.col(f"_{n}").alias(n) for n in nodes])
    for i, n in enumerate(nodes):
        rows = rows.select(*nodes[:i], F.explode(n).alias(n), *nodes[i + 1 :]).where(_apart(n[2:], [m[2:] for m in nodes[:i]]))
    return rows


def batches(matches: DataFrame, size: int) -> Iterator[list]:
    """The matches, ``size`` at a time, each batch made as it is asked for: partition by partition, never all on the driver."""
    rows = matches.toLocalIterator(prefetchPartitions=False)
    while batch := list(islice(rows, size)):
        yield batch


def _apart(node: object, bound: list[str]):
    out = F.lit(True)
    for other in bound:
        if other != str(node):
            out = out & (F.col(f"n_{node}") != F.col(f"n_{other}"))
    return out


def through_overlap(sources: DataFrame, targets: DataFrame, seq: str = "seq") -> Callable[[DataFrame, str], DataFrame]:
    """An ``expand`` that goes from an interval to what overlaps it: ``sources`` and ``targets`` have (id, seq, start, stop).

    The edge is a struct (start, stop): what of the source is overlapped, on its own strand.
    """
    own, other = (x.select("id", seq, "start", "stop") for x in (sources, targets))

    def expand(rows: DataFrame, src: str) -> DataFrame:
        wanted = own.join(rows.select(F.col(src).alias("id")).distinct(), "id", "left_semi")
        hits = clipped(overlap_join(wanted, other, seq))
        return rows.join(hits.select(F.col("l_id").alias(src), F.col("r_id").alias("_dst"), F.struct(F.col("clip_start").alias("start"), F.col("clip_stop").alias("stop")).alias("_edge")), src)

    return expand


def _attribute(table: DataFrame, column: str) -> Callable[[DataFrame, str], DataFrame]:
    def expand(rows: DataFrame, src: str) -> DataFrame:
        own = table.select(F.col("id").alias(src), F.col(column).alias("_value"))
        kind = table.schema[column].dataType.typeName()
        entries = F.explode("_value").alias("_dst", "_edge") if kind == "map" else F.explode("_value").alias("_dst")
        out = rows.join(own, src).select(*rows.columns, entries)
        return out if kind == "map" else out.withColumn("_edge", F.lit(None).cast("string"))

    return expand


def _function(f: Callable) -> Callable[[DataFrame, str], DataFrame]:
    def expand(rows: DataFrame, src: str) -> DataFrame:
        out = rows.lateralJoin(f(F.col(src).outer()))
        found = [c for c in out.columns if c not in rows.columns]
        out = out.withColumnRenamed(found[0], "_dst")
        return out.withColumnRenamed(found[1], "_edge") if len(found) > 1 else out.withColumn("_edge", F.lit(None).cast("string"))

    return expand


def _step(rows: DataFrame, bound: list[str], graph: Graph, step: Step, apart: bool = True) -> tuple[DataFrame, list[str]]:
    src, dst, name = f"n_{step.src}", f"n_{step.dst}", f"e_{step.src}_{step.dst}"
    expand: Callable | None = step.options.get("expand")
    if "attr" in step.options or "function" in step.options:
        expand = _attribute(*step.options["attr"]) if "attr" in step.options else _function(step.options["function"])
    if expand and step.closes:
        out = expand(rows, src).where(F.col("_dst") == F.col(dst)).drop("_dst").withColumnRenamed("_edge", name)
    elif expand:
        out = expand(rows, src).withColumnsRenamed({"_dst": dst, "_edge": name})
    else:
        own = step.options.get("graph", graph)
        table = own.edges.where(F.col("dst").isNotNull()).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("edge").alias(name))
        if step.back:
            out = rows.join(table, F.col(dst) == F.col("_dst")).drop("_dst").withColumnRenamed("_src", src)
        elif step.closes:
            out = rows.join(table, (F.col(src) == F.col("_src")) & (F.col(dst) == F.col("_dst"))).drop("_src", "_dst")
        else:
            out = rows.join(table, F.col(src) == F.col("_src")).drop("_src").withColumnRenamed("_dst", dst)
    new = None if step.closes else step.src if step.back else step.dst
    now = bound if new is None else [*bound, str(new)]
    if new is not None:
        out = out.where(_apart(new, bound if apart else []))
    if "filter" in step.options:
        out = out.where(step.options["filter"](F.col(dst), F.col(src), F.col(name), {b: F.col(f"n_{b}") for b in now}))
    if "subqueries" in step.options:
        parts = []
        for sub in step.options["subqueries"]:
            part, have = out, list(now)
            for inner in plan(sub, bound=[n for n in sub if str(n) in now])[1]:
                part, have = _step(part, have, graph, inner, apart)
            parts.append(part)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        now = now + [c[2:] for c in out.columns if c.startswith("n_") and c[2:] not in now]
    return out, now

"""A catalog of named resources and of how they are related.

A zone is a folder of JSON lines, one file for each commit, so that what is there is never
changed in place; the last line for a name stands.  Zones are searched in order.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many targets a source, and how many sources a target has.
ONE_TO_ONE, ONE_TO_MANY, MANY_TO_ONE, MANY_TO_MANY = "1:1", "1:n", "n:1", "n:n"
_INVERSE = {ONE_TO_ONE: ONE_TO_ONE, ONE_TO_MANY: MANY_TO_ONE, MANY_TO_ONE: ONE_TO_MANY, MANY_TO_MANY: MANY_TO_MANY}


@dataclass(frozen=True)
class Resource:
    """A table by its format and path, what it is about, and the names of the resources that it refers to."""

    name: str
    doc: str
    format: str
    path: str
    options: dict = field(default_factory=dict)
    refers: tuple = ()


@dataclass(frozen=True)
class Relation:
    """``source`` has ``attribute``: what ``graph``, a resource with columns src, dst and edge, leads to in ``target``.

    With ``inverse`` the target has that attribute, back to the source.  ``key`` and
    ``target_key`` are the tables' columns that src and dst name; ``edge`` is the resource
    that edges name, if any.
    """

    name: str
    graph: str
    source: str
    key: str
    target: str
    target_key: str
    attribute: str
    inverse: str | None = None
    edge: str | None = None
    cardinality: str = MANY_TO_MANY


class Zone:
    """One catalog: additions and deletions are kept back until they are committed."""

    def __init__(self, spark: SparkSession, path: str, writable: bool = True):
        self.spark, self.path, self.writable = spark, path.rstrip("/"), writable
        self.pending: dict[tuple[str, str], dict | None] = {}

    def _stored(self) -> dict[tuple[str, str], dict]:
        """All entries; a catalog is of tables, not of rows, and fits the driver."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return {}
        lines = self.spark.read.text(self.path).collect()
        out: dict[tuple[str, str], dict] = {}
        for entry in sorted((json.loads(r.value) for r in lines), key=lambda e: e["commit"]):
            out[entry["kind"], entry["name"]] = entry["value"]
        return {k: v for k, v in out.items() if v is not None}

    def entries(self) -> dict[tuple[str, str], dict]:
        return {k: v for k, v in (self._stored() | self.pending).items() if v is not None}

    def add(self, resource: Resource) -> None:
        """Adds or replaces; a resource has to say what it is and may only refer to what is there."""
        if not resource.doc.strip():
            raise ValueError(f"{resource.name} has no description")
        missing = [n for n in resource.refers if ("resource", n) not in self.entries()]
        if missing:
            raise KeyError(f"{resource.name} refers to {missing}")
        self._put("resource", resource.name, asdict(resource))

    def relate(self, relation: Relation) -> None:
        self._put("relation", relation.name, asdict(relation))

    def delete(self, name: str) -> None:
        if ("resource", name) not in self.entries():
            raise KeyError(name)
        self._put("resource", name, None)

    def _put(self, kind: str, name: str, value: dict | None) -> None:
        if not self.writable:
            raise ValueError(f"{self.path} is read only")
        self.pending[kind, name] = value

    def rollback(self) -> None:
        self.pending.clear()

    def commit(self) -> None:
        """Writes what is pending as one file, whole or not at all."""
        if not self.pending:
            return
        stored = self.spark.read.text(self.path).selectExpr("max(cast(get_json_object(value, '$.commit') as int))").first()[0] if self._stored() else 0
        lines = [(json.dumps({"commit": (stored or 0) + 1, "kind": k, "name": n, "value": v}),) for (k, n), v in self.pending.items()]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(self.path)
        self.pending.clear()


class Catalog:
    """Zones in order: what the first that has a name says stands; what is written goes to the first that can be."""

    def __init__(self, *zones: Zone):
        self.zones = zones

    def _find(self, kind: str, name: str) -> dict:
        for zone in self.zones:
            if (kind, name) in (entries := zone.entries()):
                return entries[kind, name]
        raise KeyError(name)

    @property
    def writable(self) -> Zone:
        return next(z for z in self.zones if z.writable)

    def __call__(self, name: str) -> DataFrame:
        """The table of a dotted name."""
        r = self._find("resource", name)
        reader = self.zones[0].spark.read
        return reader.table(r["path"]) if r["format"] == "table" else reader.format(r["format"]).options(**r["options"]).load(r["path"])

    def names(self, pattern: str = "", regex: bool = False) -> dict[str, str]:
        """Names that begin with ``pattern``, or that it matches as a regular expression, with their descriptions."""
        out: dict[str, str] = {}
        for zone in reversed(self.zones):
            out |= {n: v["doc"] for (kind, n), v in zone.entries().items() if kind == "resource" and (re.search(pattern, n) if regex else n.startswith(pattern))}
        return dict(sorted(out.items()))

    def requires(self, name: str) -> list[str]:
        """The names that a resource needs, itself last: what has to be there to use it."""
        out: list[str] = []
        for other in self._find("resource", name)["refers"]:
            out += [n for n in self.requires(other) if n not in out]
        return [*out, name]

    def related(self, rows: DataFrame, owner: str, attribute: str, edges: bool = False) -> DataFrame:
        """``rows`` of the resource ``owner`` with what their ``attribute`` is: the columns of the related table, with ``<attribute>_`` before them.

        Where the relation says that there is one at most, a row that has none stays, with
        nulls, and one that has several is an error as the query runs.
        """
        found: dict[str, dict] = {}
        for zone in reversed(self.zones):
            found |= {n: v for (kind, n), v in zone.entries().items() if kind == "relation"}
        for r in found.values():
            forward = r["source"] == owner and r["attribute"] == attribute
            if not forward and not (r["target"] == owner and r["inverse"] == attribute):
                continue
            graph, key, target, target_key = self(r["graph"]), r["key"], r["target"], r["target_key"]
            cardinality = r["cardinality"]
            if not forward:
                graph, key, target, target_key, cardinality = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge"), r["target_key"], r["source"], r["key"], _INVERSE[cardinality]
            one = cardinality in (ONE_TO_ONE, MANY_TO_ONE)
            if one:
                several = F.raise_error(F.concat(F.lit(f"more than one {attribute} for "), F.col("src").cast("string")))
                graph = graph.groupBy("src").agg(F.min("dst").alias("dst"), F.min("edge").alias("edge"), F.count("*").alias("n")).withColumn("dst", F.when(F.col("n") == 1, F.col("dst")).otherwise(several)).drop("n")
            how = "left" if one else "inner"
            out = rows.join(graph.select(F.col("src").alias(key), F.col("dst").alias("_to"), F.col("edge").alias(f"{attribute}_edge")), key, how)
            other = self(target)
            out = out.join(other.select(*[F.col(c).alias("_to" if c == target_key else f"{attribute}_{c}") for c in other.columns]), "_to", how).withColumnRenamed("_to", f"{attribute}_{target_key}")
            return out if edges else out.drop(f"{attribute}_edge")
        raise AttributeError(f"{owner} has no {attribute}")

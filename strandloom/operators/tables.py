"""Tables and views: lookups, upserts, keyed mappings, foreign keys, prefix unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query(df: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have these values; None is null."""
    return df.where(reduce(Column.__and__, [F.col(c).isNull() if v is None else F.col(c) == v for c, v in equal.items()], F.lit(True)))


def get(df: DataFrame, key: str, value: object, unique: bool = True) -> DataFrame:
    """The row with this key; ``KeyError`` if there is none, or more than one where ``unique``."""
    found = df.where(F.col(key) == value)
    n = len(found.limit(2).select(key).collect())
    if not n or (unique and n > 1):
        raise KeyError(value)
    return found


def select(df: DataFrame, where: str, columns: list[str] | None = None, **values: object) -> DataFrame:
    """Rows under an SQL condition in which ``:name`` stands for one of ``values``; no value becomes part of the text."""
    spark = df.sparkSession
    found = spark.sql(f"SELECT * FROM {{rows}} WHERE {where}", args=values, rows=df) if values else df.where(where)
    return found.select(columns or "*")


def upsert(df: DataFrame, rows: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """``rows`` replace those of the same key, which may be of several columns.

    Of incoming rows with one key one stays: the last by ``order``, a column of theirs that
    may be beyond those of ``df``, or else the largest by its columns in turn.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(*keys)
    one = rows.groupBy(*keys).agg((F.max_by(row, order) if order else F.max(row)).alias("_row"))
    one = one.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    return df.join(one.select(keys), keys, "left_anti").select(df.columns).unionByName(one)


def with_new(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``df`` and ``rows``, which have no key: each gets a number of its own above all that there are.

    Numbers are distinct and rise with the partitions, but are not dense.
    """
    top = F.coalesce(df.agg(F.max(key)).scalar(), F.lit(0))
    return df.unionByName(rows.withColumn(key, (top + 1 + F.monotonically_increasing_id()).cast(df.schema[key].dataType)).select(df.columns))


def rekeyed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows under new keys, of ``keys(old, new)``; what stands under a new key gives way to the row that moves there."""
    moved = df.join(keys.select(F.col("old").alias(key), "new"), key).withColumn(key, F.col("new")).select(df.columns)
    stay = df.join(keys.select(F.col("old").alias(key)), key, "left_anti").join(keys.select(F.col("new").alias(key)), key, "left_anti")
    return stay.select(df.columns).unionByName(moved)


def ordered(df: DataFrame, *order: str | Column, after: int = 0, n: int | None = None) -> DataFrame:
    """Rows in order, from one place on and so many; a total order, so that pages fit together."""
    out = df.orderBy(*order).offset(after)
    return out if n is None else out.limit(n)


def cluster(df: DataFrame, cluster_key: str, key: str, ids: DataFrame) -> DataFrame:
    """All rows, once each by ``key``, of the clusters that the rows of ``ids(id)`` are in."""
    wanted = df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").select(cluster_key).distinct()
    return df.join(wanted, cluster_key, "left_semi").dropDuplicates([key])


def column_index(tables: dict[str, DataFrame], suffix: str | None = None, keys: bool = False) -> DataFrame:
    """(column, tables): which tables have each column, by its name after the table's prefix; with ``suffix`` those columns only.

    With ``keys`` only columns that join: those that several tables have.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [(c.split("_", 1)[-1], name) for name, df in tables.items() for c in df.columns if suffix is None or c.endswith(suffix)]
    out = spark.createDataFrame(rows, "column string, name string").groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tables"), F.countDistinct("name").alias("n"))
    return (out.where("n > 1") if keys else out).drop("n")


def table_graph(tables: dict[str, DataFrame], suffix: str = "key") -> DataFrame:
    """(src, dst, edge): tables that share a column whose name, after its table's prefix, ends in ``suffix``."""
    spark = next(iter(tables.values())).sparkSession
    rows = spark.createDataFrame([(c.split("_", 1)[-1], name) for name, df in tables.items() for c in df.columns if c.endswith(suffix)], "column string, name string")
    other = rows.withColumnRenamed("name", "dst")
    return rows.join(other, "column").where("name <> dst").select(F.col("name").alias("src"), "dst", F.col("column").alias("edge"))


def update(df: DataFrame, where: Column, **values: object) -> DataFrame:
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def page(df: DataFrame, key: str, after: object | None, n: int) -> DataFrame:
    """The next ``n`` rows by key: keyset pagination."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)


def map_view(source: DataFrame, target: DataFrame, on: str, source_key: str, target_key: str) -> DataFrame:
    """(source_key, target_key) of the sources that have exactly one target."""
    pairs = source.select(source_key, on).join(target.select(on, target_key), on)
    return pairs.groupBy(source_key).agg(F.min(target_key).alias(target_key), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def inverse_view(view: DataFrame) -> DataFrame:
    """A view the other way round: its target as the key, its source as what the key gives."""
    source, target, *rest = view.columns
    return view.select(target, source, *rest)


def mapped(rows: DataFrame, key: str, targets: DataFrame, target_key: str, many: bool = False) -> DataFrame:
    """``rows`` with the target that ``key`` names, or each of several where ``many`` and it is an array; rows without one are left out."""
    own = rows.withColumn("_at", F.explode(key) if many else F.col(key))
    return own.join(targets.withColumnRenamed(target_key, "_at"), "_at").withColumnRenamed("_at", target_key)


def graph_view(source: DataFrame, target: DataFrame, on: str, source_key: str, target_key: str, edge: str | None = None) -> DataFrame:
    """(source_key, target_key, ordinal): all targets of each source, in order; with ``edge`` that column of the target's, too."""
    own = [target_key, edge] if edge else [target_key]
    pairs = source.select(source_key, on).join(target.select(on, *own), on).select(source_key, *own)
    return pairs.withColumn("ordinal", F.row_number().over(Window.partitionBy(source_key).orderBy(target_key)))


def foreign_key(parents: DataFrame, children: DataFrame, key: str, refers: str) -> DataFrame:
    """Each parent with each row whose ``refers`` is its ``key``."""
    return parents.join(children, parents[key] == children[refers])


def parents_of(children: DataFrame, parents: DataFrame, refers: str, key: str) -> DataFrame:
    """Each row with its parent, with nulls where it refers to none."""
    return children.join(parents, children[refers] == parents[key], "left")


def cluster_pairs(df: DataFrame, cluster_key: str, key: str, other: str = "other") -> DataFrame:
    """(cluster_key, key, other): each row with all of its cluster, itself included."""
    own = df.select(cluster_key, key)
    return own.join(own.withColumnRenamed(key, other), cluster_key)


def existing(df: DataFrame, key: str, other: DataFrame, refers: str) -> DataFrame:
    """Rows that some row of ``other`` refers to."""
    return df.join(other.select(F.col(refers).alias(key)), key, "left_semi").select(df.columns)


def ranged(left: DataFrame, right: DataFrame, key: str, other_key: str, value: str, low: Column, high: Column) -> DataFrame:
    """Pairs of equal keys of which the right's ``value`` is from ``low`` to ``high``, columns of the left's."""
    return left.join(right, (left[key] == right[other_key]) & right[value].between(low, high))


def top(df: DataFrame, by: str, order: str | Column, n: int) -> DataFrame:
    """The first ``n`` rows of each ``by``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def aliased(df: DataFrame, **names: str) -> DataFrame:
    """Further columns, each an SQL expression of the others."""
    return df.withColumns({name: F.expr(text) for name, text in names.items()})


def prefix_union(members: dict[str, DataFrame], key: str, separator: str = ".") -> DataFrame:
    """All members' rows, with ``prefix<separator>key`` as the key."""
    parts = [df.withColumn(key, F.concat(F.lit(prefix + separator), F.col(key).cast("string"))) for prefix, df in members.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def member_map(keys: DataFrame, key: str, members: dict[str, object], default: object = None, separator: str = ".") -> DataFrame:
    """``keys`` with a column ``member``: the value for the key's prefix, or the default.  The map is of members, not of rows."""
    value = F.lit(default)
    for prefix, member in members.items():
        value = F.when(F.substring_index(F.col(key), separator, 1) == prefix, F.lit(member)).otherwise(value)
    return keys.withColumn("member", value)


def grown(members: dict[str, DataFrame], name: str | None, df: DataFrame) -> dict[str, DataFrame]:
    """``members`` and one more, under its name, or else the first of ``noname0``, ``noname1`` ... that is free."""
    if name in members:
        raise KeyError(f"{name!r} is there already")
    free = name or next(f"noname{i}" for i in range(len(members) + 1) if f"noname{i}" not in members)
    return {**members, free: df}


def read_header(text: str) -> tuple[str, dict[str, str]]:
    """(separator, path by prefix) of a union's header: the separator's line, then a line ``prefix<tab>path`` for each member."""
    first, *lines = text.splitlines()
    return first, dict(line.split("\t", 1) for line in lines if line.strip())


def write_header(separator: str, members: dict[str, str]) -> str:
    return "\n".join([separator, *(f"{prefix}\t{path}" for prefix, path in members.items())]) + "\n"


def split_prefix(key: Column, separator: str = ".") -> tuple[Column, Column]:
    """(prefix, rest), parted at the first separator."""
    prefix = F.substring_index(key, separator, 1)
    return prefix, F.substring(key, F.length(prefix) + len(separator) + 1, F.length(key))


def rescued_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """(part, id): parts of ids between bars, upper-cased, that name one id only."""
    parts = ids.select(column, F.explode(F.split(column, "\\|")).alias("part")).select(column, F.upper("part").alias("part")).where("part <> ''").distinct()
    one = parts.groupBy("part").agg(F.count("*").alias("n"), F.min(column).alias("id"))
    return one.where("n = 1").select("part", "id")

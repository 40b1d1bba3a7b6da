"""Queries of tables and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import catalog, tables
from strandloom.plans import views as v
from strandloom.plans.base import query
from strandloom.sources.shared import shared_folder

C = F.col


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def ra_group_iteration(s, d):
    """The keys of a table with many rows to a key, in order."""
    return v.t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first")).orderBy("o_custkey")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, (200 + row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey))::INTEGER AS place FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 300 OFFSET 200)")
def ra_ordered(s, d):
    """The third hundred to the fifth by date, the latest first, with their places."""
    page = tables.ordered(v.t(s, d, "orders").select("o_orderkey", "o_orderdate"), F.desc("o_orderdate"), "o_orderkey", after=200, n=300)
    place = F.row_number().over(tables.Window.orderBy(F.desc("o_orderdate"), "o_orderkey"))  # of a page, not of the table
    return page.select("o_orderkey", C("o_orderdate").cast("date").cast("string").alias("day"), (place + 200).alias("place"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (5, 77))")
def ra_cluster_dedupe(s, d):
    """Rows of whole clusters, fetched for some of their members, each once."""
    rows = v.t(s, d, "lineitem").select("l_partkey", "l_suppkey", F.struct("l_partkey", "l_suppkey").alias("pk"))
    ids = rows.where("l_partkey in (5, 77)").select(C("pk").alias("id"))
    return tables.cluster(rows, "l_suppkey", "pk", ids).drop("pk")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000.5 AND c_mktsegment LIKE 'B%'")
def tb_select(s, d):
    return tables.select(v.t(s, d, "customer"), "c_acctbal > :least AND c_mktsegment LIKE :like", ["c_custkey", "c_name"], least=1000.5, like="B%")


@query("SELECT p_partkey, p_name, p_size FROM part")
def tb_project(s, d):
    """Only these columns are read."""
    return v.t(s, d, "part").select("p_partkey", "p_name", "p_size")


@query("SELECT (n_nationkey + CASE WHEN n_nationkey < 10 THEN 15 ELSE 100 END)::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey < 10 OR n_nationkey = 12 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (10, 11, 13, 14)")
def tb_rekey(s, d):
    """Ten rows move to the keys of ten others, which give way; one moves to a new key."""
    n = v.t(s, d, "nation").select(C("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    keys = n.where("n_nationkey < 10 or n_nationkey = 12").select(C("n_nationkey").alias("old"), (C("n_nationkey") + F.when(C("n_nationkey") < 10, 15).otherwise(100)).alias("new"))
    return tables.rekeyed(n, "n_nationkey", keys)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 10, 13)")
def tb_multi_row_key(s, d):
    """All rows of some keys of a table in which keys repeat."""
    return v.t(s, d, "orders").where(C("o_custkey").isin(7, 10, 13)).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END::DOUBLE AS quantity FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)")
def tb_composite_key(s, d):
    """A key of two columns: rows replace those of the same key, the last of several."""
    rows = v.t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("quantity"))
    more = rows.where("l_linenumber = 1").withColumn("quantity", F.explode(F.array(C("quantity") - 3, C("quantity") + 1)))
    return tables.upsert(rows, more, ["l_orderkey", "l_linenumber"], "quantity")


@query("SELECT count(*) AS n, count(DISTINCT key) AS keys, min(key) = 0 AS kept FROM (SELECT n_nationkey AS key FROM nation UNION ALL SELECT 1000 + row_number() OVER () FROM region)")
def tb_new_rows(s, d):
    """Rows without a key get new ones; which ones is open, that they are new is not."""
    rows = v.t(s, d, "nation").select(C("n_nationkey").cast("long").alias("key"), C("n_name").alias("name"))
    out = tables.with_new(rows, v.t(s, d, "region").select(C("r_name").alias("name")), "key")
    return out.agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), (F.min("key") == 0).alias("kept"))


_TABLES = ("customer", "nation", "orders", "region", "supplier")


@query("SELECT col AS \"column\", string_agg(DISTINCT tab, ',' ORDER BY tab) AS tables FROM (SELECT table_name AS tab, substr(column_name, strpos(column_name, '_') + 1) AS col FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'orders', 'region', 'supplier') AND ends_with(column_name, 'key')) GROUP BY col HAVING count(DISTINCT tab) > 1")
def tb_table_set(s, d):
    """Key columns that several tables have."""
    return tables.column_index({n: v.t(s, d, n) for n in _TABLES}, "key", keys=True)


@query("SELECT a.tab AS src, b.tab AS dst, a.col AS edge FROM (SELECT table_name AS tab, substr(column_name, strpos(column_name, '_') + 1) AS col FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'orders', 'region', 'supplier') AND ends_with(column_name, 'key')) a JOIN (SELECT table_name AS tab, substr(column_name, strpos(column_name, '_') + 1) AS col FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'orders', 'region', 'supplier') AND ends_with(column_name, 'key')) b ON a.col = b.col AND a.tab <> b.tab")
def tb_table_graph(s, d):
    return tables.table_graph({n: v.t(s, d, n) for n in _TABLES})


@query("SELECT doc_id, substr(seq, 6, 12) AS part, length(seq)::INTEGER AS length FROM seqs WHERE length(seq) > 17")
def tb_sequence_rows(s, d):
    """Rows that are sequences: a slice is taken where the row is."""
    return v.seqs(s, d).where("length(seq) > 17").select("doc_id", F.substring("seq", 6, 12).alias("part"), F.length("seq").alias("length"))


@query("SELECT o_orderkey, c_custkey FROM customer JOIN orders ON c_custkey = o_custkey")
def jn_inverse_view(s, d):
    c, o = v.t(s, d, "customer").withColumn("k", C("c_custkey")), v.t(s, d, "orders").withColumn("k", C("o_custkey"))
    return tables.inverse_view(tables.graph_view(c, o, "k", "c_custkey", "o_orderkey").drop("ordinal"))


@query("SELECT c_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey)::INTEGER AS ordinal FROM customer JOIN orders ON c_custkey = o_custkey")
def jn_graph_view_edge(s, d):
    c, o = v.t(s, d, "customer").withColumn("k", C("c_custkey")), v.t(s, d, "orders").withColumn("k", C("o_custkey"))
    return tables.graph_view(c, o, "k", "c_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT src, id, c_name FROM (SELECT src, unnest(list(dst)) AS id FROM g_ring GROUP BY src) JOIN customer ON c_custkey = id")
def jn_id_mapping(s, d):
    """Ids that a row lists, as the rows that they name; ids that name none are left out."""
    lists = v.g_ring(s, d).groupBy("src").agg(F.collect_list("dst").alias("ids"))
    return tables.mapped(lists, "ids", v.t(s, d, "customer").select(C("c_custkey").alias("id"), "c_name"), "id", many=True).select("src", "id", "c_name")


@query("SELECT id, CASE split_part(id, '.', 1) WHEN 'a1' THEN 'one' WHEN 'a2' THEN 'two' ELSE 'other' END AS member FROM (SELECT 'a' || p_size || '.' || p_partkey AS id FROM part)")
def so_member_map(s, d):
    p = v.t(s, d, "part").select(F.concat(F.lit("a"), C("p_size").cast("string"), F.lit("."), C("p_partkey").cast("string")).alias("id"))
    return tables.member_map(p, "id", {"a1": "one", "a2": "two"}, "other")


@query("SELECT 'r.' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'noname0.' || n_nationkey, n_name FROM nation UNION ALL SELECT 'noname1.' || s_suppkey, s_name FROM supplier")
def so_growable(s, d):
    own = lambda t, k, n: v.t(s, d, t).select(C(k).cast("string").alias("id"), C(n).alias("name"))
    members = tables.grown({"r": own("region", "r_regionkey", "r_name")}, None, own("nation", "n_nationkey", "n_name"))
    return tables.prefix_union(tables.grown(members, None, own("supplier", "s_suppkey", "s_name")), "id")


@query("SELECT c_custkey, c_name, n_name AS nation_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ct_related(s, d):
    """The nation of each customer, by a relation of a catalog that was written and is read again."""
    links, folder = shared_folder(s, "links"), shared_folder(s, "zone")
    v.t(s, d, "customer").select(C("c_custkey").alias("src"), C("c_nationkey").alias("dst"), F.lit(None).cast("string").alias("edge")).write.parquet(links)
    zone = catalog.Zone(s, folder)
    for name, path in (("Trade.customer", f"{d}/customer.parquet"), ("Trade.nation", f"{d}/nation.parquet"), ("Trade.lives", links)):
        zone.add(catalog.Resource(name, "a table", "parquet", path))
    zone.relate(catalog.Relation("lives", "Trade.lives", "Trade.customer", "c_custkey", "Trade.nation", "n_nationkey", "nation", "customers", cardinality=catalog.MANY_TO_ONE))
    zone.commit()
    every = catalog.Catalog(catalog.Zone(s, folder, writable=False))
    return every.related(every("Trade.customer"), "Trade.customer", "nation").select("c_custkey", "c_name", "nation_n_name")

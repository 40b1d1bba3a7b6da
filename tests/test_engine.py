"""The engine's operators on small inputs with known answers, and the overlap join against all pairs."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions import sequences as sq
from strandloom.operators import alignment, overlap, pattern, tables
from strandloom.operators.graph import Graph
from strandloom.sources import fasta, multiple

FOO = "ggcatttacgcgaatcc"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_letters(spark):
    lit = F.lit
    assert one(spark, sq.substring(lit(FOO), lit(5), lit(10))) == "ttacg"
    assert one(spark, sq.substring(lit(FOO), lit(-10), lit(-5))) == "cgtaa"
    assert one(spark, sq.reverse_complement(lit(FOO))) == "ggattcgcgtaaatgcc"
    assert one(spark, sq.translate(lit("GCATGGaaacgt"))) == "AWKR"
    assert one(spark, sq.translate(lit("auguaaNN"))) == "M*X"
    assert one(spark, sq.translate(lit(""))) == ""
    assert [one(spark, sq.guess_type(lit(x))) for x in (FOO, "ggcauuuacgcgaaucc", "mkwldpeqhhrly", "")] == [0, 1, 2, None]
    frames = {r.frame: (r.start, r.stop) for r in one(spark, sq.six_frames(lit(12).cast("long")))}
    assert frames == {1: (0, 12), 2: (1, 10), 3: (2, 11), -1: (-12, 0), -2: (-10, -1), -3: (-11, -2)}


def test_slices(spark):
    cut = lambda a, b, i, j: (lambda r: r and (r.start, r.stop))(one(spark, iv.sliced(F.lit(a), F.lit(b), F.lit(i), F.lit(j))))
    assert cut(0, 17, 4, 9) == (4, 9)
    assert cut(-17, 0, 4, 9) == (-13, -8)
    assert cut(0, 17, -1000, 6) == (0, 6)
    assert cut(0, 17, -6, 5000) == (11, 17)
    assert cut(0, 17, 400, 900) is None
    assert cut(0, 17, 9, 4) == (-9, -4)


def test_strands(spark):
    pair = lambda c: (lambda r: r and (r.start, r.stop))(one(spark, c))
    x = [F.lit(n) for n in (6, 14, 9, 16)]
    assert pair(iv.intersect(*x)) == (9, 14)
    assert pair(iv.intersect(F.lit(-9), F.lit(-4), F.lit(-11), F.lit(-6))) == (-9, -6)
    assert pair(iv.intersect(F.lit(4), F.lit(9), F.lit(-11), F.lit(-6))) is None
    assert pair(iv.flip(F.lit(3), F.lit(9))) == (-9, -3)


def test_overlap_is_turned_to_the_query(spark):
    stored = spark.createDataFrame([("a", 0, 10, 1), ("a", -20, -5, 2), (None, 0, 9, 3), ("a", 4, 4, 4)], "seq string, start long, stop long, id long")
    ask = spark.createDataFrame([("a", 0, 10), ("a", -11, -7)], "seq string, start long, stop long")
    got = {(r.l_start, r.r_id, r.hit_start, r.hit_stop) for r in overlap.overlap_join(ask, stored).collect()}
    assert got == {(0, 1, 0, 10), (0, 2, 5, 20), (-11, 1, -10, 0), (-11, 2, -20, -5)}


def test_overlap_join_is_all_pairs(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        start = r.randrange(5000)
        size = r.choice([1, 5, 64, 65, 300, 5000, 40_000])
        rows.append((r.choice("aab"), start, start + size, i) if r.random() < 0.7 else ("a", -start - size, -start, i))
    df = spark.createDataFrame(rows, "seq string, start long, stop long, id long")
    place = lambda x: (x[1], x[2]) if x[1] >= 0 else (-x[2], -x[1])
    want = sorted((a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and place(a)[0] < place(b)[1] and place(b)[0] < place(a)[1])
    got = overlap.overlap_join(df, df, width=16, step=8, levels=3)
    assert sorted((x.l_id, x.r_id) for x in got.collect()) == want


def test_overlap_join_of_one_long_sequence(spark):
    """Many intervals that each meet only themselves, and a few long ones: no key is met by all."""
    d = spark.range(60_000).select(F.lit("s").alias("seq"), "id", (F.col("id") * 100).alias("start"), (F.col("id") * 100 + F.when(F.col("id") % 20_000 == 7, 250_000).otherwise(60)).alias("stop"))
    long = overlap.overlap_join(d, d).where("l_id % 20000 = 7").groupBy("l_id").count().collect()
    assert overlap.overlap_join(d, d).count() == 60_000 + 2 * 3 * 2499 and {r["count"] for r in long} == {2500}


def test_merging_by_gaps(spark):
    aln = spark.createDataFrame([("s", 0, 5, "t", 0, 5), ("s", 6, 9, "t", 6, 9), ("s", 40, 50, "t", 40, 50), ("s", 41, 43, "t", 41, 43)], "src string, start long, stop long, tgt string, tgt_start long, tgt_stop long")
    got = sorted((r.start, r.stop, r.n) for r in alignment.merged(aln, 2, 2, -10).collect())
    assert got == [(0, 9, 2), (40, 43, 2)]  # a run ends as its last interval does
    assert [tuple(r)[2:] for r in alignment.merged_all(aln).collect()] == [(0, 43, 0, 43, 4)]


def test_depth_counts_a_member_once(spark):
    rows = [("s", "a", 0, 10), ("s", "a", 5, 12), ("s", "b", 8, 20), ("s", "c", 20, 25)]
    got = alignment.depth_regions(spark.createDataFrame(rows, "seq string, m string, start long, stop long"), "seq", "m", 2).collect()
    assert [(r.start, r.stop, r.depth) for r in got] == [(8, 12, 2)]


def graph(spark, edges):
    return Graph.of(spark.createDataFrame([(a, b, f"{a}-{b}") for a, bs in edges.items() for b in bs], "src int, dst int, edge string"), "edge")


def matches(spark, edges, query, **options):
    found = pattern.match(graph(spark, edges), query, edges=False, **options)
    return sorted(tuple(r[f"n_{n}"] for n in query if f"n_{n}" in r) for r in found.collect())


PATTERNS = (
    {0: {1: None}, 1: {}},
    {0: {1: None, 2: None}, 1: {2: None}, 2: {}},
    {0: {1: None}, 1: {2: None}, 2: {0: None}},
    {0: {1: None, 2: None, 3: None}, 1: {}, 2: {}, 3: {4: None}, 4: {}},
    {0: {2: None}, 1: {2: None, 3: None}, 2: {3: None}, 3: {}},
    {0: {3: None}, 1: {3: None}, 2: {3: None}, 3: {}},
)


@pytest.mark.parametrize("query", PATTERNS, ids=str)
def test_patterns_are_all_assignments(spark, query):
    """Against every choice of different nodes, on a graph with loops, of the first node's sources."""
    r = random.Random(2)
    edges = {a: sorted({r.randrange(8) for _ in range(3)}) for a in range(0, 8, 1) if a != 5}
    want = sorted(n for n in itertools.permutations(range(8), len(query)) if all(n[b] in edges.get(n[a], ()) for a, succ in query.items() for b in succ))
    assert want and matches(spark, edges, query) == want


def test_pattern_options(spark):
    only = {0: {1: {"filter": lambda to, at, edge, bound: to == 3}}, 1: {}}
    assert matches(spark, {7: [1, 3], 8: [3], 3: [3, 9]}, only) == [(7, 3), (8, 3)]
    with pytest.raises(ValueError):
        pattern.plan({})
    with pytest.raises(KeyError):
        pattern.plan({0: {1: None}})
    with pytest.raises(ValueError):
        pattern.plan({0: {1: None}, 1: {}, 7: {8: None}, 8: {7: None}}, strict=True)


def test_graph_changes(spark):
    g = graph(spark, {11: [12], 12: [13, 15], 14: [12, 11]})
    edges = lambda x: sorted((r.src, r.dst) for r in x.edges.collect())
    gone = spark.createDataFrame([(12,)], "id int")
    assert edges(g.without_nodes(gone)) == [(11, 12), (14, 11), (14, 12)]
    assert edges(g.without_nodes(gone, incoming=True)) == [(14, 11)]
    assert edges(g.inverse()) == [(11, 14), (12, 11), (12, 14), (13, 12), (15, 12)]
    assert g.difference(g.inverse().inverse()).count() == 0
    assert edges(g.merged(graph(spark, {11: [12], 19: [11]}))) == [(11, 12), (12, 13), (12, 15), (14, 11), (14, 12), (19, 11)]


def test_views(spark):
    a = spark.createDataFrame([(21, "oak"), (22, "elm"), (23, "fir"), (24, "yew")], "left_id int, kind string")
    b = spark.createDataFrame([(70, "oak"), (71, "elm"), (73, "fir"), (72, "fir")], "right_id int, kind string")
    assert {tuple(r) for r in tables.map_view(a, b, "kind", "left_id", "right_id").collect()} == {(21, 70), (22, 71)}
    assert {tuple(r) for r in tables.graph_view(a, b, "kind", "left_id", "right_id").collect()} == {(21, 70, 1), (22, 71, 1), (23, 72, 1), (23, 73, 2)}
    assert [r.right_id for r in tables.page(b, "right_id", None, 3).collect()] == [70, 71, 72]
    with pytest.raises(KeyError):
        tables.get(b, "kind", "fir")
    with pytest.raises(KeyError):
        tables.get(b, "kind", "none")
    assert tables.get(b, "kind", "fir", unique=False).count() == 2


def test_prefixes(spark):
    ids = spark.createDataFrame([("a.seq.1.more",)], "id string")
    a, b = tables.split_prefix(F.col("id"))
    assert tuple(ids.select(a, b).first()) == ("a", "seq.1.more")


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", "acgt" * 40), ("y", "a" * 60), ("z", "")], "seq_id string, seq string")
    fasta.write(df.coalesce(1), str(tmp_path / "f"))
    assert {(r.seq_id, r.seq, r.length) for r in fasta.read(spark, str(tmp_path / "f")).collect()} == {("x", "acgt" * 40, 160), ("y", "a" * 60, 60)}


def test_maf(spark, tmp_path):
    (tmp_path / "m.maf").write_text("##maf version=1\n\na score=1\ns hg.1 10 6 + 100 ac--gtta\ns mm.2 5 8 - 50 acacgtta\n\na score=2\ns hg.1 30 2 + 100 ac\n")
    got = {(r.seq_id, r.start, r.stop, r.col_start, r.col_stop) for r in multiple.read_maf(spark, str(tmp_path / "m.maf")).collect()}
    assert got == {("hg.1", 10, 12, 0, 2), ("hg.1", 12, 16, 4, 8), ("mm.2", -45, -37, 0, 8), ("hg.1", 30, 32, 0, 2)}


def test_queries_have_sql():
    from strandloom.plans import registry

    assert set(registry.oracle_sql()) == set(registry.queries())


def test_queries_return_what_their_sql_does(spark):
    """Some of each kind, on the smallest tables: the rows, and the columns' names."""
    from strandloom.plans import registry

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    for name in ("jn_overlap_clip", "jn_two_hop", "ag_vertical_group", "ag_merge_sized", "ag_conserved", "gq_two_starts", "gr_packed", "an_add", "src_blast", "seq_translate_wild", "tb_rekey", "iv_reorient"):
        out = registry.queries()[name](spark, data)
        columns = sorted(out.columns)
        want = con.sql(registry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in out.collect()))) == sorted(map(repr, want)), name


def test_twins_are_matched_as_nodes(spark):
    """Patterns over classes against the same over nodes, with loops, a class of several slabs and an id in no class's edges."""
    r = random.Random(5)
    twin = {i: r.randrange(5) for i in range(70)}
    links = {(a, b) for a in range(4) for b in range(5) if r.random() < 0.4} | {(0, 0)}
    members = spark.createDataFrame([*twin.items(), (None, 1), (3, twin[3])], "id long, twin long")
    edges = spark.createDataFrame(sorted(links), "src long, dst long")
    whole = Graph.of(spark.createDataFrame([(a, b) for a in twin for b in twin if (twin[a], twin[b]) in links], "src long, dst long"))
    for query in ({0: {1: None, 2: None}, 1: {2: None}, 2: {}}, {0: {1: None}, 1: {0: None}}):
        got, want = pattern.match_twins(members, edges, query), pattern.match(whole, query, edges=False)
        assert got.count() == want.count() > 0 and not got.select(sorted(got.columns)).exceptAll(want.select(sorted(want.columns))).head(1)


def test_splices_are_shuffled_as_groups(spark):
    """Every exon to every other over every splice, nulls and repeats included; what is shuffled does not grow as the rows do."""
    from strandloom.operators.graph import splice_graph

    rows = [("c", i if i else None, 0, 5) for i in range(50)] + [("c", 100 + i, 20, 25) for i in range(45)] + [("c", 100, 20, 25), (None, 7, 0, 5)]
    exons = spark.createDataFrame(rows, "cluster string, exon long, start long, stop long")
    splices = spark.createDataFrame([("c", n, 5, 20) for n in (1, 2, 2, None)], "cluster string, splice long, start long, stop long")
    after, alt5, alt3 = splice_graph(exons, splices)
    want = sorted(map(repr, ((a[1], b[1], s) for a in rows[:50] for b in rows[50:96] for s in (1, 2, 2, None))))
    assert sorted(map(repr, map(tuple, after.collect()))) == want
    pairs = sorted((a[1], b[1]) for x in (rows[:50], rows[50:96]) for a in x for b in x if a[1] and b[1] and a[1] != b[1])
    assert sorted(map(tuple, alt5.collect())) == pairs == sorted(map(tuple, alt3.collect()))
    for found in (after, alt5, alt3):
        top = found._jdf.queryExecution().optimizedPlan().toString()
        assert top.index("Generate explode") < top.index("Join")  # the groups meet before they are taken apart


def test_regions_are_a_stream(spark):
    """Against every letter counted, over bins and batches of a few rows; each event is sorted once and grouped in no table."""
    r, rows = random.Random(7), []
    for _ in range(900):
        start = r.randrange(400)
        rows.append((r.choice("ab") if r.random() < 0.9 else "c", r.choice("mnopq"), start, start + r.choice([1, 3, 8, 8, 30])))
    df = spark.createDataFrame(rows, "seq string, m string, start long, stop long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {(n, w): sorted(map(tuple, alignment.regions(df, ["seq"], "m", least, width=w).collect())) for n, least in ((2, 2), (4, F.lit(4))) for w in (16, 1 << 16)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for (n, _), got in found.items():
        want = []
        for seq in "abc":
            flat = set()
            for m in "mnopq":
                far, first = -1, None
                for start, stop in sorted(x[2:] for x in rows if x[:2] == (seq, m)):
                    if start >= far:
                        flat |= {(m, first, far)} if first is not None else set()
                        first = start
                    far = max(far, stop)
                flat |= {(m, first, far)} if first is not None else set()
            depth = [sum(a <= i < z for _, a, z in flat) for i in range(450)]
            on = [False] + [depth[i] - sum(a == i for _, a, _ in flat) >= n for i in range(1, 450)]
            for i in range(450):
                if depth[i] >= n:
                    if i and depth[i - 1] >= n and on[i]:
                        want[-1] = (seq, want[-1][1], i + 1)
                    else:
                        want.append((seq, i, i + 1))
        assert got == sorted(want)
    top = alignment.regions(df, ["seq"], "m", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert top.count("Aggregate") == 1 and top.count("MapInArrow") == 2


def test_merging_needs_no_aggregate(spark):
    """Runs and their blocks are told from one order of the rows, of which a task holds no table."""
    r = random.Random(9)
    rows = [(r.choice("st"), k * 5, k * 5 + 5, "u", k * 5 + k // 9 * 30, k * 5 + k // 9 * 30 + 5) for k in sorted(r.sample(range(200), 120))]
    aln = spark.createDataFrame(rows, "src string, start long, stop long, tgt string, tgt_start long, tgt_stop long")
    want = []
    for src in "st":
        last = None
        for _, a, z, _, b, y in sorted(x for x in rows if x[0] == src):
            if last is None or a - last[1] > 15 or not 0 <= b - last[3] <= 60:
                want.append((src, []))
            elif (a, b) == (last[1], last[3]):
                a, _, b, _ = want[-1][1].pop()
            last = (a, z, b, y)
            want[-1][1].append(last)
    want = sorted((src, x[0][0], x[-1][1], x[0][2], x[-1][3], x if len(x) > 1 else None) for src, x in want)
    for size in (None, 10_000):
        got = alignment.merged(aln, 15, 60, 0, size, blocks=True)
        assert sorted((x.src, x.start, x.stop, x.tgt_start, x.tgt_stop, x.blocks and [tuple(b) for b in x.blocks]) for x in got.collect()) == want
        assert sum(x.n for x in got.collect()) == len(rows)
    for blocks in (False, True):
        assert "Aggregate" not in alignment.merged(aln, 15, 60, 0, blocks=blocks)._jdf.queryExecution().optimizedPlan().toString()


def test_translation_is_bounded(spark):
    """A batch is translated in parts: memory is that of a part, and the proteins are the same."""
    import tracemalloc

    import pandas as pd

    seqs = pd.Series(["acgtn" * 300, None, "", "aé☃tgg", "ggn"] * 2000)
    assert sq._translated.func(seqs[:5]).tolist() == ["TXRXV" * 100, None, "", "XW", "G"]
    tracemalloc.start()
    out = sq._translated.func(seqs)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert out.tolist() == sq._translated.func(seqs[:5]).tolist() * 2000 and peak - kept < 16_000_000


def test_seeds_over_pieces(spark):
    """Words at the edges of pieces, and repeats, against all places; targets are dealt out by word once."""
    from strandloom.sources import blast

    r = random.Random(11)
    base = "".join(r.choice("acgt") for _ in range(200))
    seqs = [(0, base), (1, base[60:131] + "g" + base[10:90]), (2, "a" * 80 + base[:64]), (3, base[:7])]
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    words = [(n, i, s[i : i + 8]) for n, s in seqs for i in range(len(s) - 7)]
    count = {w: sum(x[2] == w for x in words) for _, _, w in words}
    met = {(a, b, i, j - i) for a, i, x in words for b, j, y in words if x == y and count[x] <= 5}
    want = []
    for a, b, i, d in met:
        if (a, b, i - 1, d) not in met:
            stop = next(z for z in range(i, 300) if (a, b, z, d) not in met) + 7
            want.append((a, i, stop, b, i + d, stop + d))
    got = blast.seeds(df, df, 8, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1

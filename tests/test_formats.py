"""Readers, annotations, catalog and alignment rules on small inputs with answers worked out by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.functions import sequences as sq
from strandloom.operators import alignment, annotation, catalog, graph, pattern, tables
from strandloom.sources import blast, fasta, multiple, tabular

REPORT = """BLAST 1

Query= one a title
         (30 letters)

>alpha the first
          Length = 300

 Score = 50.1 bits (25), Expect = 3e-07
 Identities = 14/16 (87%), Gaps = 2/16 (12%)

Query: 5   acgtacgt--acgt 16
           |||||||| |
Sbjct: 101 acgtacgtttacgt 114

Query: 17  ac 18
Sbjct: 115 ac 116

 Score = 20.0 bits (10), Expect = e-12
 Identities = 6/6 (100%)

Query: 1   acgtac 6
Sbjct: 40  acgtac 35

Query= two
>beta
 Score = 9.0 bits (4), Expect = 0.0
 Identities = 3/3 (100%)

Query: 1   MKV 3
Sbjct: 1   MKV 9
  Database: all
"""


def test_search_reports(spark, tmp_path):
    (tmp_path / "r.txt").write_text(REPORT)
    hits = blast.read(spark, str(tmp_path / "r.txt"))
    got = sorted((r.src_id, r.src_start, r.src_end, r.dest_id, r.dest_start, r.dest_end, r.dest_ori, r.percent_id, r.hit) for r in hits.collect())
    assert got == [("one", 0, 6, "alpha", 34, 40, -1, 100, 1), ("one", 4, 12, "alpha", 100, 108, 1, 87, 0), ("one", 12, 18, "alpha", 110, 116, 1, 87, 0), ("two", 0, 3, "beta", 0, 9, 1, 100, 0)]
    assert {round(r.e_value, 3) for r in hits.collect()} == {6.523, 12.0, 300.0}
    signed = blast.as_alignment(hits, lambda h: h.where("score > 9"))
    assert ("one", 0, 6, "alpha", -40, -34) in {tuple(r) for r in signed.collect()} and signed.count() == 3
    with pytest.raises(ValueError):
        list(blast.parse("q\n>s\nQuery: 1 ac 2\nSbjct: 1 acg 3\n"))
    (tmp_path / "none").write_text("")
    with pytest.raises(OSError):
        blast.read(spark, str(tmp_path / "none"))


def test_subject_numbers_that_run_into_letters():
    rows = list(blast.parse("q\n>s\n Score = 1 bits (1), Expect = 1\n Identities = 3/4 (75%)\nQuery: 1    acgt 4\nSbjct: 12345acg 12347\n"))
    assert [r[5:7] for r in rows] == [(12344, 12348)]


def test_maf_headers_and_unknown_sequences(spark, tmp_path):
    text = "a score=1\ns x.1 10 6 + 100 ac--gtta\ns y.2 5 8 - 50 acacgtta\n\na score=2\ns x.1 30 2 + 100 ac\n"
    (tmp_path / "m").write_text(text)
    with pytest.raises(ValueError):
        multiple.read_maf(spark, str(tmp_path / "m"))
    known = spark.createDataFrame([("y.2",)], "seq_id string")
    assert [(r.start, r.stop) for r in multiple.read_maf(spark, str(tmp_path / "m"), known, header=False).collect()] == [(-45, -37)]
    got = {tuple(r) for r in multiple.pairs(multiple.read_maf(spark, str(tmp_path / "m"), header=False), "x").collect()}
    assert got == {("x.1", 10, 12, "y.2", -45, -43), ("x.1", 12, 16, "y.2", -41, -37)}


def test_axt(spark, tmp_path):
    (tmp_path / "p.axt").write_text("# pairs\n0 1 11 18 2 21 28 + 7\nacgt-acgt\nac-tgacgt\n\n1 1 51 52 2 3 4 - 7\nac\nac\n\n2 1 1 2 nowhere 1 2 + 9\nac\nac\n")
    lengths = spark.createDataFrame([("a.1", 100), ("b.2", 50)], "seq_id string, length long")
    got = sorted(tuple(r) for r in multiple.read_axt(spark, str(tmp_path / "p.axt"), lengths, "a.", "b.").collect())
    assert got == [("a.1", 10, 12, "b.2", 20, 22), ("a.1", 13, 14, "b.2", 22, 23), ("a.1", 14, 18, "b.2", 24, 28), ("a.1", 50, 52, "b.2", -48, -46)]


def test_fasta_of_nothing_and_wrong_lengths(spark, tmp_path):
    (tmp_path / "f").write_text("no record here\n")
    with pytest.raises(OSError):
        fasta.read(spark, str(tmp_path / "f"), strict=True).count()
    (tmp_path / "g").write_text(">a one\nac gt\nNN\n>b\n>c\nt\n")
    assert fasta.read_one(spark, str(tmp_path / "g")) == "acgtNN"
    wrong = spark.createDataFrame([("a", "acgt", 3)], "seq_id string, seq string, length int")
    with pytest.raises(PySparkException):
        fasta.checked(wrong).collect()
    named = fasta.numbered(spark.createDataFrame([("cc",), ("aa",)], "seq string"), "seq").collect()
    assert {(r.seq_id, r.seq) for r in named} == {("0", "aa"), ("1", "cc")}


def test_chunks_of_long_sequences(spark):
    text = "".join("acgt"[i * i % 7 % 4] for i in range(1000))
    whole = spark.createDataFrame([("a", text), ("b", "")], "seq_id string, seq string")
    spans = spark.createDataFrame([("a", i, j) for i, j in ((0, 1), (0, 1000), (63, 65), (64, 128), (999, 1000), (5, 5))], "seq_id string, start long, stop long")
    got = {(r.start, r.stop): r.part for r in fasta.parts(fasta.chunked(whole, 64), spans, 64).collect()}
    assert got == {(i, j): text[i:j] for i, j in ((0, 1), (0, 1000), (63, 65), (64, 128), (999, 1000))}


def test_wild_codons(spark):
    x = lambda s: spark.range(1).select(sq.translate(F.lit(s)).alias("x")).first().x
    assert x("ctnCTYttyTTRatyATRtanTARnnnac") == "LXFLIXX*XX"
    rows = spark.createDataFrame([("aug",), (None,), ("",), ("é1",), ("atgc",)], "s string").select(sq.translate(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == ["M", None, "", "X", "MX"]


def test_shelves(spark, tmp_path):
    path = str(tmp_path / "shelf")
    with pytest.raises(FileNotFoundError):
        tabular.Shelf(spark, path)
    shelf = tabular.Shelf(spark, path, "c")
    shelf.put(spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"))
    tabular.Shelf(spark, path, "w").put(spark.createDataFrame([("a", 3)], "key string, value int"))
    assert tabular.Shelf(spark, path).get("a") == 3 and tabular.Shelf(spark, path).get("b") == 2
    with pytest.raises(KeyError):
        tabular.Shelf(spark, path).get("z")
    with pytest.raises(ValueError):
        tabular.Shelf(spark, path).put(spark.createDataFrame([("a", 3)], "key string, value int"))
    anew = tabular.Shelf(spark, path, "n")
    anew.put(spark.createDataFrame([("q", 3)], "key string, value int"))
    assert anew.all().count() == 1


def test_annotations_are_checked(spark):
    rows = spark.createDataFrame([(1, "a", 2, 5, -1), (2, "a", 3, 9, 1)], "id int, seq_id string, start long, stop long, orientation int")
    seqs = spark.createDataFrame([("a", "aaccggttac")], "seq_id string, seq string")
    built = annotation.build(rows, seqs)
    assert {(r.id, r.start, r.stop) for r in built.collect()} == {(1, -5, -2), (2, 3, 9)}
    assert {r.seq for r in annotation.letters(built, seqs).collect()} == {"cgg", "cggtta"}
    for bad in ([(3, "a", 5, 5, 1)], [(3, "b", 1, 5, 1)]):
        frame = spark.createDataFrame(bad, rows.schema)
        assert annotation.build(frame, seqs, strict=False).count() == 0
        with pytest.raises(PySparkException):
            annotation.build(frame, seqs).collect()
        with pytest.raises(PySparkException):
            annotation.added(built, frame, seqs).collect()
    assert annotation.added(built, spark.createDataFrame([(2, "a", 0, 1, 1)], rows.schema), seqs).where("id = 2").first().stop == 1


def test_hits_become_annotations(spark):
    hits = spark.createDataFrame([("q", 0, 30, "a", 5, 35, 30), ("q", 2, 30, "b", -40, -12, 30), ("r", 0, 12, "a", 0, 12, 30)], "src string, start long, stop long, tgt string, tgt_start long, tgt_stop long, length int")
    assert {tuple(r) for r in annotation.from_hits(hits, 5).collect()} == {("q_0", "a", 5, 35), ("q_1", "b", -40, -12)}
    assert annotation.from_hits(hits, 5, most=1, strict=False).count() == 0
    with pytest.raises(PySparkException):
        annotation.from_hits(hits, 5, most=1).collect()


def test_merging_with_a_limit_and_blocks(spark):
    kind = "src string, start long, stop long, tgt string, tgt_start long, tgt_stop long"
    aln = spark.createDataFrame([("s", 10 * i, 10 * i + 10, "t", 10 * i + 5 * (i > 4), 10 * i + 10 + 5 * (i > 4)) for i in range(10)], kind)
    assert sorted((r.start, r.stop) for r in alignment.merged(aln, 0, 5, 0, 35).collect()) == [(0, 30), (30, 60), (60, 90), (90, 100)]
    one = alignment.merged(aln, 0, 5, 0, blocks=True).collect()
    assert [[tuple(b) for b in r.blocks] for r in one] == [[(0, 50, 0, 50), (50, 100, 55, 105)]]
    two = alignment.merged(aln, 0, 0, 0, blocks=True).collect()
    assert sorted((r.start, r.stop, r.blocks) for r in two) == [(0, 50, None), (50, 100, None)]
    cut = spark.createDataFrame(one).select(alignment.clip_blocks(F.col("blocks"), F.lit(45), F.lit(60)).alias("b"), alignment.clip_blocks(F.col("blocks"), F.lit(0), F.lit(50)).alias("c")).first()
    assert [tuple(b) for b in cut.b] == [(45, 50, 45, 50), (50, 60, 55, 65)] and cut.c is None


@pytest.mark.parametrize("width", [4, 7, 1 << 16])
def test_regions_in_bins(spark, width):
    rows = [("s", "a", 0, 10), ("s", "b", 3, 20), ("s", "c", 10, 12), ("s", "a", 20, 30), ("s", "b", 20, 24), ("s", "a", 40, 41)]
    df = spark.createDataFrame(rows, "seq string, m string, start long, stop long")
    spans = lambda least: sorted((r.start, r.stop) for r in alignment.regions(df, ["seq"], "m", least, width=width).collect())
    assert spans(1) == [(0, 20), (20, 30), (40, 41)]  # all end at 20 before others begin there
    assert spans(2) == [(3, 10), (10, 12), (20, 24)]
    assert spans(3) == []
    got = sorted((r.start, r.stop, r.depth) for r in alignment.depth_regions(df, "seq", "m", 1, width=width).collect())
    assert got == [(0, 3, 1), (3, 10, 2), (10, 12, 2), (12, 20, 1), (20, 24, 2), (24, 30, 1), (40, 41, 1)]


def test_conserved_stretch(spark):
    kind = "src string, start long, tgt string, tgt_start long, src_seq string, tgt_seq string"
    df = spark.createDataFrame([("s", 100, "t", 7, "aaaacaaaagggtttt", "aaaagaaaaccctttt"), ("u", 0, "t", 0, "acac", "gtgt")], kind)
    assert {tuple(r) for r in alignment.conserved(df, 0.8).collect()} == {("s", "t", 100, 109, 7, 16)}
    assert {tuple(r) for r in alignment.conserved(df, 0.7).collect()} == {("s", "t", 100, 116, 7, 23)}
    assert alignment.conserved(df, 0.8, least_size=20).count() == 0


def test_unknown_sequences(spark):
    aln = spark.createDataFrame([("a", 1), ("b", 2)], "src string, start long")
    ids = spark.createDataFrame([("a",)], "id string")
    assert alignment.known_only(aln, ids, strict=False).count() == 1
    with pytest.raises(PySparkException):
        alignment.known_only(aln, ids).collect()


def test_graph_policies(spark):
    g = graph.Graph.of(spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (3, None, "z")], "src int, dst int, edge string"), "edge")
    assert g.edge(1, 2) == "x"
    with pytest.raises(KeyError):
        g.edge(1, 3)
    assert [(r.src, r.dst) for r in g.ordered_edges().collect()] == [(1, 2), (2, 3)]
    lone = graph.Graph(spark.createDataFrame([(1,), (2,)], "id int"), g.edges.where("dst is not null"))
    assert lone.checked("drop").edges.count() == 1 and lone.checked("add").nodes.count() == 3
    with pytest.raises(PySparkException):
        lone.checked().edges.collect()
    with pytest.raises(PySparkException):
        graph.unique_keys(spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"], "v").collect()
    assert [(r.src, r.edge) for r in graph.last_wins(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "src int, edge string, n int"), ["src"], "n").collect()] == [(1, "b")]


def test_patterns_of_several_starts(spark):
    g = graph.Graph.of(spark.createDataFrame([(1, 5), (2, 5), (3, 6), (1, 6)], "src int, dst int"))
    both = pattern.match(g, {0: {2: None}, 1: {2: None}, 2: {}}, edges=False)
    assert sorted(tuple(r[f"n_{n}"] for n in (0, 1, 2)) for r in both.collect()) == [(1, 2, 5), (1, 3, 6), (2, 1, 5), (3, 1, 6)]
    assert "CartesianProduct" not in both._jdf.queryExecution().toString() and "NestedLoop" not in both._jdf.queryExecution().toString()
    apart = pattern.match(g, {0: {1: None}, 1: {}, 2: {3: None}, 3: {}}, edges=False)
    assert apart.count() == sum(len({a, b, c, d}) == 4 for a, b in ((1, 5), (2, 5), (3, 6), (1, 6)) for c, d in ((1, 5), (2, 5), (3, 6), (1, 6)))
    seed = spark.createDataFrame([(1, 1), (1, 5)], "n_0 int, n_1 int")
    assert [tuple(r) for r in pattern.match(g, {0: {1: None}, 1: {}}, seed=seed, edges=False).collect()] == [(1, 5)]
    assert [len(b) for b in pattern.batches(both, 3)] == [3, 1]


def test_headers_of_unions():
    text = tables.write_header(".", {"a": "/x/y", "b": "/z"})
    assert tables.read_header(text) == (".", {"a": "/x/y", "b": "/z"})
    with pytest.raises(KeyError):
        tables.grown({"a": None}, "a", None)


def test_catalog(spark, tmp_path):
    people, pets = str(tmp_path / "people"), str(tmp_path / "pets")
    spark.createDataFrame([(1, "Ann"), (2, "Bo")], "pid int, name string").write.parquet(people)
    spark.createDataFrame([(7, "cat"), (8, "dog"), (9, "eel")], "tid int, kind string").write.parquet(pets)
    spark.createDataFrame([(1, 7, "x"), (1, 8, "y"), (2, 9, "z")], "src int, dst int, edge string").write.parquet(str(tmp_path / "owns"))
    zone, base = catalog.Zone(spark, str(tmp_path / "zone")), catalog.Zone(spark, str(tmp_path / "base"), writable=False)
    every = catalog.Catalog(base, zone)
    for name, path in (("Home.people", people), ("Home.pets", pets), ("Home.owns", str(tmp_path / "owns"))):
        every.writable.add(catalog.Resource(name, f"all {name}", "parquet", path, refers=("Home.people", "Home.pets") if name == "Home.owns" else ()))
    every.writable.relate(catalog.Relation("r", "Home.owns", "Home.people", "pid", "Home.pets", "tid", "pets", "owner", cardinality=catalog.ONE_TO_MANY))
    zone.commit()
    again = catalog.Catalog(base, catalog.Zone(spark, str(tmp_path / "zone")))
    assert list(again.names("Home.p")) == ["Home.people", "Home.pets"] and list(again.names("o.n", regex=True)) == ["Home.owns"]
    assert again.requires("Home.owns") == ["Home.people", "Home.pets", "Home.owns"]
    assert {(r.name, r.pets_kind) for r in again.related(again("Home.people"), "Home.people", "pets").collect()} == {("Ann", "cat"), ("Ann", "dog"), ("Bo", "eel")}
    owners = again.related(again("Home.pets"), "Home.pets", "owner", edges=True)
    assert {(r.kind, r.owner_name, r.owner_edge) for r in owners.collect()} == {("cat", "Ann", "x"), ("dog", "Ann", "y"), ("eel", "Bo", "z")}
    with pytest.raises(AttributeError):
        again.related(again("Home.pets"), "Home.pets", "pets")
    with pytest.raises(ValueError):
        zone.add(catalog.Resource("Home.x", " ", "parquet", people))
    with pytest.raises(KeyError):
        zone.add(catalog.Resource("Home.x", "x", "parquet", people, refers=("gone",)))
    with pytest.raises(ValueError):
        base.add(catalog.Resource("Home.x", "x", "parquet", people))
    zone.delete("Home.pets")
    assert "Home.pets" not in every.names()
    zone.rollback()
    assert "Home.pets" in every.names()
    zone.delete("Home.pets")
    zone.commit()
    with pytest.raises(KeyError):
        every("Home.pets")


def test_databases(spark):
    """A table of a database, written and read in ranges of its key; the database is the one that Spark brings along."""
    url, driver = "jdbc:derby:memory:strandloom;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).selectExpr("cast(id as int) as k", "concat('n', id) as name")
    try:
        rows.write.format("jdbc").options(url=url, dbtable="people", driver=driver).save()
    except Exception as e:
        if "ClassNotFound" not in str(e) and "No suitable driver" not in str(e):
            raise
        pytest.skip("no database in this installation of Spark")
    back = tabular.jdbc(spark, url, "people", "k", (0, 100), 4, driver=driver)
    assert back.rdd.getNumPartitions() == 4 and {(r.k, r.name) for r in back.collect()} == {(i, f"n{i}") for i in range(100)}
    assert tabular.jdbc(spark, url, "people", driver=driver).count() == 100


def test_relational_dump_of_blocks(spark, tmp_path):
    (tmp_path / "m").write_text("##maf version=1\n\na score=1\ns x.1 10 6 + 100 ac--gtta\ns y.2 5 8 - 50 acacgtta\n")
    multiple.save_relational(multiple.read_maf(spark, str(tmp_path / "m")), str(tmp_path / "out"))
    assert [(r["length"], r["rows"]) for r in spark.read.parquet(str(tmp_path / "out/blocks")).collect()] == [(8, 2)]
    assert {(r.start, r.stop, r.tgt, r.tgt_start) for r in spark.read.parquet(str(tmp_path / "out/runs")).collect()} == {(0, 2, "x.1", 10), (4, 8, "x.1", 12), (0, 8, "y.2", -45)}

"""Scans and sinks on small files."""

import gzip

import pytest

from graphsieve.sources import readers, sinks

GCT = "#1.2\n3\t2\nName\tDescription\tLiver\tLiver - left\tLung\nE1\tG1\t5\t0.5\t1\nE2\tG2\tx\t3\t1\nE3\tG1\t0.5\t0.1\t9\nE4\t\t7\t7\t7\nE5\tG3\t1\t1\t1\n"


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        return str(p)

    return write


def test_mapping(spark, put):
    path = put("m.csv", "# note\n\nP1,MDR1\nP2,AKT1\nP2,AKT2\nP3,a,b\nP4\n")
    assert {r[0]: r[1] for r in readers.mapping(spark, path).collect()} == {"P1": "ABCB1", "P2": "AKT2"}


def test_csv_and_tsv(spark, put):
    assert readers.csv(spark, put("t.csv", "compound,protein_id,source\nA,P1,x\n"), readers.TARGETS).first()["protein_id"] == "P1"
    assert readers.csv(spark, put("t.tsv", "a\tb\n1\t2\n"), "a int, b int", "\t").first()["b"] == 2
    with pytest.raises(FileNotFoundError):
        readers.many(spark, {put("u.csv", "a\n1\n"): "a int", "/nowhere/x.csv": "a int"})


def test_expression(spark, put):
    path = put("g.gct", GCT)
    assert {r[0]: r[1] for r in readers.expression(spark, path).collect()} == {"G1": 0.5, "G3": 1.0}
    assert {r[0]: r[1] for r in readers.expression(spark, path, at_least=1.0).collect()} == {"G1": 5.0, "G3": 1.0}
    assert sorted(r[0] for r in readers.expressed(spark, path).collect()) == ["", "G1", "G2"]
    assert "G3" in {r[0] for r in readers.expressed(spark, path, inclusive=True).collect()}
    for f in (lambda: readers.expression(spark, path, "Heart"), lambda: readers.expressed(spark, path, "Heart")):
        with pytest.raises(ValueError):
            f()


def test_edges_and_names(spark, put):
    path = put("e.txt.gz", "protein1 protein2 combined_score\n9606.A 9606.B 900\n9606.A 9606.C 300\n")
    assert [tuple(r) for r in readers.edges(spark, path, 700).collect()] == [("9606.A", "9606.B", 900)]
    info = put("i.txt.gz", "#string_protein_id\tpreferred_name\tx\n9606.A\tGA\t1\n10090.B\tGB\t2\n")
    assert [tuple(r) for r in readers.names(spark, info, "9606.").collect()] == [("A", "GA")]
    assert readers.names(spark, info).count() == 2


def test_cache_round_trip(spark, put, tmp_path):
    df = spark.createDataFrame([("a", "CC"), ("b", None)], "name string, smiles string")
    sinks.cache(df, str(tmp_path / "c"))
    assert {r[0]: r[1] for r in readers.cache(spark, str(tmp_path / "c")).collect()} == {"a": "CC", "b": ""}
    assert {r[0]: r[1] for r in readers.cache(spark, put("whole.json", '{\n  "a": "CC",\n\n  "b": ""\n}\n')).collect()} == {"a": "CC", "b": ""}
    assert readers.cache(spark, put("bad.json", "{oops")).count() == 0
    assert readers.cache(spark, str(tmp_path / "none")).count() == 0


def test_pointer_and_fallback(spark, put):
    p = put("p.parquet", "version https://git-lfs.github.com/spec/v1\noid sha256:1\nsize 9\n")
    assert readers.is_pointer(spark, p) and not readers.is_pointer(spark, put("q.txt", "x"))
    g = put("genes.csv", "gene_name,score\nB,1\nA,2\nA,3\n")
    assert sorted(r[0] for r in readers.gene_set(spark, "/nowhere/x.csv", g).collect()) == ["A", "B"]
    with pytest.raises(FileNotFoundError):
        readers.gene_set(spark, "/nowhere/x.csv")


def test_severity_list(spark, put):
    path = put("s.csv", "a title\nLTKBID,CompoundName,SeverityClass,LabelSection,vDILI-Concern,Comment\nL1,foo,8,Box, vMost-DILI-Concern ,\nL2,bar,0,No,vNo-DILI-concern,x\n")
    assert [r["category"] for r in readers.severity_list(spark, path).orderBy("LTKBID").collect()] == ["vmost-dili-concern", "vno-dili-concern"]


def test_graph_and_sinks(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 0.5)], "protein1 string, protein2 string, weight double")
    sinks.parquet(e, str(tmp_path / "e"), 1)
    assert readers.graph(spark, str(tmp_path / "e")).columns == ["src", "dst", "weight"]
    sinks.csv(e, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "a string, b string, w double").first()["w"] == 0.5
    assert "| a | b | 0.5 |" in sinks.markdown("t", {"s": e})
    assert readers.union([e, e.drop("weight")]).count() == 2
    targets = spark.createDataFrame([("A", "g2"), ("A", "g1"), ("A", "g1"), ("B", "g3")], "compound string, gene_symbol string")
    assert [r[0] for r in readers.target_set(targets, "A").collect()] == ["g1", "g2"]

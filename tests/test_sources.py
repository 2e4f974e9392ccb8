import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospan.sources import binary as B
from aerospan.sources import text as S

WITNESS = """# comment
HEADER
VELOX NOT WRITTEN . COLUMN 1
PRESS NOT WRITTEN . COLUMN 2
NUMVARIABLES: 2
NUMSETS: 2
START
# Iterations = 5
# Time = 0.5
 1.0 2.0
 3.0 4.0
# Iterations = 6
# Time = 0.75
 5.0 6.0
 7.0 8.0
"""


def test_witness(spark, tmp_path):
    (tmp_path / "a.wit").write_text(WITNESS.replace("VELOX NOT WRITTEN . COLUMN 1", "name VELOX a b c 1").replace("PRESS NOT WRITTEN . COLUMN 2", "name PRESS a b c 2"))
    got = {(r.iter, r.wit_id, r.var): (r.time, r.value) for r in S.witness(spark, str(tmp_path)).collect()}
    assert got[5, 1, "VELOX"] == (0.5, 3.0) and got[6, 0, "PRESS"] == (0.75, 6.0) and len(got) == 8


def test_tiles_and_bounds(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/UGT-3.csv").write_text("1,2\n3,4\n")
    (tmp_path / "t/VGT-3.csv").write_text("9,9\n")
    got = {(r.key, r.i, r.j): r.v for r in S.tiles(spark, str(tmp_path / "t"), "UGT").collect()}
    assert got == {(3, 0, 0): 1.0, (3, 0, 1): 2.0, (3, 1, 0): 3.0, (3, 1, 1): 4.0}
    (tmp_path / "gcp.csv").write_text("min_x,max_x,min_y,max_y\n0,1,2,3\n")
    assert tuple(S.bounds(spark, str(tmp_path / "gcp.csv")).first()) == (0.0, 1.0, 2.0, 3.0)


def test_solids(spark, tmp_path):
    text = "solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid a\n"
    (tmp_path / "a.stl").write_text(text)
    v = np.zeros(1, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    v["v"][0] = [[0, 0, 1], [1, 0, 1], [0, 1, 1]]
    (tmp_path / "b.stl").write_bytes(bytes(80) + (1).to_bytes(4, "little") + v.tobytes())
    got = {r.file.rsplit("/", 1)[1]: r.p for r in S.solids(spark, str(tmp_path)).collect()}
    assert got == {"a.stl": [[0, 0, 0], [1, 0, 0], [0, 1, 0]], "b.stl": [[0, 0, 1], [1, 0, 1], [0, 1, 1]]}


def test_signal_stops_at_the_first_gap(spark, tmp_path):
    (tmp_path / "s.csv").write_text("t;a;u;b\n0;1;0;5\n1;2;1;6\n2;nan;2;7\n3;4;3;8\n")
    got = [(r.t, r.y) for r in S.signal(spark, str(tmp_path / "s.csv"), 0, 1).orderBy("i").collect()]
    assert got == [(0.0, 1.0), (1.0, 2.0)]


def test_wkt(spark):
    rows = [("POINT (1 2)", [[(1.0, 2.0)]]), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", [[(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 5)]])]
    df = spark.createDataFrame([(w,) for w, _ in rows], "w string")
    got = [[[tuple(p) for p in ring] for ring in r[0]] for r in df.select(S.wkt_rings(F.col("w"))).collect()]
    assert got == [want for _, want in rows]
    assert df.select(F.size(S.closed(F.get(S.wkt_rings(F.col("w")), F.lit(0))))).collect()[1][0] == 3


def test_points_and_lines(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("0 0 0\n1 2.5 3\n\n")
    assert [tuple(r) for r in S.points(spark, str(tmp_path / "p.xyz")).collect()] == [(0.0, 0.0, 0.0), (1.0, 2.5, 3.0)]
    pairs = spark.createDataFrame([(1, 5)], "master int, slave int")
    assert S.pair_lines(pairs, False).first()[0] == "5 1"


def test_xdmf_is_xml():
    import xml.etree.ElementTree as ET

    doc = S.xdmf([0.0, 1.5], "Quadrilateral", 4, 4, 9, {"P": 1, "U": 3, "R": 9}, ["a.h5", "b.h5"])
    root = ET.fromstring(doc)
    assert [a.get("AttributeType") for a in root.iter("Attribute")] == ["Scalar", "Vector", "Tensor"] * 2


def test_field_files(spark, tmp_path):
    spark.dataSource.register(B.FieldSource)
    rows = np.arange(30.0).reshape(10, 3)
    B.write_file(str(tmp_path / "a.fld"), rows, Object="VELOC", Time=1.5)
    df = spark.read.format("aerospan_field").option("rows", 4).load(str(tmp_path / "*.fld"))
    assert df.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in df.orderBy("row").select("c0", "c2").collect()] == [(x[0], x[2]) for x in rows.tolist()]
    assert B.edit_header(str(tmp_path / "a.fld"), Time=2.0)["Time"] == 2.0
    assert df.count() == 10
    with pytest.raises(KeyError):
        B.edit_header(str(tmp_path / "a.fld"), Nothing=1)
    df.select("c0", "c1").write.format("aerospan_field").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("aerospan_field").load(f"{tmp_path}/out/*.fld").count() == 10


def test_geometry_coordinates(spark, tmp_path):
    (tmp_path / "a.geo").write_text("NODES\n 1 2\nEND\n COORDINATES\n 1 0.12345678 -1.0 2\n 2 1e-3 4 5\n END_COORDINATES\n 7 7 7 7\n")
    got = {r.node_id: r.xs for r in S.geometry_coordinates(spark, str(tmp_path / "a.geo")).collect()}
    assert got == {1: [0.123457, -1.0, 2.0], 2: [0.001, 4.0, 5.0]}
    (tmp_path / "b.geo").write_text("1 2 3\n")
    assert S.geometry_coordinates(spark, str(tmp_path / "b.geo")).count() == 0


def test_off_round_trip(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF\n# a comment\n4 2 0\n\n0 0 0\n1 0 0 # corner\n1 1 0\n0 1 0.5\n3 0 1 2\n4 0 1 2 3\n")
    nodes, elements = S.off_mesh(spark, str(tmp_path / "a.off"))
    assert sorted(map(tuple, nodes.collect())) == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.5)]
    assert sorted((r.elem_id, r.nodes) for r in elements.collect()) == [(0, [0, 1, 2]), (1, [0, 1, 2, 3])]
    lines = [r.value for r in S.off_lines(nodes, elements).orderBy("k").collect()]
    assert lines[:3] == ["OFF", "4 2 0", "0.000000 0.000000 0.000000"] and lines[-1] == "4 0 1 2 3"
    (tmp_path / "b.off").write_text("\n".join(lines))
    again = S.off_mesh(spark, str(tmp_path / "b.off"))
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted(r.nodes for r in again[1].collect()) == sorted(r.nodes for r in elements.collect())

import pytest

from facetspark.sources import config, text


def test_surface(spark, tmp_path):
    (tmp_path / "m_0.wrl").write_text("#VRML\nTriangle {\n point [\n 0 0 0,\n 1 0 0,\n 0 1 0,\n ]\n# Normal definition\n vector [\n0 0 1,\n0 0 1,\n0 0 1,\n]\nIndexedFaceSet\ncoordIndex [\n 0, 1, 2, -1,\n]\n")
    vertices, triangles = text.read_surface(spark, str(tmp_path))
    assert [tuple(r) for r in vertices.orderBy("v").select("mol_id", "v", "x", "y", "nz").collect()] == [(0, 0, 0, 0, 1), (0, 1, 1, 0, 1), (0, 2, 0, 1, 1)]
    assert tuple(triangles.first()) == (0, 0, 0, 1, 2)


def test_rows_round_trip_and_stop_at_the_first_bad_one(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.5, 2), (0, 1, -2.0, 3)], "mol_id int, n int, x double, k int")
    text.write_rows(df, f"{tmp_path}/out", ["x", "k"], ["n"])
    (tmp_path / "p_7.ch").write_text("1 2 3 0.5 ;\n[4, 5, 6] -1;\nbad row ;\n7 8 9 1 ;\n")
    got = text.read_rows(spark, f"{tmp_path}/p_7.ch", "x double, y double, z double, charge double").collect()
    assert [(r["mol_id"], r["n"], r["z"], r["charge"]) for r in got] == [(7, 0, 3, 0.5), (7, 1, 6, -1)]
    back = text.read_rows(spark, f"{tmp_path}/out/mol_id=0/*.txt", "x double, k int")
    assert sorted((r["x"], r["k"]) for r in back.collect()) == [(-2.0, 3), (1.5, 2)]


def test_matrix(spark, tmp_path):
    (tmp_path / "a.pmd").write_text("1 0 2 \n0 3 0 \n")
    md = text.read_matrix(spark, f"{tmp_path}/a.pmd")
    assert {(r[0], r[1]): r[2] for r in md.collect() if r[2]} == {(0, 0): 1, (0, 2): 2, (1, 1): 3}
    text.write_matrix(md.withColumn("cnt", md["cnt"].cast("int")), f"{tmp_path}/out", [0, 1, 2])
    assert sorted(r["cnt"] for r in text.read_matrix(spark, f"{tmp_path}/out").collect()) == [0, 0, 0, 1, 2, 3]
    (tmp_path / "b.pmd").write_text("1 0\n1\n")
    with pytest.raises(ValueError):
        text.read_matrix(spark, f"{tmp_path}/b.pmd")


def test_mol_and_tags(spark, tmp_path):
    mol = "name\n\n\n  2  1  0\n    0.0000    1.5000    0.0000 C   0\n    1.0000    0.0000    0.0000 N   0\n  1  2  2  0\n> <ACT>\n3.25\n> <ACT>\n-1\n"
    (tmp_path / "x_3.mol").write_text(mol)
    atoms, bonds = text.read_mol(spark, str(tmp_path))
    assert [(r["i"], r["y"], r["elem"]) for r in atoms.orderBy("i").collect()] == [(1, 1.5, "C"), (2, 0.0, "N")]
    assert tuple(bonds.first()) == (3, 1, 2, 2)
    values = text.tag_values(text.lines(spark, str(tmp_path)), "<ACT>")
    assert [r["value"] for r in values.orderBy("n").collect()] == [3.25, -1.0]
    assert [r["y"] for r in text.threshold_classes(values, 0.0).orderBy("n").collect()] == [1, -1]


def test_objects_are_counted_up_to_a_gap(spark, tmp_path):
    for n in (0, 1, 2, 4):
        (tmp_path / f"s_{n}.wrl").write_text("x")
    assert text.count_objects(spark, f"{tmp_path}/*.wrl") == 3


def test_options():
    got = config.Options.parse(["-levels", "12", "-detector", "log", "-alpha"])
    assert (got.levels, got.detector, got.alpha) == (12, "log", 0.05)
    with pytest.raises(ValueError):
        config.Options.parse(["areas", "3"])
    assert config.parse_intervals("distance = mid // kind\na=0:2.5\n b = 2.5:9 // far\n") == ("mid", [("a", 0.0, 2.5), ("b", 2.5, 9.0)])
    with pytest.raises(ValueError):
        config.parse_keys("a=1")
    assert config.settings_name("m_", 7, 205, "wrl") == "m_007.wrl"

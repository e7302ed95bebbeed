"""The shapefile source on archives made here."""

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotespark.functions import geometry as G
from lotespark.sources import feeds, shapefile

UTM22S = 'PROJCS["SIRGAS_2000_UTM_Zone_22S",GEOGCS["GCS_SIRGAS_2000",DATUM["D_SIRGAS_2000",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",10000000.0],PARAMETER["Central_Meridian",-51.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
FIELDS = [("CD_SETOR", "C", 16, 0), ("POP", "N", 10, 0), ("AREA", "N", 12, 3), ("DIA", "D", 8, 0), ("OK", "L", 1, 0)]


def record(kind, rings):
    if rings is None:
        return struct.pack("<i", 0)
    xy = [p for r in rings for p in r]
    firsts = np.cumsum([0, *map(len, rings)])[:-1]
    return struct.pack("<i4d2i", kind, *(0.0,) * 4, len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *firsts.tolist()) + b"".join(struct.pack("<2d", *p) for p in xy)


def layer_files(rows, kind=5, prj="", cpg="UTF-8", deleted=()):
    """The files of a layer, by ending. rows: values of FIELDS and rings."""
    body, index, at = b"", b"", 50
    for k, (*_, rings) in enumerate(rows):
        c = record(kind, rings)
        body += struct.pack(">2i", k + 1, len(c) // 2) + c
        index += struct.pack(">2i", at, len(c) // 2)
        at += 4 + len(c) // 2
    head = struct.pack(">i20xi", 9994, at) + struct.pack("<2i8d", 1000, kind, *(0.0,) * 8)
    heading = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([size, dec]) + bytes(14) for n, t, size, dec in FIELDS) + b"\r"
    table = struct.pack("<4BI2H20x", 3, 124, 1, 1, len(rows), 32 + len(heading), 1 + sum(f[2] for f in FIELDS)) + heading
    for k, (*values, _) in enumerate(rows):
        table += (b"*" if k in deleted else b" ") + b"".join((v or "").encode().ljust(f[2]) if f[1] != "N" else (v or "").encode().rjust(f[2]) for v, f in zip(values, FIELDS))
    return {".shp": head + body, ".shx": head + index, ".dbf": table, ".prj": prj.encode(), ".cpg": cpg.encode()}


def box(x, y, w, clockwise=True):
    ring = [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]
    return ring if clockwise else ring[::-1]


ROWS = [
    ("510840205000001P", "123", "10.500", "20240131", "T", [box(0, 0, 4), box(1, 1, 1, False)]),
    ("São João", "", "", "", "?", [box(0, 0, 1), box(10, 0, 5), box(11, 1, 1, False), box(13, 3, 1, False)]),
    ("", "999999999", "-1.25", "2024", "F", None),
    ("gone", "1", "1", "", "T", [box(0, 0, 1)]),
]


def write_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, files in members.items():
            for ending, data in files.items():
                z.writestr(name + ending, data)


def test_an_archive_is_a_table(spark, tmp_path):
    shapefile.register(spark)
    write_zip(tmp_path / "MT.zip", {"a/5108402_setores": layer_files(ROWS, deleted=(3,)), "a/5103403_setores": layer_files(ROWS[:1])})
    df = spark.read.format("shapefile").option("path", str(tmp_path / "MT.zip")).load()
    assert df.columns == ["layer", "row", "CD_SETOR", "POP", "AREA", "DIA", "OK", "geometry"] and df.rdd.getNumPartitions() == 2
    got = {r.row: r for r in df.where("layer LIKE '5108402%'").collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[0].CD_SETOR, got[0].POP, got[0].AREA, str(got[0].DIA), got[0].OK) == ("510840205000001P", 123, 10.5, "2024-01-31", True)
    assert (got[1].CD_SETOR, got[1].POP, got[1].AREA, got[1].DIA, got[1].OK) == ("São João", None, None, None, None)
    assert (got[2].CD_SETOR, got[2].POP, got[2].AREA, got[2].DIA, got[2].OK, got[2].geometry) == (None, 999999999, -1.25, None, False, None)
    assert [[len(r) for r in part] for part in got[1].geometry] == [[5], [5, 5, 5]] and [len(part) for part in got[0].geometry] == [2]
    area = df.where("layer LIKE '5108402%'").select("row", F.aggregate("geometry", F.lit(0.0), lambda s, p: s + G.area(p)).alias("a"))
    assert {r.row: r.a for r in area.collect()} == {0: 15.0, 1: 24.0, 2: None}


def test_columns_and_layers_are_chosen(spark, tmp_path):
    shapefile.register(spark)
    write_zip(tmp_path / "MT.zip", {"5108402_x": layer_files(ROWS), "5103403_x": layer_files(ROWS)})
    read = lambda **o: spark.read.format("shapefile").options(path=str(tmp_path), **o).load()
    df = read(match="5108402*", columns="POP,CD_SETOR")
    assert df.columns == ["POP", "CD_SETOR"] and df.count() == 4 and df.rdd.getNumPartitions() == 1
    sectors = feeds.census_sectors(read(match="5108402*").withColumn("CD_MUN", F.lit("5108402")), "5108402")
    assert {(r.setor_id, r.pop_total) for r in sectors.collect()} == {("510840205000001", 123), ("São João", None), (None, 999999999), ("gone", 1)}
    with pytest.raises(Exception, match="no layer matches"):
        read(match="nothing*").count()


def test_bare_files_are_split_and_lines_read(spark, tmp_path, monkeypatch):
    rows = [(f"F{k}", str(k), "", "", "", [[(k, 0.0), (k + 1, 1.0)], [(k, 2.0), (k, 3.0), (k, 4.0)]]) for k in range(50)]
    for ending, data in layer_files(rows, kind=3).items():
        (tmp_path / f"ruas{ending}").write_bytes(data)
    monkeypatch.setattr(shapefile, "RANGE", 20)
    monkeypatch.setattr(shapefile, "BATCH", 7)
    parts = shapefile.layers(str(tmp_path))
    assert [(p.first, p.last) for p in parts] == [(0, 20), (20, 40), (40, 50)]
    got = [(a, g) for p in parts for (pop, shape), n in shapefile.read_layer(p, ["POP", "geometry"]) for a, g in zip(pop.to_pylist(), shape.to_pylist())]
    assert [a for a, _ in got] == list(range(50))
    assert all([[(q["x"], q["y"]) for q in line] for part in g for line in part] == [[tuple(map(float, q)) for q in line] for line in rows[a][-1]] for a, g in got)


def test_projected_layers_come_in_degrees(spark, tmp_path):
    shapefile.register(spark)
    places = [(-51.0, -15.6), (-53.9, -1.2), (-48.3, -33.7), (-49.123456, -22.5)]
    flat = [spark.range(1).select(G.utm(F.lit(x), F.lit(y), 22).alias("p")).first().p for x, y in places]
    ring = [(p.x, p.y) for p in flat]
    write_zip(tmp_path / "utm.zip", {"utm": layer_files([("a", "1", "", "", "", [ring + ring[:1]])], kind=3, prj=UTM22S)})
    got = spark.read.format("shapefile").option("path", str(tmp_path / "utm.zip")).load().first().geometry[0][0]
    assert np.allclose([(p.x, p.y) for p in got], places + places[:1], atol=1e-8)
    with pytest.raises(ValueError, match="no reader"):
        shapefile.projection('PROJCS["x",PROJECTION["Lambert"]]')

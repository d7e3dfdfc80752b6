import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from laserloom.operators.grid import GridRef
from laserloom.sources import ascgrid, binary, dbf, envi, shapefile


def test_asc_round_trip(spark, tmp_path):
    ref = GridRef(99.5, 210.5, 1.0, -1.0, 3, 2)
    r = spark.createDataFrame([(1, 1, 1.25), (1, 2, 2.0), (2, 1, None), (3, 2, -4.5)], "row int, col int, value double")
    path = ascgrid.write_asc(r, ref, str(tmp_path / "g.txt"), precision=3)
    assert path.endswith("g.asc") and ascgrid.asc_ref(path) == ref
    lines = open(path).read().splitlines()
    assert lines[0] == "ncols 2" and lines[6] == "1.250 2.000" and lines[8] == "-9999.000 -4.500"
    got = {(x.row, x.col): x.value for x in spark.read.format("ascgrid").load(path).collect()}
    assert got == {(1, 1): 1.25, (1, 2): 2.0, (2, 1): None, (2, 2): None, (3, 1): None, (3, 2): -4.5}


def test_asc_errors(tmp_path):
    p = tmp_path / "x.asc"
    p.write_text("rows 1\n")
    with pytest.raises(ValueError):
        ascgrid.asc_header(str(p))
    with pytest.raises(ValueError):
        ascgrid.asc_header(str(tmp_path / "x.txt"))


def test_dbf_round_trip(spark, tmp_path):
    rows = [(1, 1.5, "äb", True, dt.date(2020, 2, 29)), (None, None, None, None, None), (-3, -0.000001, "x", False, dt.date(1999, 1, 1))]
    d = spark.createDataFrame(rows, "n long, f double, t string, l boolean, d date").coalesce(1)
    path = str(tmp_path / "t.dbf")
    dbf.write_dbf(d, path)
    got = [tuple(r)[1:] for r in dbf.read_dbf(spark, path).orderBy("record_number").collect()]
    assert got == [(1.0, 1.5, "äb", True, dt.date(2020, 2, 29)), (None,) * 5, (-3.0, -0.000001, "x", False, dt.date(1999, 1, 1))]
    assert dbf.read_dbf(spark, path, records=[3, 9], columns=["t", 1]).columns == ["record_number", "n", "t"]
    assert dbf.read_dbf(spark, path, records=[3, 9]).count() == 1
    i = dbf.dbf_info(spark, path).first()
    assert (i.nrec, i.ncols, i.version) == (3, 5, 3)
    raw = bytearray(open(path, "rb").read())
    raw[dbf.dbf_header(path)["start"]] = ord("*")
    open(path, "wb").write(raw)
    assert dbf.read_dbf(spark, path).count() == 2 and dbf.read_dbf(spark, path, erased=True).count() == 3


def test_dbf_names_must_stay_unique(spark, tmp_path):
    with pytest.raises(ValueError):
        dbf.describe(spark.createDataFrame([(1, 2)], "abcdefghijk int, abcdefghijl int").schema, {})


def test_shapefile_points(spark, tmp_path):
    d = spark.createDataFrame([([[(10.0, 20.0)]], "Attribute1", "AttributeA"), ([[(11.0, 25.0)]], "Attribute2", "AttributeB")], "parts array<array<struct<x:double,y:double>>>, attr_1 string, attr_Z string").coalesce(1)
    path = str(tmp_path / "p.shp")
    shapefile.write_shapefile(d, path, "Point")
    assert (tmp_path / "p.shx").stat().st_size == 116 and (tmp_path / "p.shp").stat().st_size == 156
    got = shapefile.read_shapefile(spark, path).orderBy("record_number").collect()
    assert [(r.geometry, r.parts[0][0].x, r.parts[0][0].y, r.attr_1, r.attr_Z) for r in got] == [("Point", 10, 20, "Attribute1", "AttributeA"), ("Point", 11, 25, "Attribute2", "AttributeB")]


def test_shapefile_points_with_z_and_m_have_the_documented_size(spark, tmp_path):
    d = spark.createDataFrame([([[(10.0, 20.0, 30.0, -1.0)]],), ([[(11.0, 25.0, 32.0, -2.0)]],)], "parts array<array<struct<x:double,y:double,z:double,m:double>>>").coalesce(1)
    shapefile.write_shapefile(d, str(tmp_path / "p.shp"), "Point", z=True)
    assert (tmp_path / "p.shp").stat().st_size == 188 and (tmp_path / "p.shx").stat().st_size == 116


def test_shapefile_lines_with_z_and_m(spark, tmp_path):
    one = [[(10.0, 20.0, 30.0, -1.0), (110.0, 120.0, 130.0, 1.0)], [(9.0, 19.0, 29.0, -11.0), (109.0, 119.0, 129.0, 11.0)]]
    two = [[(11.0, 25.0, 32.0, -2.0), (111.0, 125.0, 132.0, None), (211.0, 225.0, 232.0, -3.0)], [(11.0, 24.0, 31.0, -22.0), (110.0, 124.0, 131.0, 22.0)], [(12.0, 26.0, 33.0, -33.0), (200.0, 200.0, 200.0, 33.0)]]
    d = spark.createDataFrame([(one, "Attribute1"), (two, "Attribute2")], "parts array<array<struct<x:double,y:double,z:double,m:double>>>, attr_1 string").coalesce(1)
    path = str(tmp_path / "l.shp")
    shapefile.write_shapefile(d, path, "Line", z=True)
    assert (tmp_path / "l.shp").stat().st_size == 640 and (tmp_path / "l.shx").stat().st_size == 116
    r = shapefile.read_shapefile(spark, path, records=[2]).first()
    assert [[tuple(v) for v in p] for p in r.parts] == two
    assert tuple(r.bbox)[:4] == (11.0, 24.0, 211.0, 225.0)


def test_shapefile_polygons_of_stands(spark, small, tmp_path):
    s = spark.read.parquet(f"{small}/stands.parquet")
    path = str(tmp_path / "s.shp")
    shapefile.write_shapefile(shapefile.from_stands(s), path, "Polygon")
    got = shapefile.read_shapefile(spark, path)
    assert got.count() == s.count()
    want = {r.stand_id: sum(v == v for v in r.x) for r in s.collect()}
    assert {int(r.stand_id): sum(map(len, r.parts)) for r in got.collect()} == want
    b = s.orderBy("stand_id").first()
    inside = shapefile.read_shapefile(spark, path, box=(b.xmin, b.ymin, b.xmax, b.ymax), clip=True)
    for r in inside.collect():
        for p in r.parts:
            assert all(b.xmin - 1e-9 <= v.x <= b.xmax + 1e-9 and b.ymin - 1e-9 <= v.y <= b.ymax + 1e-9 for v in p)


def test_sbet_round_trip_in_ranges(spark, small, tmp_path):
    s = spark.read.parquet(f"{small}/sbet.parquet").dropna().orderBy("rec_id").select(*binary.SBET_FIELDS)
    path = str(tmp_path / "a.sbet")
    s.coalesce(2).write.format("sbet").mode("append").save(path)
    got = spark.read.format("sbet").option("recordsPerPartition", 100).load(path).drop("file")
    assert got.exceptAll(s).count() == 0 and got.count() == s.count()
    assert got.rdd.getNumPartitions() > 1
    (tmp_path / "bad.sbet").write_bytes(b"123")
    with pytest.raises(Exception):
        spark.read.format("sbet").load(str(tmp_path / "bad.sbet")).count()


def test_trj_quality(spark, tmp_path):
    r = np.zeros(3, binary.TRJ_RECORD)
    r["time"], r["x"], r["qty_xy"], r["qty_h"], r["mark"] = [1, 2, 3], [1.5, 2.5, 3.5], 4, 4, 7
    p = tmp_path / "a.trj"
    p.write_bytes(binary.trj_bytes({"desc": b"test", "number": 12}, r))
    got = spark.read.format("trj").load(str(p)).orderBy("time").collect()
    assert [x.x for x in got] == [1.5, 2.5, 3.5] and abs(got[0].qty_xy - 0.008) < 1e-12 and abs(got[0].qty_h - 0.0008) < 1e-12 and got[0].mark == 7
    h = binary.trj_headers(spark, str(p)).first()
    assert (h.desc, h.number, h.pos_cnt, h.pos_size) == ("test", 12, 3, 64)
    p.write_bytes(b"x" * 2000)
    with pytest.raises(ValueError):
        binary.trj_header(str(p))


@pytest.mark.parametrize("fmt", [0, 3, 6, 7])
def test_las_round_trip(spark, small, tmp_path, fmt):
    p = spark.read.parquet(f"{small}/points.parquet").dropna().distinct().where("z between 0 and 9000 and intensity between 0 and 65535 and return_number > 0 and classification < 32")
    path = str(tmp_path / "a.las")
    binary.write_las(p, path, pointFormat=fmt, scale=0.01)
    got = spark.read.format("las").load(path)
    assert got.count() == p.count()
    h = binary.las_headers(spark, path).first()
    assert h.n == p.count() and h.point_data_format_id == fmt and abs(h.max_z - p.agg(F.max("z")).first()[0]) < 1e-6
    cols = ["return_number", "number_of_returns", "classification", "point_source_id"] + (["gps_time"] if fmt else []) + (["red", "green", "blue"] if fmt in (3, 7) else [])
    key = lambda d: d.select(*[F.round(k, 2).alias(k) for k in "xyz"], *cols)
    assert key(got).exceptAll(key(p)).count() == 0


def test_envi(spark, tmp_path):
    p = tmp_path / "a.hdr"
    p.write_text("ENVI\r\nsamples = 10\r\nbands = 3\ndefault bands = {1, 2,\n 3}\nband names = {Red, Green}\ndata type = 12\ninterleave = bsq\nsensor type =\n")
    r = envi.read_envi(spark, str(p)).first()
    assert (r.samples, r.bands, r.default_bands, r.band_names, r.data_type_name, r.interleave, r.sensor_type) == (10, 3, [1, 2, 3], ["Red", "Green"], "uint16", "bsq", None)

"""Shapefiles: geometries by ranges of the index, attributes by record number."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from laserloom.sources import dbf
from laserloom.sources.common import Part, Range, delete, exists, expand, ranges, read_bytes, resolve, size_of, write_bytes

#: Shape types; +10 has Z (and M), +20 has M.
KINDS = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint", 31: "MultiPatch"}
CODES = {"point": 1, "line": 3, "polyline": 3, "polygon": 5, "multipoint": 8}
NO_M = -1e39  # M values below are no data
VERTEX = T.StructType([T.StructField(k, T.DoubleType()) for k in "xyzm"])
BBOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("xmin", "ymin", "xmax", "ymax", "zmin", "zmax", "mmin", "mmax")])
SCHEMA = T.StructType([
    T.StructField("record_number", T.LongType()), T.StructField("geometry", T.StringType()), T.StructField("bbox", BBOX),
    T.StructField("parts", T.ArrayType(T.ArrayType(VERTEX))), T.StructField("part_types", T.ArrayType(T.IntegerType())), T.StructField("file", T.StringType()),
])


def shp_header(path: str) -> dict:
    b = read_bytes(path, 0, 100)
    if len(b) < 100 or struct.unpack_from(">i", b)[0] != 9994:
        raise ValueError(f"{path} is no shapefile")
    return {"type": struct.unpack_from("<i", b, 32)[0], **dict(zip(("xmin", "ymin", "xmax", "ymax", "zmin", "zmax", "mmin", "mmax"), struct.unpack_from("<8d", b, 36)))}


def index(path: str) -> list[tuple[int, int]]:
    """(offset, length) of the content of each record, from the .shx, or by stepping through the .shp."""
    shx = path[:-4] + (".shx" if path.endswith("p") else ".SHX")
    if exists(shx):
        raw = np.frombuffer(read_bytes(shx, 100), ">i4").reshape(-1, 2)
        return [(int(o) * 2 + 8, int(n) * 2) for o, n in raw]
    out, at, end = [], 100, size_of(path)
    while at + 8 <= end:
        n = struct.unpack(">ii", read_bytes(path, at, 8))[1] * 2
        out.append((at + 8, n))
        at += 8 + n
    return out


def decode(b: bytes) -> dict | None:
    """One record's geometry; None for the null shape. Whether M is there follows from the length."""
    code = struct.unpack_from("<i", b)[0]
    base = code % 10 if code != 31 else 31
    if code == 0:
        return None
    has_z = code in (11, 13, 15, 18, 31)
    m_only = code in (21, 23, 25, 28)
    if base == 1:
        v = struct.unpack_from(f"<{(len(b) - 4) // 8}d", b, 4)
        x, y = v[:2]
        z = v[2] if has_z and len(v) > 2 else None
        m = (v[3] if has_z and len(v) > 3 else v[2] if m_only and len(v) > 2 else None)
        m = None if m is None or m < NO_M else m
        return {"geometry": "Point", "bbox": (x, y, x, y, z, z, m, m), "parts": [[(x, y, z, m)]], "part_types": None}
    box = struct.unpack_from("<4d", b, 4)
    types = None
    if base == 8:
        n, at, starts = struct.unpack_from("<i", b, 36)[0], 40, [0]
    else:
        k, n = struct.unpack_from("<ii", b, 36)
        starts, at = list(struct.unpack_from(f"<{k}i", b, 44)), 44 + 4 * k
        if base == 31:
            types, at = list(struct.unpack_from(f"<{k}i", b, at)), at + 4 * k
    xy = np.frombuffer(b, "<f8", 2 * n, at).reshape(-1, 2)
    at += 16 * n
    z = m = None
    zr = mr = (None, None)
    if has_z:
        zr = struct.unpack_from("<2d", b, at)
        z, at = np.frombuffer(b, "<f8", n, at + 16), at + 16 + 8 * n
    if (has_z or m_only) and len(b) >= at + 16 + 8 * n:
        mr = tuple(None if v < NO_M else v for v in struct.unpack_from("<2d", b, at))
        m = np.frombuffer(b, "<f8", n, at + 16)
    zs = [None] * n if z is None else z.tolist()
    ms = [None] * n if m is None else [None if v < NO_M else v for v in m.tolist()]
    all_ = [(x, y, zz, mm) for (x, y), zz, mm in zip(xy.tolist(), zs, ms)]
    ends = [*starts[1:], n]
    return {"geometry": KINDS[base], "bbox": (*box, *zr, *mr), "parts": [all_[i:j] for i, j in zip(starts, ends)], "part_types": types}


@dataclass
class ShpReader(DataSourceReader):
    path: str
    each: int = 50_000

    def partitions(self):
        out = []
        for p in expand(self.path, (".shp",)):
            shp_header(p)
            shx = p[:-4] + (".shx" if p.endswith("p") else ".SHX")
            n = (size_of(shx) - 100) // 8 if exists(shx) else len(index(p))
            out += [r for r in ranges(p, n, {}, self.each) if n]
        return out

    def read(self, part):
        if part is None:
            return
        where = index(part.path)[part.first : part.last]
        if not where:
            return
        start = where[0][0]
        block = read_bytes(part.path, start, where[-1][0] + where[-1][1] - start)
        for k, (o, n) in enumerate(where, part.first + 1):
            g = decode(block[o - start : o - start + n])
            if g is not None:
                yield (k, g["geometry"], g["bbox"], g["parts"], g["part_types"], part.path)


def encode(code: int, parts: list) -> bytes:
    """Content of one record. parts: lists of (x, y, z, m); None stands for a missing M."""
    flat = [v for p in parts for v in p]
    base, z, m = code % 10, code // 10 == 1, code // 10 >= 1
    low = -1e40
    num = lambda v: low if v is None or v != v else v
    if base == 1:
        x, y, zz, mm = flat[0]
        out = struct.pack("<i2d", code, x, y)
        return out + (struct.pack("<d", zz or 0.0) if z else b"") + (struct.pack("<d", num(mm)) if m else b"")
    xs, ys = [v[0] for v in flat], [v[1] for v in flat]
    out = struct.pack("<i4d", code, min(xs), min(ys), max(xs), max(ys))
    if base == 8:
        out += struct.pack("<i", len(flat))
    else:
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]]).tolist()
        out += struct.pack(f"<ii{len(parts)}i", len(parts), len(flat), *starts)
    out += np.array([(v[0], v[1]) for v in flat], "<f8").tobytes()

    def extra(values):
        real = [v for v in values if v > NO_M]
        return struct.pack("<2d", min(real, default=low), max(real, default=low)) + np.array(values, "<f8").tobytes()

    if z:
        out += extra([v[2] if v[2] is not None else 0.0 for v in flat])
    if m:
        out += extra([num(v[3]) for v in flat])
    return out


class ShpWriter(DataSourceWriter):
    """Pieces by task; commit numbers the records and writes .shp, .shx and .dbf."""

    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        if not self.path.lower().endswith(".shp"):
            self.path += ".shp"
        self.code = int(options["code"])
        self.names = [f.name for f in schema.fields if f.name != "parts"]
        self.fields = dbf.describe(T.StructType([f for f in schema.fields if f.name != "parts"]), {k[6:]: int(v) for k, v in options.items() if k.startswith("width.")})

    def write(self, rows):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        lengths, content, values, boxes = [], [], {n: [] for n in self.names}, []
        for r in rows:
            parts = [[(v["x"], v["y"], v["z"], v["m"]) for v in p] for p in r["parts"]]
            b = encode(self.code, parts)
            content.append(b)
            lengths.append(len(b))
            flat = np.array([[np.nan if c is None else c for c in v] for p in parts for v in p], float)
            with np.errstate(all="ignore"):
                boxes.append([np.nanmin(flat[:, i]) if not np.isnan(flat[:, i]).all() else np.nan for i in range(4)] + [np.nanmax(flat[:, i]) if not np.isnan(flat[:, i]).all() else np.nan for i in range(4)])
            for n in self.names:
                values[n].append(r[n])
        where = f"{self.path}.part-{k:06d}-{TaskContext.get().taskAttemptId()}"
        write_bytes(where, b"".join(content))
        write_bytes(where + ".dbf", dbf.dbf_rows(self.fields, values, len(lengths)))
        box = None
        if boxes:
            a = np.array(boxes)
            ends = lambda col, f: None if np.isnan(col).all() else float(f(col))
            box = [ends(a[:, i], np.nanmin) for i in range(4)] + [ends(a[:, 4 + i], np.nanmax) for i in range(4)]
        return Part(where, (k,), {"lengths": lengths, "box": box})

    def commit(self, messages):
        parts = sorted((m for m in messages if m), key=lambda m: m.order)
        boxes = [p.info["box"] for p in parts if p.info["box"]]
        side = lambda i, f, none: f([b[i] for b in boxes if b[i] is not None], default=none)
        box = [side(0, min, 0.0), side(1, min, 0.0), side(4, max, 0.0), side(5, max, 0.0)]
        box += [side(2, min, 0.0), side(6, max, 0.0)] if self.code // 10 == 1 else [0.0, 0.0]
        box += [side(3, min, 0.0), side(7, max, 0.0)] if self.code // 10 else [0.0, 0.0]
        lengths = [n for p in parts for n in p.info["lengths"]]
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, self.code, *box)
        stem = self.path[:-4]
        fs, q = resolve(self.path)
        number, at, shx = 1, 100, []
        with fs.open_output_stream(q) as f:
            f.write(head(100 + sum(n + 8 for n in lengths)))
            for p in parts:
                data, k = read_bytes(p.path), 0
                for n in p.info["lengths"]:
                    f.write(struct.pack(">ii", number, n // 2) + data[k : k + n])
                    shx.append(struct.pack(">ii", at // 2, n // 2))
                    number, at, k = number + 1, at + 8 + n, k + n
        write_bytes(stem + ".shx", head(100 + 8 * len(lengths)) + b"".join(shx))
        fs, q = resolve(stem + ".dbf")
        with fs.open_output_stream(q) as f:
            f.write(dbf.dbf_frame(self.fields, len(lengths)))
            for p in parts:
                f.write(read_bytes(p.path + ".dbf"))
        for p in parts:
            delete(p.path)
            delete(p.path + ".dbf")

    def abort(self, messages):
        for m in messages:
            if m:
                delete(m.path)
                delete(m.path + ".dbf")


class Shapefile(DataSource):
    """format("shapefile"): geometries as nested parts; null shapes are left out, their numbers stay free."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ShpReader(self.options["path"], int(self.options.get("recordsPerPartition", 50_000)))

    def writer(self, schema, overwrite):
        return ShpWriter(dict(self.options), schema)


def read_shapefile(spark: SparkSession, path: str, *, attributes: Sequence[str] | bool = True, box: tuple[float, float, float, float] | None = None, records: Sequence[int] | None = None, geo: bool = False, clip: bool = False) -> DataFrame:
    """Features with their attributes.

    attributes: all, none or some, by the .dbf beside the file; a name that a geometry column has already is
    wrapped in underscores. box: features whose bounds overlap it. records: by number. geo: vertices are named lon and
    lat. clip: polygons are cut to the box (Sutherland-Hodgman), lines and points lose the vertices outside."""
    d = spark.read.format("shapefile").load(path)
    if records is not None:
        d = d.where(F.col("record_number").isin(*[int(r) for r in records]))
    if box is not None:
        x0, y0, x1, y1 = map(float, box)
        d = d.where((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))
        if clip:
            d = clip_features(d, (x0, y0, x1, y1))
    if attributes is not False and len(expand(path, (".shp",))) == 1:
        p = expand(path, (".shp",))[0]
        table = p[:-4] + (".dbf" if p.endswith("p") else ".DBF")
        if exists(table):
            a = dbf.read_dbf(spark, table, columns=None if attributes is True else list(attributes), erased=True)
            taken = {c.lower() for c in d.columns}
            a = a.select(F.col("record_number").alias("__n"), *[F.col(f"`{c}`").alias(f"_{c}_" if c.lower() in taken else c) for c in a.columns if c != "record_number"])
            d = d.join(a, F.col("record_number") == F.col("__n"), "left").drop("__n")
    if geo:
        v = lambda q: F.struct(q["x"].alias("lon"), q["y"].alias("lat"), q["z"].alias("z"), q["m"].alias("m"))
        d = d.withColumn("parts", F.transform("parts", lambda p: F.transform(p, v)))
    return d


def _cut(ring: list, axis: int, limit: float, keep_less: bool) -> list:
    inside = (lambda v: v[axis] <= limit) if keep_less else (lambda v: v[axis] >= limit)
    out = []
    for a, b in zip([ring[-1], *ring[:-1]], ring):
        if inside(a) != inside(b):
            t = (limit - a[axis]) / (b[axis] - a[axis])
            out.append(tuple(None if p is None or q is None else p + t * (q - p) for p, q in zip(a, b)))
        if inside(b):
            out.append(b)
    return out


def clip_features(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features cut to a box; those of which nothing is left are dropped. Bounds are not renewed."""
    x0, y0, x1, y1 = box

    @F.udf(features.schema["parts"].dataType, useArrow=True)
    def cut(kind, parts):
        out = []
        for p in parts or []:
            r = [tuple(v[k] for k in "xyzm") for v in p]
            if kind == "Polygon":
                if len(r) > 1 and r[0] == r[-1]:
                    r = r[:-1]
                for axis, limit, less in ((0, x1, True), (0, x0, False), (1, y1, True), (1, y0, False)):
                    r = _cut(r, axis, limit, less) if r else r
                r = [*r, r[0]] if r else r
            else:
                r = [v for v in r if x0 <= v[0] <= x1 and y0 <= v[1] <= y1]
            if r:
                out.append(r)
        return out

    return features.withColumn("parts", cut("geometry", "parts")).where(F.size("parts") > 0)


def write_shapefile(df: DataFrame, path: str, kind: str, *, z: bool = False, m: bool = False, attributes: Sequence[str] | None = None) -> None:
    """.shp, .shx and .dbf of a DataFrame with `parts` (arrays of arrays of x, y, z, m) in the order of its
    partitions. kind: Point, MultiPoint, Line or Polygon. Without attributes the table gets an ID."""
    if kind.lower() not in CODES:
        raise ValueError(f"{kind!r} is not written")
    code = CODES[kind.lower()] + (10 if z else 20 if m else 0)
    own = [c for c in df.columns if c not in ("parts", "record_number", "geometry", "bbox", "part_types", "file")]
    own = own if attributes is None else [c for c in own if c in attributes]
    vertex = lambda q: F.struct(*[(q[k] if k in names else F.lit(None)).cast("double").alias(k) for k in "xyzm"])
    names = df.schema["parts"].dataType.elementType.elementType.fieldNames()
    d = df.select(F.transform("parts", lambda p: F.transform(p, vertex)).alias("parts"), *[F.col(f"`{c}`") for c in own])
    if not own:
        d = d.withColumn("ID", F.monotonically_increasing_id())
    texts = [f.name for f in d.schema.fields if isinstance(f.dataType, T.StringType)]
    widths = d.agg(*[F.max(F.octet_length(F.col(f"`{t}`"))).alias(t) for t in texts]).first().asDict() if texts else {}
    d.write.format("shapefile").option("code", str(code)).options(**{f"width.{k}": str(v or 1) for k, v in widths.items()}).mode("append").save(path)


def from_stands(stands: DataFrame) -> DataFrame:
    """parts and attributes of polygons given as vertex arrays with NaN between rings."""
    v = F.arrays_zip(F.col("x"), F.col("y"))
    gap = lambda q: q["x"].isNull() | F.isnan(q["x"])
    start = F.struct(F.array().cast("array<array<struct<x:double,y:double>>>").alias("done"), F.array().cast("array<struct<x:double,y:double>>").alias("now"))
    step = lambda acc, q: F.when(gap(q), F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), F.array().cast("array<struct<x:double,y:double>>").alias("now"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(q)).alias("now")))
    parts = F.aggregate(v, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["now"])), lambda p: F.size(p) > 0))
    return stands.select(parts.alias("parts"), *[c for c in stands.columns if c not in ("x", "y", "geometry")])

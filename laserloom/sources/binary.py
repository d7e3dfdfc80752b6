"""Trajectories and point records of fixed length: SBET, TRJ and LAS, read in ranges of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from laserloom.sources.common import Part, Range, delete, expand, ranges, read_bytes, size_of, write_bytes

#: The fields of an SBET record, all doubles.
SBET_FIELDS = (
    "gps_time", "latitude", "longitude", "altitude", "x_velocity", "y_velocity", "z_velocity", "roll", "pitch", "heading", "wander",
    "x_acceleration", "y_acceleration", "z_acceleration", "x_angular_rate", "y_angular_rate", "z_angular_rate",
)
EACH = 200_000  # records in a task


class FixedReader(DataSourceReader):
    """Ranges of fixed records as Arrow batches of the wanted columns."""

    def __init__(self, options, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.each = int(options.get("recordsPerPartition", EACH))

    def files(self) -> Iterator[tuple[str, int, dict]]:
        raise NotImplementedError

    def batch(self, part: Range) -> dict[str, pa.Array]:
        raise NotImplementedError

    def partitions(self):
        return [r for path, n, info in self.files() for r in ranges(path, n, info, self.each) if n]

    def read(self, part: Range):
        if part is None or part.last <= part.first:
            return
        got = self.batch(part)
        n = part.last - part.first
        cols = []
        for f in self.schema.fields:
            if f.name == "file":
                cols.append(pa.array([part.path]).take(pa.array(np.zeros(n, np.int32))))
            else:
                cols.append(got[f.name])
        yield pa.RecordBatch.from_arrays(cols, names=self.schema.fieldNames())


def _plain(names: Sequence[str], kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


class SbetReader(FixedReader):
    def files(self):
        for p in expand(self.path, (".sbet", ".out")):
            n, rest = divmod(size_of(p), 136)
            if rest:
                raise ValueError(f"{p} does not hold whole records of 17 doubles")
            yield p, n, {}

    def batch(self, part):
        a = np.frombuffer(read_bytes(part.path, part.first * 136, (part.last - part.first) * 136), "<f8").reshape(-1, 17)
        return {n: pa.array(np.ascontiguousarray(a[:, k])) for k, n in enumerate(SBET_FIELDS)}


class OrderedWriter(DataSourceArrowWriter):
    """Pieces by task, put together in task order at commit."""

    def __init__(self, options, schema: T.StructType):
        self.path, self.schema, self.options = options["path"], schema, dict(options)

    def encode(self, table: pa.Table) -> bytes:
        raise NotImplementedError

    def frame(self, parts: list[Part]) -> bytes:
        return b""

    def describe(self, table: pa.Table) -> dict:
        return {"n": table.num_rows}

    def write(self, batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        where = f"{self.path}.part-{k:06d}-{TaskContext.get().taskAttemptId()}"
        write_bytes(where, self.encode(table) if table is not None else b"")
        return Part(where, (k,), self.describe(table) if table is not None else {"n": 0})

    def commit(self, messages):
        from laserloom.sources.common import resolve

        parts = sorted((m for m in messages if m), key=lambda m: m.order)
        fs, q = resolve(self.path)
        head = self.frame(parts)
        with fs.open_output_stream(q) as out:  # streamed piece by piece
            out.write(head)
            for p in parts:
                out.write(read_bytes(p.path))
        for p in parts:
            delete(p.path)

    def abort(self, messages):
        for m in messages:
            if m:
                delete(m.path)


class SbetWriter(OrderedWriter):
    def encode(self, table):
        return np.column_stack([table.column(n).to_numpy().astype("<f8") for n in SBET_FIELDS]).tobytes()


class Sbet(DataSource):
    """format("sbet"): trajectories of 17 doubles a record; file holds the path."""

    @classmethod
    def name(cls):
        return "sbet"

    def schema(self):
        return _plain(SBET_FIELDS, T.DoubleType()).add("file", T.StringType())

    def reader(self, schema):
        return SbetReader(self.options, schema)

    def writer(self, schema, overwrite):
        return SbetWriter(self.options, schema)


# ---- TRJ ---------------------------------------------------------------------------------------

#: The header of a TRJ file, in order.
TRJ_HEADER = (
    ("recog", "8s"), ("version", "i"), ("hdr_size", "I"), ("pos_cnt", "i"), ("pos_size", "i"), ("desc", "78s"), ("sys_idv", "b"), ("quality", "b"),
    ("beg_time", "d"), ("end_time", "d"), ("orig_nbr", "i"), ("number", "i"), ("vrt_video", "400s"), ("vrt_beg", "d"), ("vrt_end", "d"),
    ("fwd_video", "400s"), ("fwd_beg", "d"), ("fwd_end", "d"), ("wave_file", "400s"), ("group_name", "16s"),
)
#: A TRJ record.
TRJ_RECORD = np.dtype([
    ("time", "<f8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("heading", "<f8"), ("roll", "<f8"), ("pitch", "<f8"),
    ("qty_xy", "<i1"), ("qty_z", "<i1"), ("qty_h", "<i1"), ("qty_rp", "<i1"), ("mark", "<i2"), ("flag", "<i2"),
])
_TRJ = "<" + "".join(f for _, f in TRJ_HEADER)


def trj_header(path: str) -> dict:
    """The header's fields, texts cut at their first zero byte."""
    raw = read_bytes(path, 0, struct.calcsize(_TRJ))
    if raw[:8] != b"TSCANTRJ":
        raise ValueError(f"{path} is no TRJ file")
    got = dict(zip((n for n, _ in TRJ_HEADER), struct.unpack(_TRJ, raw.ljust(struct.calcsize(_TRJ), b"\0"))))
    return {k: v.split(b"\0")[0].decode("latin-1") if isinstance(v, bytes) else v for k, v in got.items()}


class TrjReader(FixedReader):
    def files(self):
        for p in expand(self.path, (".trj",)):
            h = trj_header(p)
            yield p, h["pos_cnt"], {"start": h["hdr_size"], "stride": h["pos_size"]}

    def batch(self, part):
        s = part.info["stride"]
        raw = np.frombuffer(read_bytes(part.path, part.info["start"] + part.first * s, (part.last - part.first) * s), np.uint8).reshape(-1, s)
        a = np.ascontiguousarray(raw[:, : TRJ_RECORD.itemsize]).view(TRJ_RECORD)[:, 0]
        q = lambda k, f: np.power(np.maximum(a[k].astype(float), 0), 1.5) * f
        got = {k: a[k] for k in ("time", "x", "y", "z", "heading", "roll", "pitch")}
        got |= {"qty_xy": q("qty_xy", 1e-3), "qty_z": q("qty_z", 1e-3), "qty_h": q("qty_h", 1e-4), "qty_rp": q("qty_rp", 1e-4), "mark": a["mark"], "flag": a["flag"]}
        return {k: pa.array(np.ascontiguousarray(v)) for k, v in got.items()}


class Trj(DataSource):
    """format("trj"): positions with qualities scaled to metres and degrees."""

    @classmethod
    def name(cls):
        return "trj"

    def schema(self):
        s = _plain([n for n in TRJ_RECORD.names if n not in ("mark", "flag")], T.DoubleType())
        return s.add("mark", T.ShortType()).add("flag", T.ShortType()).add("file", T.StringType())

    def reader(self, schema):
        return TrjReader(self.options, schema)


def trj_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per TRJ file with the header only."""
    rows = [{"file": p, **trj_header(p)} for p in expand(path, (".trj",))]
    kinds = {"i": T.IntegerType(), "I": T.LongType(), "b": T.IntegerType(), "d": T.DoubleType()}
    return spark.createDataFrame(rows, T.StructType([T.StructField("file", T.StringType()), *[T.StructField(n, kinds.get(f, T.StringType())) for n, f in TRJ_HEADER]]))


def trj_bytes(header: dict, records: np.ndarray) -> bytes:
    """A whole TRJ file (for exports of small trajectories and for tests)."""
    h = {n: (b"" if f.endswith("s") else 0) for n, f in TRJ_HEADER} | {"recog": b"TSCANTRJ", "version": 20010715, "hdr_size": struct.calcsize(_TRJ), "pos_cnt": len(records), "pos_size": TRJ_RECORD.itemsize} | header
    return struct.pack(_TRJ, *[h[n] for n, _ in TRJ_HEADER]) + records.astype(TRJ_RECORD).tobytes()


# ---- LAS ---------------------------------------------------------------------------------------

_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps", "<f8")]
_GPS, _RGB = [("gps", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
#: Point record formats of the public LAS specification that are read and written.
LAS_FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: [*_NEW, *_RGB, ("nir", "<u2")]}
LAS_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
    T.StructField("intensity", T.DoubleType()), T.StructField("return_number", T.IntegerType()), T.StructField("number_of_returns", T.IntegerType()),
    T.StructField("classification", T.IntegerType()), T.StructField("gps_time", T.DoubleType()), T.StructField("point_source_id", T.IntegerType()),
    T.StructField("red", T.IntegerType()), T.StructField("green", T.IntegerType()), T.StructField("blue", T.IntegerType()), T.StructField("file", T.StringType()),
])


def las_header(path: str) -> dict:
    """Version, format, counts, scales, bounds and variable records of a LAS file."""
    b = read_bytes(path, 0, 375)
    if b[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    major, minor = b[24], b[25]
    size, start, nvlr = struct.unpack_from("<HII", b, 94)
    fmt, length, count = struct.unpack_from("<BHI", b, 104)
    sx = struct.unpack_from("<12d", b, 131)
    if (major, minor) >= (1, 4) and len(b) >= 375:
        count = struct.unpack_from("<Q", b, 247)[0] or count
    h = {"version_major": major, "version_minor": minor, "global_encoding": struct.unpack_from("<H", b, 6)[0], "guid": b[8:24].hex(), "system_id": b[26:58].split(b"\0")[0].decode("latin-1"), "header_size": size, "offset": start, "point_data_format_id": fmt & 0x3F, "record_length": length, "n": count}
    h |= dict(zip(("x_scale", "y_scale", "z_scale", "x_offset", "y_offset", "z_offset", "max_x", "min_x", "max_y", "min_y", "max_z", "min_z"), sx))
    h["gps_time_type"] = h["global_encoding"] & 1
    vlr, at = [], size
    raw = read_bytes(path, size, max(start - size, 0))
    at = 0
    for _ in range(nvlr):
        if at + 54 > len(raw):
            break
        user, rid, n = raw[at + 2 : at + 18].split(b"\0")[0].decode("latin-1"), *struct.unpack_from("<HH", raw, at + 18)
        vlr.append({"user_id": user, "record_id": rid, "length": n, "value": raw[at + 54 : at + 54 + n]})
        at += 54 + n
    h["vlr"] = vlr
    return h


class LasReader(FixedReader):
    def files(self):
        for p in expand(self.path, (".las",)):
            h = las_header(p)
            if h["point_data_format_id"] not in LAS_FORMATS:
                raise ValueError(f"{p}: point record format {h['point_data_format_id']} is not read")
            yield p, h["n"], {k: v for k, v in h.items() if k != "vlr"}

    def batch(self, part):
        h = part.info
        fields = np.dtype(LAS_FORMATS[h["point_data_format_id"]])
        s = h["record_length"]
        raw = np.frombuffer(read_bytes(part.path, h["offset"] + part.first * s, (part.last - part.first) * s), np.uint8).reshape(-1, s)
        a = np.ascontiguousarray(raw[:, : fields.itemsize]).view(fields)[:, 0]
        new = h["point_data_format_id"] >= 6
        n = len(a)
        null = lambda t: pa.nulls(n, t)
        got = {"pid": pa.array(np.arange(part.first, part.last)), "intensity": pa.array(a["intensity"].astype(float))}
        for k in "xyz":
            got[k] = pa.array(a[k.upper()] * h[f"{k}_scale"] + h[f"{k}_offset"])
        bits = a["bits"].astype(np.int32)
        got["return_number"] = pa.array(bits & (15 if new else 7))
        got["number_of_returns"] = pa.array((bits >> (4 if new else 3)) & (15 if new else 7))
        got["classification"] = pa.array(a["class"].astype(np.int32) & (255 if new else 31))
        got["point_source_id"] = pa.array(a["source"].astype(np.int32))
        got["gps_time"] = pa.array(np.ascontiguousarray(a["gps"])) if "gps" in fields.names else null(pa.float64())
        for k in ("red", "green", "blue"):
            got[k] = pa.array(a[k].astype(np.int32)) if k in fields.names else null(pa.int32())
        return got


class LasWriter(OrderedWriter):
    """Options: format (0 to 8 without waveforms), scale, xOffset, yOffset, zOffset, systemId, guid."""

    def _fmt(self) -> int:
        f = int(self.options.get("pointFormat", self.options.get("pointformat", 3)))
        if f not in LAS_FORMATS:
            raise ValueError(f"point record format {f} is not written")
        return f

    def _scale(self) -> tuple[float, list[float]]:
        o = {k.lower(): v for k, v in self.options.items()}
        return float(o.get("scale", 0.001)), [float(o.get(f"{k}offset", 0)) for k in "xyz"]

    def encode(self, table):
        fmt = self._fmt()
        dt = np.dtype(LAS_FORMATS[fmt])
        a = np.zeros(table.num_rows, dt)
        scale, off = self._scale()
        get = lambda c: np.nan_to_num(table.column(c).to_numpy(zero_copy_only=False).astype(float)) if c in table.column_names else np.zeros(table.num_rows)
        for k, o in zip("xyz", off):
            v = np.round((get(k) - o) / scale)
            if len(v) and np.abs(v).max() > 2**31 - 1:
                raise ValueError(f"{k} does not fit the scale and offset")
            a[k.upper()] = v
        a["intensity"] = np.clip(get("intensity"), 0, 65535)
        r, n, cl = get("return_number").astype(int), get("number_of_returns").astype(int), get("classification").astype(int)
        a["bits"] = (r & 15) | ((n & 15) << 4) if fmt >= 6 else (r & 7) | ((n & 7) << 3)
        a["class"] = cl & (255 if fmt >= 6 else 31)
        a["source"] = get("point_source_id")
        if "gps" in dt.names:
            a["gps"] = get("gps_time")
        for k in ("red", "green", "blue"):
            if k in dt.names:
                a[k] = get(k)
        return a.tobytes()

    def describe(self, table):
        v = {k: table.column(k).to_numpy(zero_copy_only=False).astype(float) for k in "xyz"}
        returns = np.bincount(np.clip(np.nan_to_num(table.column("return_number").to_numpy(zero_copy_only=False).astype(float)).astype(int), 0, 15), minlength=16) if "return_number" in table.column_names else np.zeros(16, int)
        return {"n": table.num_rows, "low": [float(np.nanmin(v[k])) for k in "xyz"], "high": [float(np.nanmax(v[k])) for k in "xyz"], "returns": returns.tolist()}

    def frame(self, parts):
        import uuid

        own = [p.info for p in parts if p.info["n"]]
        n = sum(p["n"] for p in own)
        low = [min((p["low"][k] for p in own), default=0.0) for k in range(3)]
        high = [max((p["high"][k] for p in own), default=0.0) for k in range(3)]
        returns = np.sum([p["returns"] for p in own], axis=0) if own else np.zeros(16, int)
        fmt, (scale, off) = self._fmt(), self._scale()
        minor = 4 if fmt >= 6 else 2
        size = 375 if minor == 4 else 227
        o = {k.lower(): v for k, v in self.options.items()}
        h = bytearray(size)
        h[:4] = b"LASF"
        struct.pack_into("<H", h, 6, 1)  # adjusted standard GPS time
        h[8:24] = bytes.fromhex(o.get("guid", uuid.uuid4().hex))
        h[24], h[25] = 1, minor
        h[26:58] = o.get("systemid", "EXTRACTION").encode()[:32].ljust(32, b"\0")
        h[58:90] = b"laserloom".ljust(32, b"\0")
        struct.pack_into("<HII", h, 94, size, size, 0)
        small = n < 2**32 and fmt < 6
        struct.pack_into("<BHI5I", h, 104, fmt, np.dtype(LAS_FORMATS[fmt]).itemsize, n if small else 0, *([int(v) for v in returns[1:6]] if small else [0] * 5))
        struct.pack_into("<12d", h, 131, scale, scale, scale, *off, *[v for k in range(3) for v in (high[k], low[k])])
        if minor == 4:
            struct.pack_into("<QQI", h, 227, 0, 0, 0)
            struct.pack_into("<16Q", h, 247, n, *[int(v) for v in returns[1:16]])
        return bytes(h)


class Las(DataSource):
    """format("las"): points of uncompressed LAS 1.0 to 1.4 files; pid counts within a file."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return LAS_SCHEMA

    def reader(self, schema):
        return LasReader(self.options, schema)

    def writer(self, schema, overwrite):
        return LasWriter(self.options, schema)


def las_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per LAS file from its header alone, with variable records as an array."""
    names = ("version_major", "version_minor", "point_data_format_id", "gps_time_type")
    doubles = ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z")
    rec = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("record_id", T.IntegerType()), T.StructField("length", T.LongType()), T.StructField("value", T.BinaryType())])
    schema = T.StructType([T.StructField("file", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in names], T.StructField("n", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in doubles], T.StructField("vlr", T.ArrayType(rec))])
    paths = expand(path, (".las",))

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, h := las_header(p)) for p in f["path"]]
            yield pd.DataFrame([{"file": p, **{k: h[k] for k in (*names, "n", *doubles, "vlr")}} for p, h in rows], columns=schema.fieldNames())

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    return files.mapInPandas(run, schema)


def write_las(points: DataFrame, path: str, *, order: str = "pid", **options) -> None:
    """One LAS file in order of a column; offsets are the rounded least coordinates unless given."""
    low = points.agg(*[F.floor(F.min(k)).cast("double") for k in "xyz"]).first()
    opts = {"pointFormat": "3", **{f"{k}Offset": str(v or 0.0) for k, v in zip("xyz", low)}, **{k: str(v) for k, v in options.items()}}
    points.repartitionByRange(order).sortWithinPartitions(order).write.format("las").options(**opts).mode("append").save(path)

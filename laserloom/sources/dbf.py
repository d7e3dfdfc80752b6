"""dBase tables: records of fixed length, read in ranges; only the wanted columns are decoded."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from laserloom.sources.binary import FixedReader, OrderedWriter
from laserloom.sources.common import exists, expand, read_bytes, size_of

_TYPES = {"C": T.StringType(), "M": T.StringType(), "D": T.DateType(), "L": T.BooleanType(), "N": T.DoubleType(), "F": T.DoubleType(), "B": T.DoubleType(), "G": T.DoubleType()}


def dbf_header(path: str) -> dict:
    b = read_bytes(path, 0, 32)
    if len(b) < 32 or (b[0] & 7) not in (3, 4, 5):
        raise ValueError(f"{path} is no dBase table of versions III to V")
    n, start, length = struct.unpack_from("<IHH", b, 4)
    raw = read_bytes(path, 32, start - 32)
    fields, at, pos = [], 0, 1
    while at + 32 <= len(raw) and raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1").strip()
        kind, size, dec = chr(raw[at + 11]), raw[at + 16], raw[at + 17]
        fields.append({"name": name, "type": kind, "length": size, "decimals": dec, "at": pos})
        at, pos = at + 32, pos + size
    return {"version": b[0] & 7, "memo": bool(b[0] & 128), "date": f"{1900 + b[1]:04d}-{b[2]:02d}-{b[3]:02d}", "n": min(n, max(0, (size_of(path) - start) // max(length, 1))), "start": start, "length": length, "fields": fields}


def dbf_schema(h: dict) -> T.StructType:
    s = T.StructType()
    for f in h["fields"]:
        s = s.add(f["name"], _TYPES.get(f["type"], T.StringType()))
    return s


def _texts(raw: np.ndarray, f: dict) -> list[str]:
    part = np.ascontiguousarray(raw[:, f["at"] : f["at"] + f["length"]])
    return [x.decode("latin-1").strip(" \0") for x in part.view(f"S{f['length']}")[:, 0].tolist()]


def _number(x: str) -> float | None:
    try:
        return float(x.replace(",", "."))
    except ValueError:
        return None


def _date(x: str) -> dt.date | None:
    try:
        return dt.date(int(x[:4]), int(x[4:6]), int(x[6:8]))
    except ValueError:
        return None


def memo(path: str, block: str) -> str | None:
    """A memo text of a version III .dbt file."""
    if not block.strip().isdigit() or not int(block):
        return None
    at, got = int(block) * 512, b""
    while True:
        piece = read_bytes(path, at, 512)
        end = piece.find(b"\x1a")
        got += piece if end < 0 else piece[:end]
        if end >= 0 or len(piece) < 512:
            return got.decode("latin-1")
        at += 512


class DbfReader(FixedReader):
    def __init__(self, options, schema):
        super().__init__(options, schema)
        self.erased = str(options.get("readErased", options.get("readerased", "false"))).lower() == "true"
        self.filters = []

    def files(self):
        for p in expand(self.path, (".dbf",)):
            h = dbf_header(p)
            yield p, h["n"], h

    def read(self, part):
        if part is None or part.last <= part.first:
            return
        h = part.info
        raw = np.frombuffer(read_bytes(part.path, h["start"] + part.first * h["length"], (part.last - part.first) * h["length"]), np.uint8).reshape(-1, h["length"])
        live = raw[:, 0] != ord("*")
        number = np.arange(part.first + 1, part.last + 1)
        if not self.erased:
            raw, number, live = raw[live], number[live], live[live]
        by = {f["name"]: f for f in h["fields"]}
        cols = []
        for f in self.schema.fields:
            if f.name == "record_number":
                cols.append(pa.array(number.astype(np.int64)))
            elif f.name == "erased":
                cols.append(pa.array(~live))
            else:
                t = _texts(raw, by[f.name])
                kind = by[f.name]["type"]
                if kind in "NFBG":
                    cols.append(pa.array([_number(x) for x in t], pa.float64()))
                elif kind == "D":
                    cols.append(pa.array([_date(x) for x in t], pa.date32()))
                elif kind == "L":
                    cols.append(pa.array([x in "yYtT" if x and x in "yYtTnNfF" else None for x in t], pa.bool_()))
                elif kind == "M":
                    dbt = part.path[:-4] + (".dbt" if part.path.endswith("f") else ".DBT")
                    cols.append(pa.array([memo(dbt, x) for x in t] if exists(dbt) and h["version"] == 3 else [None] * len(t), pa.string()))
                else:
                    cols.append(pa.array([x or None for x in t], pa.string()))
        if len(number):
            yield pa.RecordBatch.from_arrays(cols, names=self.schema.fieldNames())


def describe(df_schema: T.StructType, widths: dict[str, int]) -> list[dict]:
    """Field descriptors for a schema: names of ten characters at most that stay unique."""
    out, at, names = [], 1, set()
    for f in df_schema.fields:
        name = f.name[:10]
        if name.lower() in names:
            raise ValueError(f"{f.name!r} is not unique in its first ten characters")
        names.add(name.lower())
        if isinstance(f.dataType, T.BooleanType):
            kind, size, dec = "L", 1, 0
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            kind, size, dec = "N", 20, 0
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            kind, size, dec = "F", 20, 6
        elif isinstance(f.dataType, T.DateType):
            kind, size, dec = "D", 8, 0
        elif isinstance(f.dataType, T.StringType):
            kind, size, dec = "C", max(1, min(254, widths.get(f.name, 254))), 0
        else:
            continue  # arrays and the like have no place in the format
        out.append({"name": name, "source": f.name, "type": kind, "length": size, "decimals": dec, "at": at})
        at += size
    return out


def dbf_frame(fields: list[dict], n: int, day: dt.date | None = None) -> bytes:
    d = day or dt.date.today()
    head = struct.pack("<BBBBIHH20x", 3, d.year - 1900, d.month, d.day, n, 32 + 32 * len(fields) + 1, 1 + sum(f["length"] for f in fields))
    for f in fields:
        head += struct.pack("<11sc4xBB14x", f["name"].encode("latin-1", "replace"), f["type"].encode(), f["length"], f["decimals"])
    return head + b"\x0d"


def dbf_rows(fields: list[dict], columns: dict[str, list], n: int) -> bytes:
    rows = [bytearray(b" ") for _ in range(n)]
    for f in fields:
        for r, v in zip(rows, columns[f["source"]]):
            if v is None or isinstance(v, float) and np.isnan(v):
                t = b""
            elif f["type"] == "L":
                t = b"Y" if v else b"N"
            elif f["type"] == "N":
                t = str(int(v)).encode().rjust(f["length"])
            elif f["type"] == "F":
                t = f"{float(v):.{f['decimals']}f}".encode().rjust(f["length"])
            elif f["type"] == "D":
                t = v.strftime("%Y%m%d").encode()
            else:
                t = str(v).encode("latin-1", "replace")
            if len(t) > f["length"] and f["type"] in "NF":
                t = b"*" * f["length"]
            r += t[: f["length"]].ljust(f["length"])
    return b"".join(bytes(r) for r in rows)


class DbfWriter(OrderedWriter):
    def __init__(self, options, schema):
        super().__init__(options, schema)
        self.fields = describe(schema, {k[6:]: int(v) for k, v in self.options.items() if k.startswith("width.")})

    def encode(self, table):
        return dbf_rows(self.fields, {f["source"]: table.column(f["source"]).to_pylist() for f in self.fields}, table.num_rows)

    def frame(self, parts):
        return dbf_frame(self.fields, sum(p.info["n"] for p in parts))


class Dbf(DataSource):
    """format("dbf"), option readErased; columns record_number and erased come with the table's own."""

    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        return dbf_schema(dbf_header(expand(self.options["path"], (".dbf",))[0])).add("record_number", T.LongType()).add("erased", T.BooleanType())

    def reader(self, schema):
        return DbfReader(self.options, schema)

    def writer(self, schema, overwrite):
        return DbfWriter(self.options, schema)


def read_dbf(spark: SparkSession, path: str, *, records: Sequence[int] | None = None, columns: Sequence[str | int] | None = None, erased: bool = False) -> DataFrame:
    """A table with record_number; records by number (in file order, numbers beyond the end are passed over),
    columns by name or place from 1, erased records only if asked for."""
    d = spark.read.format("dbf").option("readErased", str(erased).lower()).load(path)
    if records is not None:
        d = d.where(F.col("record_number").isin(*[int(r) for r in records]))
    own = [c for c in d.columns if c not in ("record_number", "erased")]
    if columns is not None:
        want = {own[x - 1] if isinstance(x, int) else x for x in columns}
        own = [c for c in own if c in want]
    return d.select("record_number", *own)


def dbf_info(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: version, date, records, lengths, fields."""
    rows = [(p, h["version"], h["date"], h["n"], h["length"], len(h["fields"]), [(f["name"], f["type"], f["length"], f["decimals"]) for f in h["fields"]]) for p in expand(path, (".dbf",)) for h in [dbf_header(p)]]
    return spark.createDataFrame(rows, "file string, version int, date string, nrec long, recl int, ncols int, fields array<struct<name:string,type:string,length:int,decimals:int>>")


def write_dbf(df: DataFrame, path: str) -> None:
    """One table in the order of df's partitions; texts get the width of the longest. One extra pass if there are texts."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    widths = df.agg(*[F.max(F.octet_length(F.col(f"`{t}`"))).alias(t) for t in texts]).first().asDict() if texts else {}
    df.write.format("dbf").options(**{f"width.{k}": str(v or 1) for k, v in widths.items()}).mode("append").save(path)

"""ENVI headers: `key = value` and `key = {list}` texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The attributes by kind.
NUM = (
    "bands", "byte order", "classes", "cloud cover", "data type", "dem band", "header offset", "lines", "major frame offsets", "minor frame offsets",
    "reflectance scale factor", "samples", "solar irradiance", "sun azimuth", "sun elevation", "x start", "y start",
)
NUM_ARRAY = (
    "bbl", "data gain values", "data ignore value", "data offset values", "data reflectance gain values", "data reflectance offset values", "default bands", "fwhm",
    "geo points", "pixel size", "rpc info", "wavelength", "z plot average", "z plot range",
)
TEXT = (
    "acquisition time", "coordinate system string", "default stretch", "dem file", "file type", "interleave", "product type", "read procedures", "security tag",
    "sensor type", "wavelength units",
)
TEXT_ARRAY = ("band names", "class lookup", "class names", "complex function", "description", "map info", "projection info", "spectra names", "z plot titles")
#: Data types by code.
DATA_TYPES = {1: "uint8", 2: "int16", 3: "int32", 4: "single", 5: "double", 6: "complex single", 9: "complex double", 12: "uint16", 13: "uint32", 14: "int64", 15: "uint64"}


def parse(text: str) -> dict:
    """Attributes of a header; keys with underscores, absent ones left out."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    raw = {}
    for m in re.finditer(r"(?m)^[ \t]*([A-Za-z][A-Za-z ]*?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", t):
        raw.setdefault(" ".join(m[1].lower().split()), m[2].strip())
    got: dict = {}

    def number(x: str):
        try:
            return float(x)
        except ValueError:
            return None

    items = lambda v: [x.strip() for x in v.strip().strip("{}").split(",") if x.strip()]
    for k, v in raw.items():
        key = k.replace(" ", "_")
        if k in NUM:
            n = number(v.strip("{} "))
            if n is not None:
                got[key] = n
        elif k in NUM_ARRAY:
            ns = [n for n in (number(x) for x in re.split(r"[,\s]+", v.strip("{} \n"))) if n is not None]
            if ns:
                got[key] = ns
        elif k in TEXT:
            if v.strip("{} \n"):
                got[key] = v.strip("{} \n")
        elif k in TEXT_ARRAY and items(v):
            got[key] = items(v)
    if "data_type" in got:
        got["data_type_name"] = DATA_TYPES.get(int(got["data_type"]))
    return got


SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    *[T.StructField(k.replace(" ", "_"), T.DoubleType()) for k in NUM],
    *[T.StructField(k.replace(" ", "_"), T.ArrayType(T.DoubleType())) for k in NUM_ARRAY],
    *[T.StructField(k.replace(" ", "_"), T.StringType()) for k in TEXT],
    *[T.StructField(k.replace(" ", "_"), T.ArrayType(T.StringType())) for k in TEXT_ARRAY],
    T.StructField("data_type_name", T.StringType()),
])


def read_envi(spark: SparkSession, path: str) -> DataFrame:
    """One row per header file with a column for each attribute."""

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(SCHEMA)

    def run(batches):
        for b in batches:
            rows = [{n: None for n in arrow.names} | {"file": p, **parse(t)} for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql import functions as F

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return texts.mapInArrow(run, SCHEMA)

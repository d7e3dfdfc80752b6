"""ASCII grids: six header lines, then the rows from the top."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from laserloom.operators.grid import GridRef, densify
from laserloom.sources.binary import OrderedWriter
from laserloom.sources.common import Range, expand, resolve

#: The header's keys in order.
KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")
SUFFIXES = (".asc", ".grd")


def asc_header(path: str) -> dict[str, float]:
    fs, q = resolve(path)
    if not q.lower().endswith(SUFFIXES):
        raise ValueError(f"{path}: an ASCII grid ends in .asc or .grd")
    with fs.open_input_stream(q) as f:
        lines = f.read(1024).decode("latin-1").splitlines()[:6]
    got = {}
    for line, key in zip(lines, KEYS):
        k, _, v = line.strip().partition(" ")
        if k.lower() != key:
            raise ValueError(f"{path}: expected {key}, found {k!r}")
        got[key] = float(v)
    if len(got) < 6:
        raise ValueError(f"{path}: the header is cut off")
    return got


def asc_ref(path: str) -> GridRef:
    """The grid reference of a file: x0, y0 lie one cell outside the first cell's centre."""
    h = asc_header(path)
    s, n = h["cellsize"], int(h["nrows"])
    return GridRef(h["xllcorner"] - s / 2, h["yllcorner"] + (n + 0.5) * s, s, -s, n, int(h["ncols"]))


@dataclass
class AscReader(DataSourceReader):
    path: str
    schema: T.StructType

    def partitions(self):
        return [Range(p, 0, 1, asc_header(p)) for p in expand(self.path, SUFFIXES)]

    def read(self, part):
        import io

        h = part.info
        cols, nodata = int(h["ncols"]), h["nodata_value"]
        fs, q = resolve(part.path)
        with io.BufferedReader(fs.open_input_file(q)) as raw:
            text = io.TextIOWrapper(raw, "latin-1")
            for _ in range(6):
                text.readline()
            row, held = 1, np.zeros(0)
            for line in text:  # numbers may be broken into lines at any place
                held = np.append(held, np.array(line.split(), float))
                k = len(held) // cols
                if k:
                    v = held[: k * cols]
                    held = held[k * cols :]
                    got = {"row": np.repeat(np.arange(row, row + k), cols).astype(np.int32), "col": np.tile(np.arange(1, cols + 1), k).astype(np.int32), "value": v}
                    row += k
                    arrays = {"row": pa.array(got["row"]), "col": pa.array(got["col"]), "value": pa.array(v, mask=v == nodata), "file": pa.array([part.path] * len(v))}
                    yield pa.RecordBatch.from_arrays([arrays[f] for f in self.schema.fieldNames()], names=self.schema.fieldNames())


class AscWriter(OrderedWriter):
    """Rows must come dense and in order; write_asc sees to both."""

    def encode(self, table):
        cols = int(self.options["ncols"])
        digits, nodata = int(self.options.get("precision", 2)), float(self.options.get("nodata", -9999))
        v = np.nan_to_num(table.column("value").to_numpy(zero_copy_only=False).astype(float), nan=nodata)
        if len(v) % cols:
            raise ValueError("a task holds parts of rows")
        return ("\n".join(" ".join(f"{x:.{digits}f}" for x in r) for r in v.reshape(-1, cols)) + "\n").encode() if len(v) else b""

    def frame(self, parts):
        o = self.options
        return "".join(f"{k} {o[k.split('_')[0]]}\n" for k in KEYS).encode()


class AscGrid(DataSource):
    """format("ascgrid"): row, col, value (null for nodata), file."""

    @classmethod
    def name(cls):
        return "ascgrid"

    def schema(self):
        return "row int, col int, value double, file string"

    def reader(self, schema):
        return AscReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return AscWriter(self.options, schema)


def write_asc(raster: DataFrame, ref: GridRef, path: str, *, precision: int = 2, nodata: float = -9999, value: str = "value") -> str:
    """One grid file of a raster (cells that are missing or null become nodata); the suffix is made .asc.
    Square cells only. Rows are written in parallel and joined in order. Returns the path."""
    if abs(ref.dx) != abs(ref.dy):
        raise ValueError("the format needs square cells")
    if not path.lower().endswith(".asc"):
        path = path.rsplit(".", 1)[0] + ".asc" if "." in path.rsplit("/", 1)[-1] else path + ".asc"
    d = densify(raster.select("row", "col", F.col(value).cast("double").alias("value")), ref)
    d = d.repartitionByRange("row").sortWithinPartitions("row", "col")
    opts = {"ncols": ref.ncols, "nrows": ref.nrows, "xllcorner": ref.x0 + 0.5 * ref.dx, "yllcorner": ref.y0 + (ref.nrows + 0.5) * ref.dy, "cellsize": abs(ref.dx), "nodata": nodata, "precision": precision}
    d.write.format("ascgrid").options(**{k: repr(v) if isinstance(v, float) else str(v) for k, v in opts.items()}).mode("append").save(path)
    return path

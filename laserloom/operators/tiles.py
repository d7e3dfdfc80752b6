"""Files of points as tiles: extents, pruning, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laserloom.functions.gpstime import adjusted_to_utc
from laserloom.operators.predicates import Ring, close_ring


def bbox_extents(points: DataFrame, by: str = "file") -> DataFrame:
    """One row per file: bounds, count and the ring of the bounding box (closed)."""
    d = points.groupBy(by).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.min("z").alias("zmin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.max("z").alias("zmax"), F.count("*").alias("npoints"))
    ring = lambda *cs: F.array(*[F.col(c) for c in cs])
    return d.withColumns({"ring_x": ring("xmin", "xmax", "xmax", "xmin", "xmin"), "ring_y": ring("ymin", "ymin", "ymax", "ymax", "ymin")})


def survey_dates(points: DataFrame, by: str = "file", time: str = "gps_time") -> DataFrame:
    """One row per file: number of distinct UTC dates, first and last date, and all dates in one text.
    time is adjusted GPS time; files without any time have no row."""
    d = points.where(F.col(time).isNotNull()).select(by, F.to_date(adjusted_to_utc(F.col(time))).alias("day")).distinct()
    return d.groupBy(by).agg(
        F.count("*").alias("nsurveys"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.array_join(F.array_sort(F.collect_list(F.date_format("day", "yyyy-MM-dd"))), ", ").alias("dates"),
    )


def tile_density(points: DataFrame, by: str = "file") -> DataFrame:
    """Median number of points per voxel of side 1, by file."""
    d = points.where("x is not null and y is not null and z is not null")
    v = lambda c: F.round(F.col(c)).cast("long")
    n = d.groupBy(by, v("x").alias("vx"), v("y").alias("vy"), v("z").alias("vz")).agg(F.count("*").cast("double").alias("n"))
    return n.groupBy(by).agg(F.median("n").alias("pdensity"))


def prune(extents: DataFrame, ring: Ring) -> DataFrame:
    """Files whose box meets the polygon, exactly: a vertex of one in the other or crossing edges."""
    r = close_ring(ring)
    xs, ys = [p[0] for p in r], [p[1] for p in r]
    d = extents.where((F.col("xmin") <= max(xs)) & (F.col("xmax") >= min(xs)) & (F.col("ymin") <= max(ys)) & (F.col("ymax") >= min(ys)))
    from laserloom.operators.predicates import in_polygon

    tests = []
    for x, y in r[:-1]:
        tests.append((F.lit(x) >= F.col("xmin")) & (F.lit(x) <= F.col("xmax")) & (F.lit(y) >= F.col("ymin")) & (F.lit(y) <= F.col("ymax")))
    for cx in ("xmin", "xmax"):
        for cy in ("ymin", "ymax"):
            tests.append(in_polygon(F.col(cx), F.col(cy), ring))
    for (x1, y1), (x2, y2) in zip(r[:-1], r[1:]):
        # an edge crosses the box: its parameter range within the box is not empty (slab test)
        dx, dy = x2 - x1, y2 - y1
        lo, hi = [F.lit(0.0)], [F.lit(1.0)]
        out = F.lit(False)
        for a, step, c0, c1 in ((x1, dx, "xmin", "xmax"), (y1, dy, "ymin", "ymax")):
            if step == 0:
                out = out | ~F.lit(a).between(F.col(c0), F.col(c1))
            else:
                t0, t1 = (F.col(c0) - F.lit(a)) / F.lit(step), (F.col(c1) - F.lit(a)) / F.lit(step)
                lo.append(F.least(t0, t1))
                hi.append(F.greatest(t0, t1))
        low = F.greatest(*lo) if len(lo) > 1 else lo[0]
        high = F.least(*hi) if len(hi) > 1 else hi[0]
        tests.append(~out & (low <= high))
    meets = tests[0]
    for t in tests[1:]:
        meets = meets | t
    return d.where(meets)


def clip_tiled(points: DataFrame, extents: DataFrame, ring: Ring, *, by: str = "file", tile_id: str = "filename") -> DataFrame:
    """Points in the polygon, reading only the tiles whose box meets it. ValueError if none does.

    The names of the tiles that are hit stand in the plan as literals, so partition pruning and file statistics
    apply; beyond 10,000 tiles they are joined instead."""
    from laserloom.operators.predicates import clip

    hit = prune(extents, ring).select(F.col(tile_id).alias("__tile")).distinct()
    names = [r[0] for r in hit.limit(10_001).collect()]
    if not names:
        raise ValueError("the polygon meets no tile")
    some = points.where(F.col(by).isin(names)) if len(names) <= 10_000 else points.join(hit, F.col(by) == F.col("__tile"), "left_semi")
    return clip(some, ring)


def clippers_by_tile(regions: DataFrame, extents: DataFrame, region_id: str = "stand_id", tile_id: str = "filename") -> DataFrame:
    """(region, tile) whose boxes overlap, through the codes of the spatial operator; never all pairs.

    Boxes of regions and tiles are covered by blocks of one common width (that of a large tile) and met on
    the block."""
    width = extents.agg(F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0] or 1.0

    def blocks(df: DataFrame, key: str, p: str) -> DataFrame:
        k = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
        d = df.select(F.col(key).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).dropna()
        d = d.withColumn("bx", F.explode(F.sequence(k(f"{p}_xmin"), k(f"{p}_xmax")))).withColumn("by", F.explode(F.sequence(k(f"{p}_ymin"), k(f"{p}_ymax"))))
        return d

    j = blocks(regions, region_id, "region").join(blocks(extents, tile_id, "tile"), ["bx", "by"])
    j = j.where("region_xmin <= tile_xmax and region_xmax >= tile_xmin and region_ymin <= tile_ymax and region_ymax >= tile_ymin")
    return j.select("region", "tile").distinct()


def merge_points(parts: Sequence[DataFrame], *, fill: float = 0, source: str | None = None) -> DataFrame:
    """All rows of the parts with the columns of the first: a column that a later part lacks is filled
    with 0 there, one that the first lacks is dropped. source: add the part's number (from 1) under this name."""
    if not parts:
        raise ValueError("nothing to merge")
    first = parts[0]
    out = None
    for k, p in enumerate(parts):
        cols = []
        for f in first.schema.fields:
            c = F.col(f"`{f.name}`") if f.name in p.columns else F.lit(fill)
            cols.append(c.cast(f.dataType).alias(f.name))
        if source:
            cols = [c for c, f in zip(cols, first.schema.fields) if f.name != source] + [F.lit(k + 1).cast("int").alias(source)]
        d = p.select(*cols)
        out = d if out is None else out.unionByName(d)
    return out


def merge_records(records: DataFrame, part: str = "part", key: str = "record_id", value: str = "value") -> DataFrame:
    """Variable records common to all parts, matched by record id, their values on end in order of part."""
    n = records.select(part).distinct().count()
    each = records.groupBy(key).agg(F.count_distinct(part).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(part), F.col(value)))), lambda s: s[value]).alias("values"))
    joined = F.aggregate("values", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b.cast("binary"))) if dict(records.dtypes)[value] == "binary" else F.array_join("values", "")
    return each.where(F.col("n") == n).select(key, joined.alias(value))


def add_guid(df: DataFrame, out: str = "uuid") -> DataFrame:
    """A random id of 32 hexadecimal digits for each row."""
    return df.withColumn(out, F.regexp_replace(F.expr("uuid()"), "-", ""))


def promoted_format(record_format: int) -> int:
    """The LAS point record format that adds colours to one without."""
    #: Formats without and with colours.
    return {1: 3, 4: 5, 6: 7, 9: 10}.get(record_format, record_format)

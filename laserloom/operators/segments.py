"""Metrics of labelled segments (trees), one row per label.

Metrics are declared in a registry. All that are column aggregates go into a single groupBy; ratios of them
follow as a projection; those that need geometry come from one pass of numpy kernels over each segment's points,
in which a segment is first reduced to what the kernels need where that is possible. Only what was selected is
computed: Catalyst prunes the aggregates and the kernels are called by name.

Heights are z less the ground height zpos at the segment's apex, and H statistics are of heights divided by the
greatest one. As both are linear in z, they are derived from the statistics of z: no second pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laserloom.functions.stats import exact_hazen, fraction, hazen, kurtosis3, std0
from laserloom.operators.grid import GridRef
from laserloom.operators.predicates import labelled


@dataclass(frozen=True)
class Metric:
    """kind: 'agg' (aggregate of point columns), 'post' (column of other results), 'shape' (numpy kernel).
    needs: what must be there: intensity, returns, colour."""

    name: str
    category: str
    kind: str
    build: Callable[[], Column] | None
    scalar: bool = True
    needs: str = ""
    format: str = "%.4f"
    about: str = ""


REGISTRY: dict[str, Metric] = {}
#: Aggregates that post columns build on.
HELPERS: dict[str, Callable[[], Column]] = {}


def register(name: str, category: str, kind: str = "agg", **more):
    """Decorator: add a metric whose builder takes nothing and returns a Column."""

    def add(f):
        REGISTRY[name] = Metric(name, category, kind, f, **more)
        return f

    return add


def _add(name: str, category: str, build: Callable[[], Column] | None, kind: str = "agg", **more) -> None:
    REGISTRY[name] = Metric(name, category, kind, build, **more)


c = F.col
_point = lambda *cols: F.array_sort(F.collect_list(F.struct("pid", *cols)))
_apex = lambda v: F.max_by(c(v), F.struct(c("z"), -c("pid")))
HELPERS.update(
    __n=lambda: F.count("*"), __zmax=lambda: F.max("z"), __zmean=lambda: F.avg("z"), __zstd=lambda: std0(c("z")), __zs=lambda: F.array_sort(F.collect_list("z")),
    __xapex=lambda: _apex("x"), __yapex=lambda: _apex("y"), __is=lambda: F.array_sort(F.collect_list("iscaled")), __imean=lambda: F.avg("iscaled"), __istd=lambda: std0(c("iscaled")),
    **{f"__cov_{a}{b}": (lambda a=a, b=b: F.covar_samp(a, b)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")},
)

_h = lambda v: F.try_divide(v - c("ZPos"), c("__zmax") - c("ZPos"))
# order as in the registry of metrics: this is also the order of the result's columns
_add("UUID", "Identifier", lambda: F.regexp_replace(F.expr("uuid()"), "-", ""), "post", format="%s", about="random id")
_add("LUID", "Identifier", None, "post", format="%d", about="rank of the label from 1")
_add("Random", "Basic", lambda: F.rand(7), "post", about="uniform in 0 to 1")
_add("NPoints", "Basic", lambda: F.count("*"), format="%d")
_add("XYZ", "Basic", lambda: _point("x", "y", "z"), scalar=False)
_add("XYH", "Basic", None, "xyh", scalar=False, about="positions relative to apex and ground")
_add("UVW", "Basic", None, "scores", scalar=False, about="scores on the principal axes")
_add("XPos", "Basic", lambda: c("__xapex"), "post")
_add("YPos", "Basic", lambda: c("__yapex"), "post")
_add("ZPos", "Basic", lambda: c("ZPos"), "post", about="ground height at the apex")
_add("BBOX2D", "Basic", lambda: F.struct(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")), scalar=False)
_add("BBOX3D", "Basic", lambda: F.struct(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.min("z").alias("zmin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.max("z").alias("zmax")), scalar=False)
for _n in ("CVH2D", "XCVH2D", "YCVH2D", "CVH3D", "CCH2D", "XCCH2D", "YCCH2D", "CCH3D"):
    _add(_n, "Basic", None, "shape", scalar=False)
_P = "PointPatternMetrics"
_add("HMean", _P, lambda: _h(c("__zmean")), "post")
_add("HStdDev", _P, lambda: F.try_divide(c("__zstd"), c("__zmax") - c("ZPos")), "post")
_add("HCoefVar", _P, lambda: F.try_divide(c("__zstd"), c("__zmean") - c("ZPos")), "post")
_add("HKurt", _P, lambda: kurtosis3(c("z")))
_add("HSkew", _P, lambda: F.skewness("z"))
for _q in (25, 50, 75, 90):
    _add(f"HQ{_q}", _P, (lambda q=_q: _h(hazen(c("__zs"), q / 100))), "post")
for _k in (1, 2, 3):
    _add(f"PCVar{_k}", _P, None, "eigen", about="variance along a principal axis, 0 for three points or fewer")
_add("CCH3DRa", _P, lambda: F.try_divide(c("__cch3d_facets"), c("__n")), "shape")
_add("CVH3DRa", _P, lambda: F.try_divide(F.coalesce(c("__cvh3d_facets"), F.lit(1)), c("__n")), "shape")
_add("CCH3DPD", _P, lambda: F.try_divide(c("__n"), c("CCH3DVol")), "shape")
_add("CVH3DPD", _P, lambda: F.try_divide(c("__n"), c("CVH3DVol")), "shape")
_S = "ExternalShapeMetrics"
_add("H", _S, lambda: c("__zmax") - c("ZPos"), "post")
_add("CCH2DArea", _S, None, "shape")
_add("CCH3DArea", _S, None, "shape")
_add("CCH3DVol", _S, None, "shape")
_add("CCH3DSS", _S, lambda: F.try_divide(c("CCH3DArea"), c("CCH3DVol")), "shape")
_add("CVH2DArea", _S, None, "shape")
_add("CD", _S, lambda: F.sqrt(c("CVH2DArea") / F.lit(math.pi)) * 2, "shape", about="diameter of the circle of the hull's area")
_add("CVH3DArea", _S, None, "shape")
_add("CVH3DVol", _S, None, "shape")
_add("Cvty3D", _S, lambda: F.try_divide(c("CCH3DArea"), c("CVH3DArea")), "shape")
_add("CVH3DLac", _S, lambda: F.try_divide(c("CVH3DVol") - c("CCH3DVol"), c("CVH3DVol")), "shape")
_add("CVH3DSS", _S, lambda: F.try_divide(c("CVH3DArea"), c("CVH3DVol")), "shape")
_add("AspRatio", _S, lambda: F.try_divide(F.sqrt(c("CVH2DArea") / F.lit(math.pi)) * 2, c("__zmax") - c("ZPos")), "shape")
_add("Sphericity", _S, lambda: F.try_divide(F.lit(3 * math.sqrt(4 * math.pi)) * c("CVH3DVol"), F.pow(c("CVH3DArea"), 1.5)), "shape")
_O = "OpacityMetrics"
_opacity = lambda: F.try_divide(c("return_number").cast("double"), c("number_of_returns").cast("double"))
_add("Opacity", _O, lambda: F.transform(F.array_sort(F.collect_list(F.struct("pid", _opacity().alias("v")))), lambda s: s["v"]), scalar=False, needs="returns")
_add("OpacityQ50", _O, lambda: F.median(_opacity()), needs="returns")
_add("SRFrac", _O, lambda: fraction((c("return_number") == 1) & (c("number_of_returns") == 1)), needs="returns")
_add("FRFrac", _O, lambda: fraction((c("return_number") == 1) & (c("number_of_returns") > 1)), needs="returns")
_add("LRFrac", _O, lambda: fraction((c("return_number") == c("number_of_returns")) & (c("number_of_returns") > 1)), needs="returns")
_I = "IntensityMetrics"
_add("I", _I, lambda: F.transform(F.array_sort(F.collect_list(F.struct("pid", "iscaled"))), lambda s: s["iscaled"]), scalar=False, needs="intensity")
for _q in (25, 50, 75, 90):
    _add(f"IQ{_q}", _I, (lambda q=_q: hazen(c("__is"), q / 100)), "post", needs="intensity")
_add("IMean", _I, lambda: F.avg("iscaled"), needs="intensity")
_add("IMax", _I, lambda: F.max("iscaled"), needs="intensity")
_add("IStdDev", _I, lambda: std0(c("iscaled")), needs="intensity")
_add("ICoefVar", _I, lambda: F.try_divide(c("__istd"), c("__imean")), "post", needs="intensity")
_add("IKurt", _I, lambda: kurtosis3(c("iscaled")), needs="intensity")
_add("ISkew", _I, lambda: F.skewness("iscaled"), needs="intensity")
_C = "ColorMetrics"
_chroma = lambda k: F.try_divide(c(k).cast("double"), (c("red") + c("green") + c("blue")).cast("double"))
_add("RGB", _C, lambda: _point("red", "green", "blue"), scalar=False, needs="colour")
_add("Chroma", _C, lambda: F.array_sort(F.collect_list(F.struct("pid", _chroma("red").alias("r"), _chroma("green").alias("g"), _chroma("blue").alias("b")))), scalar=False, needs="colour")
_add("RChroQ50", _C, lambda: F.median(_chroma("red")), needs="colour")
_add("GChroQ50", _C, lambda: F.median(_chroma("green")), needs="colour")
for _n in ("RChroHQ50", "GChroHQ50", "BChroHQ50"):
    _add(_n, _C, None, "shape", needs="colour", about="median chromaticity of the points on the hull in space")
# extras beyond the list: medians by kind of return, median height
_add("HMedian", _P, lambda: _h(hazen(c("__zs"), 0.5)), "post")
for _n, _w in (("IFRQ50", lambda: (c("return_number") == 1) & (c("number_of_returns") > 1)), ("ILRQ50", lambda: (c("return_number") == c("number_of_returns")) & (c("number_of_returns") > 1)), ("ISRQ50", lambda: c("number_of_returns") == 1)):
    _add(_n, _I, (lambda w=_w: F.median(F.when(w(), c("iscaled")))), needs="intensity")

EXTRAS = ("HMedian", "IFRQ50", "ILRQ50", "ISRQ50")
_NEEDS = {"intensity": ("intensity", "return_number", "number_of_returns"), "returns": ("return_number", "number_of_returns"), "colour": ("red", "green", "blue")}


def select_metrics(wanted: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Names for names, categories or 'all' (case does not matter), in registry order, without those whose
    columns the points lack. ValueError for unknown names."""
    w = {x.lower() for x in wanted}
    known = {m.name.lower() for m in REGISTRY.values()} | {m.category.lower() for m in REGISTRY.values()} | {"all", "scalar"}
    if w - known:
        raise ValueError(f"unknown metrics {sorted(w - known)}")
    out = []
    for m in REGISTRY.values():
        asked = m.name.lower() in w or m.category.lower() in w and m.name not in EXTRAS or "all" in w and m.name not in EXTRAS or "scalar" in w and m.scalar and m.name not in EXTRAS
        if asked and all(x in columns for x in _NEEDS.get(m.needs, ())):
            out.append(m.name)
    return out


def scale_intensity(points: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Add iscaled: intensity of the labelled points held to two of their quantiles (Hazen, over all of them) and
    scaled to 0 to 1. Null where the quantiles are equal."""
    a, b = exact_hazen(points.where(labelled()), "intensity", [low, high])
    if a is None or a == b:
        return points.withColumn("iscaled", F.lit(None).cast("double"))
    held = F.when(c("intensity") < a, F.lit(a)).when(c("intensity") > b, F.lit(b)).otherwise(c("intensity"))
    return points.withColumn("iscaled", (held - F.lit(a)) / F.lit(b - a))


def _eigen(n: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Variances along the principal axes, falling; 0 for three points or fewer."""
    out = np.zeros((len(n), 3))
    ok = (n > 3) & np.isfinite(cov).all(1)
    m = cov[ok][:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    out[ok] = np.maximum(np.linalg.eigvalsh(m)[:, ::-1], 0)
    return out


_XY = T.ArrayType(T.ArrayType(T.DoubleType()))
_SHAPES: dict[str, T.DataType] = {
    "CVH2D": _XY, "XCVH2D": T.ArrayType(T.DoubleType()), "YCVH2D": T.ArrayType(T.DoubleType()), "CVH2DArea": T.DoubleType(),
    "CVH3D": T.ArrayType(T.ArrayType(T.LongType())), "CVH3DArea": T.DoubleType(), "CVH3DVol": T.DoubleType(), "__cvh3d_facets": T.IntegerType(),
    "CCH2D": _XY, "XCCH2D": T.ArrayType(T.DoubleType()), "YCCH2D": T.ArrayType(T.DoubleType()), "CCH2DArea": T.DoubleType(),
    "CCH3D": T.ArrayType(T.ArrayType(T.LongType())), "CCH3DArea": T.DoubleType(), "CCH3DVol": T.DoubleType(), "__cch3d_facets": T.IntegerType(),
    "RChroHQ50": T.DoubleType(), "GChroHQ50": T.DoubleType(), "BChroHQ50": T.DoubleType(),
}
#: What derived shape metrics take from the kernels.
_FROM = {
    "CCH3DRa": ("__cch3d_facets",), "CVH3DRa": ("__cvh3d_facets",), "CCH3DPD": ("CCH3DVol",), "CVH3DPD": ("CVH3DVol",), "CCH3DSS": ("CCH3DArea", "CCH3DVol"),
    "CD": ("CVH2DArea",), "Cvty3D": ("CCH3DArea", "CVH3DArea"), "CVH3DLac": ("CVH3DVol", "CCH3DVol"), "CVH3DSS": ("CVH3DArea", "CVH3DVol"), "AspRatio": ("CVH2DArea",),
    "Sphericity": ("CVH3DVol", "CVH3DArea"),
}


def shapes_of(pid: np.ndarray, xyz: np.ndarray, chroma: np.ndarray | None, want: set[str], alpha_min: float = 0.0) -> dict:
    """Geometry of one segment by name; None where it has none (too few or flat points)."""
    return shapes_of_many(np.zeros(len(pid), int), pid, xyz, chroma, want, alpha_min)[0]


def shapes_of_many(group: np.ndarray, pid: np.ndarray, xyz: np.ndarray, chroma: np.ndarray | None, want: set[str], alpha_min: float = 0.0) -> list[dict]:
    """shapes_of of each group (0, 1, ..)."""
    from laserloom.geometry import hull as H
    from laserloom.geometry.shapes import alpha_shapes

    o = np.lexsort((pid, group))
    group, pid, xyz = group[o], pid[o], xyz[o]
    chroma = None if chroma is None else chroma[o]
    size = np.bincount(group)
    ends = np.cumsum(size)
    each = [slice(b - n, b) for n, b in zip(size, ends)]
    near = xyz - np.stack([xyz[s].mean(0) for s in each])[group]
    out: list[dict] = [{} for _ in each]
    for s, got in zip(each, out):
        if want & {"CVH2D", "XCVH2D", "YCVH2D", "CVH2DArea"}:
            r = H.ring_2d(xyz[s, :2])
            if r is not None:
                ring = xyz[s][np.append(r, r[0]), :2]
                got |= {"CVH2D": ring.tolist(), "XCVH2D": ring[:, 0].tolist(), "YCVH2D": ring[:, 1].tolist(), "CVH2DArea": H.ring_area(near[s][r, :2])}
        if want & {"CVH3D", "CVH3DArea", "CVH3DVol", "__cvh3d_facets", "RChroHQ50", "GChroHQ50", "BChroHQ50"}:
            hull3 = H.convex_hull(near[s])
            if hull3 is not None:
                area, volume = H.area_and_volume(near[s], hull3)
                got |= {"CVH3DArea": area, "CVH3DVol": volume, "__cvh3d_facets": len(hull3.facets)}
                if "CVH3D" in want:
                    got["CVH3D"] = pid[s][hull3.facets].tolist()
                if chroma is not None and want & {"RChroHQ50", "GChroHQ50", "BChroHQ50"}:
                    med = np.array([np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else np.nan for v in chroma[s][hull3.vertices].T])
                    got |= {k: None if np.isnan(v) else float(v) for k, v in zip(("RChroHQ50", "GChroHQ50", "BChroHQ50"), med)}
    if want & {"CCH2D", "XCCH2D", "YCCH2D", "CCH2DArea"}:
        for got, a in zip(out, alpha_shapes(near[:, :2], group, alpha_min)):
            if a is None:
                continue
            got["CCH2DArea"] = a.measure
            if want & {"CCH2D", "XCCH2D", "YCCH2D"}:
                r = H.walk(a.boundary)
                ring = xyz[[*r, r[0]], :2]
                got |= {"CCH2D": ring.tolist(), "XCCH2D": ring[:, 0].tolist(), "YCCH2D": ring[:, 1].tolist()}
    if want & {"CCH3D", "CCH3DArea", "CCH3DVol", "__cch3d_facets"}:
        for got, a in zip(out, alpha_shapes(near, group, alpha_min)):
            if a is not None:
                got |= {"CCH3DArea": a.surface, "CCH3DVol": a.measure, "__cch3d_facets": len(a.boundary)}
                if "CCH3D" in want:
                    got["CCH3D"] = pid[a.boundary].tolist()
    return out


def _kernel(cols: list[str], colour: bool, alpha_min: float, batch: int = 40_000):
    """Of rows in order of label, the geometry of each: whole segments together, `batch` rows or one segment at a time."""
    import pandas as pd

    def shapes(pdf):
        group, labels = pd.factorize(pdf["label"])
        got = shapes_of_many(group, pdf["pid"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(float), pdf[["r", "g", "b"]].to_numpy(float) if colour else None, set(cols), alpha_min)
        return pd.DataFrame({"label": labels, **{k: pd.Series([g.get(k) for g in got], dtype=object) for k in cols}})

    def work(pdfs):
        held, rows, most = [], 0, batch
        for pdf in pdfs:
            held.append(pdf)
            rows += len(pdf)
            if rows >= most:
                d = pd.concat(held, ignore_index=True)
                last = d["label"] == d["label"].iloc[-1]
                if not last.all():
                    yield shapes(d[~last])
                held, rows = [d[last]], int(last.sum())
                most = max(batch, 2 * rows)
        if rows:
            yield shapes(pd.concat(held, ignore_index=True))

    return work


def _split_by_size(d: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of segments of at most `most` rows, rows of larger ones with their number of rows __n). The larger
    ones are at most one in `most` rows, so the join's small side stays small."""
    large = d.groupBy("label").agg(F.count("*").alias("__n")).where(c("__n") > most)
    return d.join(large.select("label"), "label", "left_anti"), d.join(large, "label")


def hull_candidates(d: DataFrame, most: int = 5000) -> DataFrame:
    """Points that can be corners of a segment's hull: of large segments the corners of the hulls of slices of
    it. So a segment with a third of all points is first reduced in many tasks."""

    def corners(pdf):
        from laserloom.geometry.hull import convex_hull

        pdf = pdf.drop(columns="__k")
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        h = convex_hull(xyz - xyz.mean(0))
        return pdf if h is None else pdf.iloc[h.vertices]

    small, large = _split_by_size(d, most)
    k = F.pmod(F.xxhash64("pid"), F.ceil(c("__n") / F.lit(most)).cast("long"))
    e = large.withColumn("__k", k).drop("__n")
    return small.unionByName(e.groupBy("label", "__k").applyInPandas(corners, d.schema))


def thinned(d: DataFrame, most: int = 20_000) -> DataFrame:
    """Fewer points for a look at large segments (no metric uses it): segments of more than `most` points are
    thinned to the first point of each voxel, the voxels being so large that about `most` of them fill the bounds."""
    small, large = _split_by_size(d, most)
    box = large.groupBy("label").agg(*[F.min(k).alias(f"__{k}") for k in "xyz"], ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) * (F.max("z") - F.min("z"))).alias("__v"))
    side = F.greatest(F.pow(c("__v") / F.lit(float(most)), F.lit(1 / 3)), F.lit(1e-9))
    v = large.join(box, "label").withColumns({f"__i{k}": F.floor((c(k) - c(f"__{k}")) / side) for k in "xyz"})
    row = F.struct(*[c(x) for x in d.columns])
    return small.unionByName(v.groupBy("label", "__ix", "__iy", "__iz").agg(F.min_by(row, "pid").alias("p")).select("p.*"))


def principal_scores(p: DataFrame, moments: DataFrame) -> DataFrame:
    """label, UVW: positions on the principal axes of their segment, in order of pid. moments: label, __n,
    __mean_x.. and __cov_xx.. of the segments. The axes come from the covariances, the scores from columns, so no
    task needs a segment's points at once; the largest part of an axis is positive."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def axes(n, a, b, e, f, g, h):
        import pandas as pd

        m = np.column_stack([x.to_numpy(float) for x in (a, b, e, f, g, h)])[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
        ok = (n.to_numpy(float) > 3) & np.isfinite(m).all((1, 2))
        out = np.full((len(m), 9), np.nan)
        v = np.linalg.eigh(m[ok])[1][:, :, ::-1]
        v = v * np.where(np.abs(v).max(1, keepdims=True) == v.max(1, keepdims=True), 1, -1)
        out[ok] = v.transpose(0, 2, 1).reshape(-1, 9)
        return pd.Series([r.tolist() if o else None for r, o in zip(out, ok)])

    m = moments.select("label", *[c(f"__mean_{k}") for k in "xyz"], axes("__n", *[f"__cov_{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz")]).alias("__ax")).where("__ax is not null")
    j = p.select("label", "pid", "x", "y", "z").join(m, "label")
    score = [sum((c("__ax")[3 * k + i] * (c(x) - c(f"__mean_{x}")) for i, x in enumerate("xyz")), F.lit(0.0)) for k in range(3)]
    each = j.select("label", "pid", F.array(*score).alias("s"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pid", "s"))), lambda q: q["s"]).alias("UVW"))


def segment_metrics(points: DataFrame, metrics: Sequence[str] = ("scalar",), *, dtm: DataFrame | None = None, ref: GridRef | None = None, intensity_scaling: bool = True, alpha_min: float = 0.0) -> DataFrame:
    """label and the selected metrics, in registry order; segments with a null in any selected scalar are dropped.

    dtm: row, col, terrain on `ref` gives the ground height at the apex; without it the ground is the segment's
    lowest point. Points without label, position or height take no part. Only alpha shapes take a segment as a
    whole, with all its points; convex hulls, scores and statistics work in parts."""
    names = select_metrics(metrics, points.columns)
    want = [REGISTRY[n] for n in names]
    p = points.where(labelled() & F.expr("x is not null and y is not null and z is not null and not isnan(z)"))
    if any(m.needs == "intensity" for m in want):
        p = scale_intensity(p) if intensity_scaling else p.withColumn("iscaled", c("intensity"))
    aggs = {k: f() for k, f in HELPERS.items() if k not in ("__is", "__imean", "__istd") or any(m.needs == "intensity" for m in want)}
    aggs["__zmin"] = F.min("z")
    aggs |= {f"__mean_{k}": F.avg(k) for k in "xyz"}
    aggs |= {m.name: m.build() for m in want if m.kind == "agg"}
    if "XYH" in names:
        aggs["XYH"] = _point("x", "y", "z")
    d = p.groupBy("label").agg(*[v.alias(k) for k, v in aggs.items()])
    # ground at the apex
    if dtm is not None:
        d = d.withColumns({"row": ref.row(c("__yapex")), "col": ref.col(c("__xapex"))}).join(dtm.select("row", "col", c("terrain").alias("ZPos")), ["row", "col"], "left")
    else:
        d = d.withColumn("ZPos", c("__zmin"))
    if any(m.kind == "eigen" for m in want):

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def eigen(n, a, b, e, f, g, h):
            import pandas as pd

            return pd.Series(list(_eigen(n.to_numpy(float), np.column_stack([x.to_numpy(float) for x in (a, b, e, f, g, h)]))))

        d = d.withColumn("__ev", eigen("__n", *[f"__cov_{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz")]))
        d = d.withColumns({f"PCVar{k}": F.element_at("__ev", k) for k in (1, 2, 3)})
    if "UVW" in names:
        d = d.join(principal_scores(p, d), "label", "left")
    shape = {m.name for m in want if m.kind == "shape"}
    raw = {k for n in shape for k in _FROM.get(n, (n,))}
    if raw:
        colour = {"red", "green", "blue"} <= set(p.columns)
        src = p.select("label", "pid", "x", "y", "z", *[_chroma(k).alias(k[0]) for k in ("red", "green", "blue") if colour])
        whole = raw & {k for k in _SHAPES if "CCH" in k or "cch" in k}
        # alpha shapes need every point of a segment: where they are wanted, the hulls are of the same rows
        base, cols = src if whole else hull_candidates(src), sorted(raw)
        out = T.StructType([T.StructField("label", p.schema["label"].dataType), *[T.StructField(k, _SHAPES[k]) for k in cols]])

        # a number of our own: small tables would else be coalesced into one task of heavy kernels
        base = base.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label").sortWithinPartitions("label", "pid")
        d = d.join(base.mapInPandas(_kernel(cols, colour, alpha_min), out), "label", "left")
    if "LUID" in names:
        d = d.join(label_ranks(p), "label")
    post = {}
    for m in want:
        if m.kind in ("post", "shape") and m.build is not None:
            post[m.name] = m.build()
    if "XYH" in names:
        post["XYH"] = F.transform("XYH", lambda s: F.struct(s["pid"].alias("pid"), (s["x"] - c("__xapex")).alias("x"), (s["y"] - c("__yapex")).alias("y"), (s["z"] - c("ZPos")).alias("h")))
    d = d.withColumns(post)
    scalars = [m.name for m in want if m.scalar]
    return d.select("label", *names).dropna(how="any", subset=scalars or None)


def label_ranks(points: DataFrame) -> DataFrame:
    """label, LUID: ranks of the labels from 1, by blocks of labels so that no task sorts all."""
    d = points.select("label").where(labelled()).distinct().withColumn("b", F.floor(c("label") / F.lit(100_000)))
    per = d.groupBy("b").agg(F.count("*").alias("n"))
    per = per.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    r = F.row_number().over(Window.partitionBy("b").orderBy("label"))
    return d.withColumn("k", r).join(per, "b").select("label", (c("k") + c("before")).cast("long").alias("LUID"))


def formats(names: Sequence[str]) -> dict[str, tuple[str, bool]]:
    """Print format and whether it is a scalar, by metric."""
    return {n: (REGISTRY[n].format, REGISTRY[n].scalar) for n in names}


def formatted(metrics: DataFrame) -> DataFrame:
    """The scalar metrics as texts in their print formats, for CSV."""
    cols = [c("label")]
    for n in metrics.columns:
        if n in REGISTRY and REGISTRY[n].scalar:
            cols.append(F.format_string(REGISTRY[n].format, c(n)).alias(n))
    return metrics.select(*cols)

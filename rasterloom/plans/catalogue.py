"""One query per operator over the test tables, and the same result in SQL where SQL has it."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import color as K
from ..functions import dtype as D
from ..functions import sql as Q
from ..operators import affine as A
from ..operators import arrays, chroma, faces, filters, infer, lut, tiles, vision
from ..operators.resample import resize
from ..sources import cube, images
from ..streaming import frames
from . import fixtures as X
from . import scratch
from . import sqltext as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


#: Added before rounding: engines round decimal ties by different rules.
OFF_TIE = 1.37e-9


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = T.off_ties(oracle, OFF_TIE)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    off = OFF_TIE if digits == 6 else 0.0
    return df.withColumns({c: F.round(F.col(c) + off, digits) + F.lit(0.0) for c in columns})


def _c() -> tuple:
    return F.col("c0"), F.col("c1"), F.col("c2")


# --- sample types ----------------------------------------------------------------------------

def _point(name: str, make, sql: tuple[str, str, str], kind: str = "double", source: str = "px") -> None:
    """A projection of the line-item pixels; ``make`` returns three columns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = X.px_lineitem(spark, sf_dir)
        df = df.select(*KEYS, *(v.alias(f"c{i}") for i, v in enumerate(make(*_c()))))
        return rounded(df, "c0", "c1", "c2") if kind == "double" else df

    shown = [f"round({e}, 6) + 0e0 AS c{i}" if kind == "double" else f"({e})::INT AS c{i}" for i, e in enumerate(sql)]
    add(name, query, f"WITH {X.SQL['px']}, {T.POINT} SELECT {', '.join(KEYS)}, {', '.join(shown)} FROM {source}")


def _each(f: str) -> tuple[str, str, str]:
    return tuple(f.replace("@", f"c{i}") for i in range(3))


U8, U16 = "floor(least(greatest(@ * 255e0, 0e0), 255e0))", "floor(least(greatest(@ * 65535e0, 0e0), 65535e0))"
_point("to_uint8", lambda *c: [D.to_uint8(v) for v in c], _each(U8), "int")
_point("to_uint16", lambda *c: [D.to_uint16(v) for v in c], _each(U16), "int")
_point("to_float32", lambda *c: [D.to_float32(v * 2.0 - 0.5) for v in c], _each("least(greatest(@ * 2e0 - 0.5e0, 0e0), 1e0)"))
_point("to_float64", lambda *c: [D.to_float64(D.to_uint16(v), "uint16") for v in c], _each(f"{U16} / 65535e0"))
_point("uint16_to_uint8", lambda *c: [D.to_uint8(D.to_uint16(v), "uint16") for v in c], _each(f"floor(least(greatest({U16} / 65535e0 * 255e0, 0e0), 255e0))"), "int")
_point("uint8_to_uint16", lambda *c: [D.to_uint16(D.to_uint8(v), "uint8") for v in c], _each(f"floor(least(greatest({U8} / 255e0 * 65535e0, 0e0), 65535e0))"), "int")
_point("to_dtype_dispatch", lambda *c: [D.to_dtype(D.to_uint8(v), "float32", "uint8") for v in c], _each(f"{U8} / 255e0"))
_HALF = "CASE WHEN @ = 0 THEN 0e0 ELSE round_even(@ / pow(2e0, greatest(floor(log2(@)), -14e0) - 10), 0) * pow(2e0, greatest(floor(log2(@)), -14e0) - 10) END"
_point("to_float16", lambda *c: [D.to_float16(v) for v in c], _each(_HALF))

# --- colour ------------------------------------------------------------------------------------

_SWAP, _LUMA = ("c2", "c1", "c0"), "(0.2126e0 * {0} + 0.7152e0 * {1} + 0.0722e0 * {2})"
_Y, _YB = _LUMA.format("c0", "c1", "c2"), _LUMA.format("c2", "c1", "c0")
_point("bgr_to_rgb", K.bgr_to_rgb, _SWAP)
_point("rgb_to_bgr", K.rgb_to_bgr, _SWAP)
_point("rgb_to_grayscale", K.rgb_to_grayscale, (_Y,) * 3)
_point("bgr_to_grayscale", K.bgr_to_grayscale, (_YB,) * 3)
_point("rgb_to_hsv", K.rgb_to_hsv, ("h", "s", "mx"), source="hsv")
_point("bgr_to_hsv", K.bgr_to_hsv, ("h", "s", "mx"), source="hsv_bgr")
_point("hsv_to_rgb", K.hsv_to_rgb, ("r + m", "g + m", "b + m"), source="rgb")
_point("hsv_to_bgr", K.hsv_to_bgr, ("b + m", "g + m", "r + m"), source="rgb")
_point("rgb_to_ycbcr", K.rgb_to_ycbcr, (_Y, f"(c2 - {_Y}) / 1.8556e0 + 0.5e0", f"(c0 - {_Y}) / 1.5748e0 + 0.5e0"))
_point("bgr_to_ycbcr", K.bgr_to_ycbcr, (_YB, f"(c0 - {_YB}) / 1.8556e0 + 0.5e0", f"(c2 - {_YB}) / 1.5748e0 + 0.5e0"))
_YCC = ("c0 + 1.5748e0 * (c2 - 0.5e0)", "c0 - 0.1873e0 * (c1 - 0.5e0) - 0.4681e0 * (c2 - 0.5e0)", "c0 + 1.8556e0 * (c1 - 0.5e0)")
_point("ycbcr_to_rgb", K.ycbcr_to_rgb, _YCC)
_point("ycbcr_to_bgr", K.ycbcr_to_bgr, _YCC[::-1])
_point("ycbcr_full_to_legal", K.ycbcr_full_to_legal, ("c0 * 876e0 / 1023e0 + 64e0 / 1023e0", "(c1 - 0.5e0) * 896e0 / 1023e0 + 0.5e0", "(c2 - 0.5e0) * 896e0 / 1023e0 + 0.5e0"))
_point("ycbcr_legal_to_full", K.ycbcr_legal_to_full, ("(c0 - 64e0 / 1023e0) * 1023e0 / 876e0", "(c1 - 0.5e0) * 1023e0 / 896e0 + 0.5e0", "(c2 - 0.5e0) * 1023e0 / 896e0 + 0.5e0"))
_point("ycbcr_to_grayscale", K.ycbcr_to_grayscale, ("c0",) * 3)
_AP1, _AP0 = T.matrix(K.AP0_TO_AP1, ("c0", "c1", "c2")), T.matrix(K.AP1_TO_AP0, ("c0", "c1", "c2"))
_point("aces2065_1_to_acescg", K.aces2065_1_to_acescg, _AP1)
_point("acescg_to_aces2065_1", K.acescg_to_aces2065_1, _AP0)
_CCT = "CASE WHEN {0} <= 0.0078125e0 THEN (log2(CASE WHEN {0} > 0 THEN {0} ELSE pow(2e0, -40) END) + 9.72e0) / 17.52e0 ELSE (10.5402377416545e0 * {0} + 0.0729055341958355e0) / 17.52e0 END"
_point("aces2065_1_to_acescct", K.aces2065_1_to_acescct, tuple(_CCT.format(v) for v in _AP1))
_LIN = "(CASE WHEN {0} <= 0.155251141552511e0 THEN (17.52e0 * {0} - 0.0729055341958355e0) / 10.5402377416545e0 WHEN {0} < log2(65504e0) THEN pow(2e0, 17.52e0 * {0} - 9.72e0) ELSE 65504e0 END)"
_point("acescct_to_aces2065_1", K.acescct_to_aces2065_1, T.matrix(K.AP1_TO_AP0, tuple(_LIN.format(f"c{i}") for i in range(3))))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL functions in a statement."""
    Q.register(spark)
    X.px_lineitem(spark, sf_dir).createOrReplaceTempView("px_lineitem_view")
    return spark.sql(f"SELECT {', '.join(KEYS)}, px_to_uint8(c0) AS u8, round(px_rgb_luma(c0, c1, c2) + 1.37e-9D, 6) + 0e0 AS luma, round(px_rgb_hue(c0, c1, c2) + 1.37e-9D, 6) + 0e0 AS hue, round(px_rgb_saturation(c0, c1, c2) + 1.37e-9D, 6) + 0e0 AS sat, round(px_acescg_red(c0, c1, c2) + 1.37e-9D, 6) + 0e0 AS red FROM px_lineitem_view")


add("sql_functions", sql_functions, f"WITH {X.SQL['px']}, {T.POINT} SELECT {', '.join(KEYS)}, floor(least(greatest(c0 * 255e0, 0e0), 255e0))::INT AS u8, round({_Y}, 6) + 0e0 AS luma, round(h, 6) + 0e0 AS hue, round(s, 6) + 0e0 AS sat, round({_AP1[0]}, 6) + 0e0 AS red FROM hsv")

# --- look-up tables ------------------------------------------------------------------------------


def _lut(name: str, interpolation: int, n: int) -> None:
    add(name, lambda spark, d: rounded(lut.apply_lut(X.px_lineitem(spark, d), X.lut_gen(spark, n), interpolation), "c0", "c1", "c2"), T.lut_query(KEYS, n, interpolation, _each("@"), _each("@")))


_lut("apply_lut_trilinear", lut.TRILINEAR, 17)
_lut("apply_lut_tetrahedral", lut.TETRAHEDRAL, 17)
_TONE = "(ln((@ + 1.5e-8) / 1.186e-3) / 12.144e0)"
_CLIP = "least(greatest(@, 0e0), 1e0)"
add("rec709_to_aces2065_1", lambda spark, d: rounded(lut.rec709_to_aces2065_1(X.px_lineitem(spark, d), X.lut_gen(spark)), "c0", "c1", "c2"), T.lut_query(KEYS, 17, 0, _each(_TONE), _each(_CLIP)))
add("aces2065_1_to_rec709", lambda spark, d: rounded(lut.aces2065_1_to_rec709(X.px_lineitem(spark, d), X.lut_gen(spark)), "c0", "c1", "c2"), T.lut_query(KEYS, 17, 0, _each("@"), _each("least(greatest(exp(@ * 12.144e0) * 1.186e-3 - 1.5e-8, 0e0), 1e0)")))

# --- raw video -------------------------------------------------------------------------------------


def _frames(name: str, size: int, make, body: tuple[str, str, str], kind: str = "double", extra: str = "") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(chroma.frames_from_bytes(X.bytes_events(spark, sf_dir, size), "f"))
        return rounded(out, "c0", "c1", "c2") if kind == "double" else out

    shown = ", ".join(f"round({e}, 6) + 0e0 AS c{i}" if kind == "double" else f"({e})::INT AS c{i}" for i, e in enumerate(body))
    add(name, query, f"WITH {X.sql_bytes(size)}, a AS (SELECT f, list(byte ORDER BY p) AS v FROM b GROUP BY f), g AS (SELECT f, v, id // 8 AS y, id % 8 AS x FROM a, range(64) t(id)){extra} SELECT f, y::INT AS y, x::INT AS x, {shown} FROM g")


def _bilinear(base: int) -> str:
    g = lambda yy, xx: f"v[1 + {base} + ({yy}) * 4 + ({xx})] / 255e0"
    y0, x0, y1, x1 = "(y // 2)", "(x // 2)", "least(y // 2 + 1, 3)", "least(x // 2 + 1, 3)"
    fx, fy = "(x / 2e0 - x // 2)", "(y / 2e0 - y // 2)"
    return f"(({g(y0, x0)}) * (1 - {fx}) + ({g(y0, x1)}) * {fx}) * (1 - {fy}) + (({g(y1, x0)}) * (1 - {fx}) + ({g(y1, x1)}) * {fx}) * {fy}"


_frames("yuv420p_bilinear", 96, lambda f: chroma.yuv420p_to_ycbcr444(f, 8, 8, S.LINEAR, "f"), ("v[1 + y * 8 + x] / 255e0", _bilinear(64), _bilinear(80)))
_frames("yuv420p_nearest", 96, lambda f: chroma.yuv420p_to_ycbcr444(f, 8, 8, S.NEAREST, "f"), ("least(greatest((v[1 + y * 8 + x] / 255e0 - 64e0 / 1023e0) * 1023e0 / 876e0, 0e0), 1e0)", "v[65 + (y // 2) * 4 + x // 2] / 255e0", "v[81 + (y // 2) * 4 + x // 2] / 255e0"))


def _ten(at: str) -> str:
    return f"((v[1 + ({at}) * 2] + v[2 + ({at}) * 2] * 256) & 1023) / 1023e0"


def _ten_mean(base: int) -> str:
    p = f"{base} + y * 4 + x // 2"
    return f"CASE WHEN x % 2 = 1 AND x < 7 THEN ({_ten(p)} + {_ten(p + ' + 1')}) / 2 ELSE {_ten(p)} END"


_frames("yuv422p10le", 256, lambda f: chroma.yuv422p10le_to_ycbcr444(f, 8, 8, True, "f"), (_ten("y * 8 + x"), _ten_mean(64), _ten_mean(96)))
_frames("yuv422p10le_replicate", 256, lambda f: chroma.yuv422p10le_to_ycbcr444(f, 8, 8, False, "f"), (_ten("y * 8 + x"), _ten("64 + y * 4 + x // 2"), _ten("96 + y * 4 + x // 2")))
_frames("uyvy422", 128, lambda f: chroma.uyvy422_to_ycbcr444(f, 8, 8, "f"), ("v[2 + y * 16 + x * 2]", "v[1 + y * 16 + (x // 2) * 4]", "v[3 + y * 16 + (x // 2) * 4]"), "int")
_NDI = "floor(v[{0} + y * 16 + (x // 2) * 4] * (1 - (x / 2e0 - x // 2)) + v[{0} + y * 16 + least(x // 2 + 1, 3) * 4] * (x / 2e0 - x // 2))"
_frames("ndi_uyvy422_bilinear", 128, lambda f: chroma.ndi_uyvy422_to_ycbcr444(f, 8, 8, True, "f"), ("v[2 + y * 16 + x * 2]", _NDI.format(1), _NDI.format(3)), "int")
_NDN = "CASE WHEN x % 2 = 1 AND (x // 2) * 2 + 1 < 4 THEN floor((v[{0} + y * 16 + (x // 2) * 4] + v[{0} + y * 16 + (x // 2) * 4 + 4]) / 2) ELSE v[{0} + y * 16 + (x // 2) * 4] END"
_frames("ndi_uyvy422_nearest", 128, lambda f: chroma.ndi_uyvy422_to_ycbcr444(f, 8, 8, False, "f"), ("v[2 + y * 16 + x * 2]", _NDN.format(1), _NDN.format(3)), "int")


def _resized_frames(name: str, size: int, make, luma: str, u: str, v: str, ch: int, mode: int) -> None:
    """Chroma of 4 x ch samples resampled to 8 x 8."""
    tx, ty = T.taps("tx", mode, 4, 8), T.taps("ty", mode, ch, 8)
    add(name, lambda spark, d: rounded(make(chroma.frames_from_bytes(X.bytes_events(spark, d, size), "f")), "c0", "c1", "c2"), f"""
WITH {X.sql_bytes(size)}, a AS (SELECT f, list(byte ORDER BY p) AS v FROM b GROUP BY f), {tx}, {ty},
l AS (SELECT f, id // 8 AS y, id % 8 AS x, {luma} AS c0 FROM (SELECT f, v, id, id // 8 AS y, id % 8 AS x FROM a, range(64) t(id))),
s AS (SELECT f, y, x, {u} AS u, {v} AS w FROM (SELECT f, v, id // 4 AS y, id % 4 AS x FROM a, range({4 * ch}) t(id))),
r AS (SELECT f, ty.o AS y, tx.o AS x, sum(ty.w * tx.w * s.u) / sum(ty.w * tx.w) AS c1, sum(ty.w * tx.w * s.w) / sum(ty.w * tx.w) AS c2 FROM s JOIN tx ON s.x = tx.s JOIN ty ON s.y = ty.s GROUP BY ALL)
SELECT f, y::INT AS y, x::INT AS x, round(c0, 6) + 0e0 AS c0, round(least(greatest(c1, 0e0), 1e0), 6) + 0e0 AS c1, round(least(greatest(c2, 0e0), 1e0), 6) + 0e0 AS c2 FROM l JOIN r USING (f, y, x)""")


for _name, _i, _m in (("nearest", 0, S.NEAREST), ("linear", 1, S.LINEAR), ("cubic", 2, S.CUBIC)):
    _resized_frames(f"yuv420p_resize_{_name}", 96, lambda f, i=_i: chroma.yuv420p_to_ycbcr444_resized(f, 8, 8, i, "f"), "v[1 + y * 8 + x] / 255e0", "v[65 + y * 4 + x] / 255e0", "v[81 + y * 4 + x] / 255e0", 4, _m)
_resized_frames("ndi_uyvy422_bicubic", 128, lambda f: chroma.ndi_uyvy422_to_ycbcr444_resized(f, 8, 8, "f"), "v[2 + y * 16 + x * 2] / 255e0", "v[1 + y * 16 + x * 4] / 255e0", "v[3 + y * 16 + x * 4] / 255e0", 8, S.CUBIC)

# --- resampling ------------------------------------------------------------------------------------


def _resize(name: str, mode: int, w: int, h: int, sql_mode: int | None = None, **how) -> None:
    how = how or {"dsize": (w, h)}
    add(name, lambda spark, d: rounded(resize(X.img_embeddings(spark, d), interpolation=mode, keys=["vec_id"], **how), "c0"), f"WITH {X.SQL['img']}, {T.resized('img', 'vec_id', sql_mode if sql_mode is not None else mode, 8, 8, w, h, ['c0'], 'z')} SELECT vec_id, y::INT AS y, x::INT AS x, round(c0, 6) + 0e0 AS c0 FROM z")


for _name, _m in S.MODES.items():
    if _m == S.AREA:
        _resize("resize_area", _m, 5, 3)
    elif _m != S.AUTO:
        _resize(f"resize_{_name}", _m, 13, 11)
_resize("resize_auto_down", S.AUTO, 4, 9, S.AREA, dsize=(4, 9), size=(8, 8))
_resize("resize_auto_up", S.AUTO, 12, 16, S.LANCZOS4)
_resize("resize_scale_factors", S.MITCHELL, 12, 6, fx=1.5, fy=0.75)

# --- warps -------------------------------------------------------------------------------------------

_TURN = ((1.1 * math.cos(0.35), -1.1 * math.sin(0.35), 3.0), (1.1 * math.sin(0.35), 1.1 * math.cos(0.35), -2.0))
_SHRINK = ((0.6, 0.1, 1.0), (-0.05, 0.55, 2.0))


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 x 8 images at 24 x 24, each sample three by three."""
    return resize(X.img_embeddings(spark, sf_dir, 3), (24, 24), interpolation=S.NEAREST, keys=["vec_id"], size=(8, 8))


def _warp(name: str, mode: int, m, sql_mode: int | None = None) -> None:
    add(name, lambda spark, d: rounded(A.affine_transform(_large(spark, d), m, (14, 12), mode, ["vec_id"], (24, 24)), "c0", "c1", "c2"), f"WITH {X.SQL['img']}, {T.LARGE}, {T.warped('big', A.get_inverse_matrix(m), 24, 24, 14, 12, sql_mode if sql_mode is not None else mode, ['c0', 'c1', 'c2'], 'z')} SELECT vec_id, y::INT AS y, x::INT AS x, {T.rounded('c0', 'c1', 'c2')} FROM z")


for _name, _m in S.MODES.items():
    if _m != S.AUTO:
        _warp(f"affine_{_name}", _m, _SHRINK if _m == S.AREA else _TURN)
_warp("affine_auto", S.AUTO, _TURN, S.MITCHELL)
_warp("affine_auto_down", S.AUTO, _SHRINK, S.AREA)


def inverse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = lambda i: F.element_at("embedding", i + 1).cast("double")
    m = F.struct((e(0) + 2.0).alias("m00"), e(1).alias("m01"), e(2).alias("m02"), e(3).alias("m10"), (e(4) + 2.0).alias("m11"), e(5).alias("m12"))
    out = t.select("vec_id", A.inverse_columns(m).alias("i")).select("vec_id", "i.*")
    return rounded(out, *out.columns[1:])


add("inverse_matrix", inverse_matrix, """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE + 2 AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, embedding[5]::DOUBLE + 2 AS f, embedding[6]::DOUBLE AS g FROM embeddings), t AS (SELECT *, a * f - b * d AS det FROM e)
SELECT vec_id, round(f / det, 6) + 0e0 AS m00, round(-b / det, 6) + 0e0 AS m01, round((b * g - c * f) / det, 6) + 0e0 AS m02, round(-d / det, 6) + 0e0 AS m10, round(a / det, 6) + 0e0 AS m11, round((c * d - a * g) / det, 6) + 0e0 AS m12 FROM t""")


def crop_matrix_from_kps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.kps_embeddings(spark, sf_dir).select("vec_id", A.crop_matrix(F.col("kps"), 112).alias("m")).select("vec_id", "m.*")
    return rounded(out, *out.columns[1:])


_KPS = T.points_of_embeddings(A.TEMPLATE)
add("crop_matrix_from_kps", crop_matrix_from_kps, f"WITH {T.crop_matrix(A.TEMPLATE, _KPS, 'vec_id')} SELECT vec_id, {T.rounded(*T.MATRIX)} FROM m")


def crop_from_kps(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops, _ = A.crop_from_kps(_large(spark, sf_dir), X.kps_embeddings(spark, sf_dir), 16, ["vec_id"])
    return rounded(crops, "c0", "c1", "c2")


add("crop_from_kps", crop_from_kps, f"WITH {X.SQL['img']}, {T.LARGE}, {T.crop_matrix(A.template(16), _KPS, 'vec_id')}, {T.shrunk_crops('big', 24, 16, ['c0', 'c1', 'c2'])} SELECT vec_id, y::INT AS y, x::INT AS x, {T.rounded('c0', 'c1', 'c2')} FROM z")

# --- filters -------------------------------------------------------------------------------------------


def _blur(name: str, k: int, sigma: float, kernel: list | None = None) -> None:
    taps = kernel or filters.create_gaussian_kernel(k, sigma)
    flat = taps[0] if isinstance(taps[0], list) else taps
    add(name, lambda spark, d: rounded(filters.gaussian_blur(X.img_embeddings(spark, d, 3), k, sigma, kernel, ["vec_id"], (8, 8)), "c0", "c1", "c2"), T.blur(flat))


_blur("gaussian_blur", 5, 1.5)
_blur("gaussian_blur_even_kernel", 4, 0.8)
_blur("gaussian_blur_custom_kernel", 3, 1.0, [[1.0, 3.0, 2.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def _erode(name: str, k: int, mask: list | None, border: float) -> None:
    add(name, lambda spark, d: rounded(filters.erode(X.img_embeddings(spark, d, 3), k, mask, border, ["vec_id"], (8, 8)), "c0", "c1", "c2"), T.erode(mask or filters.create_erode_kernel(k), border))


_erode("erode_3x3", 3, None, 0.0)
_erode("erode_even", 4, None, 1.0)
_erode("erode_border", 3, None, 0.4)
_erode("erode_custom_mask", 3, [[0, 1, 0], [1, 1, 1], [0, 1, 0]], 1.0)

# --- detection and embeddings ------------------------------------------------------------------------------


def anchor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vision.decode_heads(X.heads_gen(spark, sf_dir), (32, 32), 2, 0.5)
    out = out.select("image_id", "stride", "anchor_idx", "score", "x1", "y1", "x2", "y2", F.element_at("kps", 1)["x"].alias("kx"), F.element_at("kps", 5)["y"].alias("ky"))
    return rounded(out, "score", "x1", "y1", "x2", "y2", "kx", "ky")


_AX, _AY = "((anchor_idx // 2) % 4 * 8)", "((anchor_idx // 2) // 4 * 8)"
add("anchor_decode", anchor_decode, f"WITH {X.SQL['heads']} SELECT image_id, stride, anchor_idx::INT AS anchor_idx, {T.rounded('score')}, round({_AX} - d0 * 8, 6) + 0e0 AS x1, round({_AY} - d1 * 8, 6) + 0e0 AS y1, round({_AX} + d2 * 8, 6) + 0e0 AS x2, round({_AY} + d3 * 8, 6) + 0e0 AS y2, round(greatest({_AX} + k0 * 8, 0e0), 6) + 0e0 AS kx, round(greatest({_AY} + k9 * 8, 0e0), 6) + 0e0 AS ky FROM heads WHERE score >= 0.5")


def distance2bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.heads_gen(spark, sf_dir)
    b = vision.distance2bbox(F.col("anchor_idx").cast("double"), F.lit(5.0), [F.col(f"d{i}") * 20.0 for i in range(4)], (16, 24))
    return rounded(h.select("image_id", "anchor_idx", b.alias("b")).select("image_id", "anchor_idx", "b.*"), "x1", "y1", "x2", "y2")


add("distance2bbox", distance2bbox, f"WITH {X.SQL['heads']} SELECT image_id, anchor_idx::INT AS anchor_idx, " + ", ".join(f"round(least(greatest({e}, 0e0), {top}), 6) + 0e0 AS {n}" for n, e, top in (("x1", "anchor_idx - d0 * 20", "24e0"), ("y1", "5 - d1 * 20", "16e0"), ("x2", "anchor_idx + d2 * 20", "24e0"), ("y2", "5 + d3 * 20", "16e0"))) + " FROM heads")


def distance2kps(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.heads_gen(spark, sf_dir)
    k = vision.distance2kps(F.col("anchor_idx").cast("double"), F.lit(5.0), [F.col(f"k{i}") * 20.0 for i in range(10)])
    return rounded(h.select("image_id", "anchor_idx", F.posexplode(k).alias("k", "p")).select("image_id", "anchor_idx", "k", "p.x", "p.y"), "x", "y")


add("distance2kps", distance2kps, f"WITH {X.SQL['heads']} " + " UNION ALL ".join(f"SELECT image_id, anchor_idx::INT AS anchor_idx, {k} AS k, round(greatest(anchor_idx + k{2 * k} * 20, 0e0), 6) + 0e0 AS x, round(greatest(5 + k{2 * k + 1} * 20, 0e0), 6) + 0e0 AS y FROM heads" for k in range(5)))
add("score_filter", lambda spark, d: X.boxes_events(spark, d).where(F.col("score") >= 50.0).select("img", "id", "score"), f"WITH {X.SQL['boxes']} SELECT img, id, score FROM boxes WHERE score >= 50")
add("nms", lambda spark, d: vision.nms(X.boxes_events(spark, d), 0.4, ["img"]).select("img", "id"), T.nms(X.SQL["boxes"], 0.4))


def _top(name: str, metric: str, value: str) -> None:
    add(name, lambda spark, d: vision.top_faces(X.boxes_events(spark, d), 3, (120, 140), metric, ["img"]).select("img", "id"), f"WITH {X.SQL['boxes']} SELECT img, id FROM boxes QUALIFY row_number() OVER (PARTITION BY img ORDER BY {value} DESC, id) <= 3")


_top("topk_faces", "default", "(x2 - x1) * (y2 - y1) - 2 * (pow((x1 + x2) / 2 - 70, 2) + pow((y1 + y2) / 2 - 60, 2))")
_top("topk_faces_max", "max", "(x2 - x1) * (y2 - y1)")
add("letterbox", lambda spark, d: rounded(vision.letterbox(resize(X.img_embeddings(spark, d), (8, 4), interpolation=S.NEAREST, keys=["vec_id"], size=(8, 8)), (8, 4), (12, 10), ["vec_id"]), "c0"), f"WITH {X.SQL['img']}, half AS (SELECT vec_id, y // 2 AS y, x, c0 FROM img WHERE y % 2 = 0), {T.resized('half', 'vec_id', S.LANCZOS4, 8, 4, 12, 6, ['c0'], 'z')} SELECT i.vec_id, g.id::INT // 12 AS y, g.id::INT % 12 AS x, round(coalesce(z.c0, 0e0), 6) + 0e0 AS c0 FROM (SELECT DISTINCT vec_id FROM img) i CROSS JOIN range(120) g(id) LEFT JOIN z ON z.vec_id = i.vec_id AND z.y = g.id // 12 AND z.x = g.id % 12")


def embedding_l2norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = vision.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3.0 + 0.1))
    return rounded(t.select("vec_id", F.posexplode(e).alias("i", "v")), "v")


add("embedding_l2norm", embedding_l2norm, "WITH e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE * 3 + 0.1e0 AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)) SELECT vec_id, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0e0 AS v FROM e")


def latent_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rounded(vision.latent(t, X.emap_gen(spark), "vec_id", "e"), "v")


add("latent_projection", latent_projection, f"WITH {X.SQL['emap']}, e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)), l AS (SELECT vec_id, j, sum(x * w) AS v FROM e JOIN emap USING (i) GROUP BY ALL) SELECT vec_id, j::INT AS j, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0e0 AS v FROM l")
add("paste_mask", lambda spark, d: rounded(vision.paste_mask(spark, (30, 35)), "c0"), T.paste_mask(30, 35))
_PASTE = ((0.7137, 0.1312, -2.0313), (-0.1123, 0.7291, 1.0711))
add("paste_back", lambda spark, d: rounded(vision.paste_back(_large(spark, d), X.img_embeddings(spark, d, 3), _PASTE, (24, 24), None, ["vec_id"], (8, 8)), "c0", "c1", "c2"), f"WITH {X.SQL['img']}, {T.LARGE}, src AS (SELECT *, 1e0 AS one FROM img), {T.warped('src', _PASTE, 8, 8, 24, 24, A.auto_mode(A.get_inverse_matrix(_PASTE)), ['c0', 'c1', 'c2', 'one'], 'z')} SELECT vec_id, y::INT AS y, x::INT AS x, " + ", ".join(f"round(z.one * z.c{i} + (1 - z.one) * big.c{i}, 6) + 0e0 AS c{i}" for i in range(3)) + " FROM big JOIN z USING (vec_id, y, x)")


def to_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = vision.to_blob(X.img_embeddings(spark, sf_dir, 3), 2.0, (0.1, 0.2, 0.3), True, keys=["vec_id"])
    return b.select("vec_id", F.posexplode("blob").alias("i", "v")).select("vec_id", "i", (F.round(F.col("v").cast("double"), 5) + 0.0).alias("v"))


add("to_blob", to_blob, f"WITH {X.SQL['img']} " + " UNION ALL ".join(f"SELECT vec_id, ({64 * k} + y * 8 + x)::INT AS i, round(((c{2 - k} - {m}) * 2)::FLOAT::DOUBLE, 5) + 0e0 AS v FROM img" for k, m in enumerate(("0.1e0", "0.2e0", "0.3e0"))))

# --- tiles -----------------------------------------------------------------------------------------------------

add("pad_reflect", lambda spark, d: rounded(tiles.add_padding(X.img_embeddings(spark, d), (8, 8), 7, 2, ["vec_id"]), "c0"), f"WITH {X.SQL['img']}, {T.reflect(8, tiles.padded(8, 7, 2))} SELECT vec_id, a.o::INT AS y, b.o::INT AS x, {T.rounded('c0')} FROM img JOIN m a ON img.y = a.s JOIN m b ON img.x = b.s")
add("tile_split", lambda spark, d: rounded(tiles.tile_image(X.img_embeddings(spark, d), (8, 8), 5, 2, ["vec_id"]), "c0"), f"WITH {X.SQL['img']}, {T.tiles(8, tiles.padded(8, 5, 2), 5, 2)} SELECT vec_id, tile_idx::INT AS tile_idx, ty::INT AS y, tx::INT AS x, {T.rounded('c0')} FROM tiles")
add("tile_gaussian_weights", lambda spark, d: rounded(tiles.create_gaussian_weights(spark, 16, 4.0), "g", digits=9), "WITH w AS (SELECT id // 16 AS y, id % 16 AS x, exp(-(pow(-1 + (id // 16) * 2 / 15e0, 2) + pow(-1 + (id % 16) * 2 / 15e0, 2)) / 32e0) AS g FROM range(256) t(id)) SELECT y::INT AS y, x::INT AS x, round(g / sum(g) OVER (), 9) + 0e0 AS g FROM w")


def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles darkened by their number, so that the weights show."""
    t = tiles.tile_image(X.img_embeddings(spark, sf_dir), (8, 8), 5, 2, ["vec_id"]).withColumn("c0", F.col("c0") / (F.col("tile_idx") + 1.0))
    return rounded(tiles.merge_tiles(t, (8, 8), 1, 5, 2, ["vec_id"]), "c0")


add("tile_merge", tile_merge, f"WITH {X.SQL['img']}, {T.tiles(8, tiles.padded(8, 5, 2), 5, 2)}, w0 AS (SELECT id // 5 AS y, id % 5 AS x, exp(-(pow(-1 + (id // 5) * 2 / 4e0, 2) + pow(-1 + (id % 5) * 2 / 4e0, 2)) / 2e0) AS g FROM range(25) t(id)), w AS (SELECT y, x, g / sum(g) OVER () AS g FROM w0) SELECT vec_id, py::INT AS y, px::INT AS x, round(sum(c0 / (tile_idx + 1) * g) / (sum(g) + 1e-8), 6) + 0e0 AS c0 FROM tiles JOIN w ON tiles.ty = w.y AND tiles.tx = w.x WHERE py < 8 AND px < 8 GROUP BY ALL")

# --- whole chains ------------------------------------------------------------------------------------------------


def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.img_embeddings(spark, sf_dir).groupBy("vec_id").agg(F.avg("c0").alias("mean"), F.min("c0").alias("low"), F.max("c0").alias("high"), F.var_pop("c0").alias("var"))
    return rounded(out, "mean", "low", "high", "var")


add("image_stats", image_stats, f"WITH {X.SQL['img']} SELECT vec_id, round(avg(c0), 6) + 0e0 AS mean, round(min(c0), 6) + 0e0 AS low, round(max(c0), 6) + 0e0 AS high, round(var_pop(c0), 6) + 0e0 AS var FROM img GROUP BY vec_id")


def pixel_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swap, reduce, blur and quantize: the usual chain from file to file."""
    px = X.img_embeddings(spark, sf_dir, 3).select("vec_id", "y", "x", *(v.alias(f"c{i}") for i, v in enumerate(K.bgr_to_rgb(*_c()))))
    px = filters.gaussian_blur(resize(px, (16, 16), interpolation=S.LINEAR, keys=["vec_id"], size=(8, 8)), 3, 1.0, keys=["vec_id"], size=(16, 16))
    return px.select("vec_id", "y", "x", *(D.to_uint8(F.round(F.col(c), 9)).alias(c) for c in ("c0", "c1", "c2")))


add("pixel_pipeline", pixel_pipeline, T.pixel_pipeline(filters.create_gaussian_kernel(3, 1.0)))


def grade_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lut.rec709_to_aces2065_1(X.px_lineitem(spark, sf_dir), X.lut_gen(spark))
    return rounded(px.select(*KEYS, *(v.alias(f"c{i}") for i, v in enumerate(K.aces2065_1_to_acescg(*_c())))), "c0", "c1", "c2")


add("grade_pipeline", grade_pipeline, T.lut_query(KEYS, 17, 0, _each(_TONE), T.matrix(K.AP0_TO_AP1, _each("least(greatest(@, 0e0), 1e0)"))))


def image_luma_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean luma and hue by part, each part's pixels taken as an image."""
    h, _, _ = K.rgb_to_hsv(*_c())
    y, _, _ = K.rgb_to_grayscale(*_c())
    out = X.px_lineitem(spark, sf_dir).groupBy("l_partkey").agg(F.avg(y).alias("luma"), F.avg(h).alias("hue"), F.count("*").alias("n"), K.hue_in_range(h).alias("hue_ok"))
    return rounded(out, "luma", "hue")


add("image_luma_hue", image_luma_hue, f"WITH {X.SQL['px']}, {T.POINT} SELECT l_partkey, round(avg({_Y}), 6) + 0e0 AS luma, round(avg(h), 6) + 0e0 AS hue, count(*) AS n, bool_and(h >= 0 AND h <= 1) AS hue_ok FROM hsv GROUP BY l_partkey")


def array_path_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as resize_lanczos3 by matrix products over image rows."""
    images = arrays.pixels_to_images(X.img_embeddings(spark, sf_dir).withColumnRenamed("vec_id", "image_id"), "float64", "gray")
    out = arrays.resize_images(images, 13, 11, S.LANCZOS3, "float64")
    return rounded(arrays.images_to_pixels(out).select(F.col("image_id").alias("vec_id"), "y", "x", "c0"), "c0")


add("array_path_resize", array_path_resize, ORACLES["resize_lanczos3"].replace(f" + {OFF_TIE!r}", ""))


# --- files, models and streams ---------------------------------------------------------------------------------------


def read_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated table written as text and read again."""
    at = scratch.folder(spark, "cube")
    cube.write_lut(X.lut_gen(spark, 5), at)
    return rounded(cube.read_lut(spark, f"{at}/part-*", use_cache=False).select("ri", "gi", "bi", "r", "g", "b"), "r", "g", "b")


add("read_cube", read_cube, f"WITH {X.sql_lut(5)} SELECT ri::INT AS ri, gi::INT AS gi, bi::INT AS bi, {T.rounded('r', 'g', 'b')} FROM lut")


def _rows_of_images(spark: SparkSession, sf_dir: str, dtype: str) -> DataFrame:
    return arrays.pixels_to_images(X.img_embeddings(spark, sf_dir, 3).withColumnRenamed("vec_id", "image_id"), dtype)


def _through_files(rows: DataFrame, suffix: str) -> DataFrame:
    """Images as files and back, as pixels."""
    spark = rows.sparkSession
    at = scratch.folder(spark, suffix)
    done = images.imwrite(rows, at, suffix)
    if done.where("not ok").count():
        raise OSError("an image was not written")
    back = images.imread(spark, at).withColumn("image_id", F.regexp_extract("origin", rf"(\d+)\.{suffix}$", 1).cast("long"))
    px = arrays.images_to_pixels(back.select(*S.IMAGE.fieldNames()))
    return rounded(px.withColumnRenamed("image_id", "vec_id"), "c0", "c1", "c2")


def _steps(n: int) -> str:
    each = ", ".join(f"round(floor(c{i} * {n}e0) / {n}e0, 6) + 0e0 AS c{i}" for i in range(3))
    return f"WITH {X.SQL['img']} SELECT vec_id, y::INT AS y, x::INT AS x, {each} FROM img"


add("imread_imwrite_roundtrip", lambda spark, d: _through_files(_rows_of_images(spark, d, "uint8"), "png"), _steps(255))
add("bmp_roundtrip", lambda spark, d: _through_files(_rows_of_images(spark, d, "uint8"), "bmp"), _steps(255))
add("tif_roundtrip", lambda spark, d: _through_files(_rows_of_images(spark, d, "uint16"), "tif"), _steps(65535))


def exr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of 1/256 are exact as half floats."""
    px = X.img_embeddings(spark, sf_dir, 3).withColumnRenamed("vec_id", "image_id")
    px = px.withColumns({f"c{i}": F.floor(F.col(f"c{i}") * 256.0) / 256.0 for i in range(3)})
    return _through_files(arrays.pixels_to_images(px, "float32"), "exr")


add("exr_roundtrip", exr_roundtrip, _steps(256))


def tile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images stacked to batches of planes and taken apart again."""
    back = arrays.batch_to_tile(arrays.to_batch(_rows_of_images(spark, sf_dir, "float64"), 16))
    return rounded(arrays.images_to_pixels(back).withColumnRenamed("image_id", "vec_id"), "c0", "c1", "c2")


def double_backend(model: bytes):
    """A stand-in for a model: every sample twice in both directions."""
    return lambda x: x.repeat(2, axis=2).repeat(2, axis=3)


def upscale_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infer.upscale(_rows_of_images(spark, sf_dir, "float64"), model_bytes=b"double", backend=double_backend)
    return rounded(arrays.images_to_pixels(out).withColumnRenamed("image_id", "vec_id"), "c0", "c1", "c2")


_SINGLE = ", ".join(f"round(c{i}::FLOAT::DOUBLE, 6) + 0e0 AS c{i}" for i in range(3))
add("upscale_udf", upscale_udf, f"WITH {X.SQL['img']} SELECT vec_id, (y * 2 + dy)::INT AS y, (x * 2 + dx)::INT AS x, {_SINGLE} FROM img, range(2) a(dy), range(2) b(dx)")


add("tile_batches", tile_batches, f"WITH {X.SQL['img']} SELECT vec_id, y::INT AS y, x::INT AS x, {_SINGLE} FROM img")


def swap_backend(model: bytes):
    """A stand-in for a model: the crop with the first value of the latent vector added."""
    return lambda x, latent: [x + latent[:, :1, None, None]]


def swap_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of one colour, redrawn by a model of crops and latent vectors."""
    rows = X.img_embeddings(spark, sf_dir, 3).where("y = 0 and x = 0").withColumnRenamed("vec_id", "image_id")
    crops = arrays.resize_images(arrays.pixels_to_images(rows, "float64"), 4, 4, S.NEAREST, "float64")
    latents = rows.select("image_id", F.array((F.col("c1") / 4.0).cast("float")).alias("latent"))
    out = faces.swap(crops, latents, model_bytes=b"swap", backend=swap_backend)
    return arrays.images_to_pixels(out).select(F.col("image_id").alias("vec_id"), "y", "x", *(F.round(f"c{i}", 4).alias(f"c{i}") for i in range(3)))


add("swap_faces", swap_faces, f"WITH {X.SQL['img']} SELECT vec_id, a.y::INT AS y, b.x::INT AS x, " + ", ".join(f"round(least(c{i} + c1 / 4, 1e0), 4) AS c{i}" for i in range(3)) + " FROM (SELECT * FROM img WHERE y = 0 AND x = 0) i, range(4) a(y), range(4) b(x)")


def stream_grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that arrive as files, through a stream into files."""
    at = scratch.folder(spark, "stream")
    px = X.px_lineitem(spark, sf_dir)
    px.write.parquet(f"{at}/in")
    out = frames.grayscale(spark.readStream.schema(px.schema).parquet(f"{at}/in")).select(*KEYS, "luma")
    run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.schema(out.schema).parquet(f"{at}/out"), "luma")


add("stream_grayscale", stream_grayscale, f"WITH {X.SQL['px']} SELECT {', '.join(KEYS)}, round({_Y}, 6) + 0e0 AS luma FROM px")


def face_align_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector outputs to the alignment matrix of each image's largest face."""
    boxes = vision.decode_heads(X.heads_gen(spark, sf_dir), (32, 32), 2, 0.5).withColumn("id", F.col("anchor_idx").cast("long"))
    best = vision.top_faces(vision.nms(boxes), 1, (32, 32), "max").select("image_id", "id")
    out = boxes.join(best, ["image_id", "id"]).select("image_id", "id", A.crop_matrix(F.col("kps"), 112).alias("m")).select("image_id", "id", "m.*")
    return rounded(out, *out.columns[2:])


_FACES = f"SELECT image_id AS img, anchor_idx AS id, score, {_AX} - d0 * 8 AS x1, {_AY} - d1 * 8 AS y1, {_AX} + d2 * 8 AS x2, {_AY} + d3 * 8 AS y2, " + ", ".join(f"greatest({a} + k{2 * k + j} * 8, 0e0) AS p{k}{j}" for k in range(5) for j, a in enumerate((_AX, _AY))) + " FROM heads WHERE score >= 0.5"
_POINTS = " UNION ALL ".join(f"SELECT img AS image_id, id, {k} AS k, p{k}0 AS sx, p{k}1 AS sy FROM best" for k in range(5))
add("face_align_pipeline", face_align_pipeline, f"WITH {X.SQL['heads']}, faces AS ({_FACES}), kept AS ({T.nms('boxes AS (SELECT img, id, score, x1, y1, x2, y2 FROM faces)', 0.4)}), best AS (SELECT faces.* FROM faces JOIN kept USING (img, id) QUALIFY row_number() OVER (PARTITION BY img ORDER BY (x2 - x1) * (y2 - y1) DESC, id) = 1), {T.crop_matrix(A.TEMPLATE, _POINTS, 'image_id, id')} SELECT image_id, id::BIGINT AS id, {T.rounded(*T.MATRIX)} FROM m")

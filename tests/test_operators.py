"""Properties, both physical paths, and the kept or mended peculiarities."""
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.functions import color as K
from rasterloom.functions import dtype as D
from rasterloom.functions import sql as Q
from rasterloom.operators import affine, arrays, chroma, filters, infer, lut, pixels, tiles, vision
from rasterloom.operators import faces as faces_op
from rasterloom.operators.resample import resize

rng = np.random.default_rng(42)


def px_of(spark, a, image_id=1):
    h, w, c = a.shape
    rows = [(image_id, y, x, *map(float, a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, " + ", ".join(f"c{k} double" for k in range(c)))


def array_of(df, image_id=None):
    p = df.toPandas()
    p = p[p.image_id == image_id] if image_id is not None else p
    cs = pixels.channels(df)
    out = np.full((p.y.max() + 1, p.x.max() + 1, len(cs)), np.nan)
    out[p.y, p.x] = p[cs]
    assert not np.isnan(out).any()
    return out


def colors(spark, f, values):
    df = spark.createDataFrame([tuple(map(float, v)) for v in values], "c0 double, c1 double, c2 double")
    out = df.select(*(v.alias(n) for v, n in zip(f(F.col("c0"), F.col("c1"), F.col("c2")), "abc"))).collect()
    return np.array([tuple(r) for r in out])


VALUES = np.vstack([rng.random((300, 3)), [[0, 0, 0], [1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0.5, 0.5, 0.5]]])


@pytest.mark.parametrize("there, back, tolerance", [
    (K.rgb_to_bgr, K.bgr_to_rgb, 0), (K.rgb_to_hsv, K.hsv_to_rgb, 1e-9), (K.bgr_to_hsv, K.hsv_to_bgr, 1e-9), (K.rgb_to_ycbcr, K.ycbcr_to_rgb, 0.01),
    (K.bgr_to_ycbcr, K.ycbcr_to_bgr, 0.01), (K.ycbcr_full_to_legal, K.ycbcr_legal_to_full, 1e-9), (K.aces2065_1_to_acescg, K.acescg_to_aces2065_1, 0.6),
])
def test_round_trips(spark, there, back, tolerance):
    assert np.abs(colors(spark, back, colors(spark, there, VALUES)) - VALUES).max() <= tolerance


def test_acescct_published_curve(spark):
    gray = np.repeat(np.linspace(0, 1, 50)[:, None], 3, axis=1)
    both = lambda spec: colors(spark, lambda *c: K.acescct_to_aces2065_1(*K.aces2065_1_to_acescct(*c, spec=spec), spec=spec), gray)
    assert np.abs(both(True) - gray).max() < 1e-4
    ours = colors(spark, K.aces2065_1_to_acescct, [[0.5, 0.5, 0.5]])
    assert ours[0, 0] == pytest.approx((10.5402377416545 * 0.5 + 0.0729055341958355) / 17.52, abs=1e-6)


def test_sample_types(spark):
    v = np.array([-0.5, 0.0, 0.1, 0.5, 0.999, 1.0, 2.0])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(D.to_uint8(F.col("v"))) == [0, 0, 25, 127, 254, 255, 255]  # truncated
    assert get(D.to_uint16(F.col("v"))) == [int(min(max(x * 65535, 0), 65535)) for x in v]
    assert get(D.to_float32(F.col("v"))) == [min(max(x, 0), 1) for x in v]
    assert get(D.to_float64(F.col("v"))) == v.tolist()
    for bad in ("int8", "float64"):
        with pytest.raises(ValueError):
            D.to_dtype(F.col("v"), bad)
    with pytest.raises(ValueError):
        D.to_float32(F.col("v"), "bool")


def test_half_precision(spark):
    v = np.concatenate([rng.normal(0, 1, 300), 2.0 ** np.arange(-26, 16), [0, 65504, 65519, 65520, 1e9, -1e9, 6e-8, 3e-5, 0.1]])
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select(D.half(F.col("v"))).collect()
    with np.errstate(over="ignore"):
        assert [r[0] for r in rows] == v.astype(np.float16).astype(float).tolist()


@pytest.mark.parametrize("mode", [m for m in S.MODES.values() if m != S.AUTO])
@pytest.mark.parametrize("shape, out", [((5, 7, 3), (11, 4)), ((6, 4, 1), (3, 9)), ((4, 4, 4), (1, 1)), ((3, 5, 2), (5, 3))])
def test_resize_paths_agree(spark, mode, shape, out):
    a = rng.random(shape)
    ours = array_of(resize(px_of(spark, a), out, interpolation=mode))
    assert ours.shape == (out[1], out[0], shape[2])
    assert np.abs(ours - arrays.resize_array(a, *out, mode)).max() < 1e-9


def test_resize_many_sizes_factors_and_errors(spark):
    a, b = rng.random((4, 6, 1)), rng.random((8, 2, 1))
    px = px_of(spark, a, 1).unionByName(px_of(spark, b, 2))
    out = resize(px, (5, 5))  # AREA for both, each from its own size
    for k, x in ((1, a), (2, b)):
        assert np.abs(array_of(out, k) - arrays.resize_array(x, 5, 5)).max() < 1e-9
    scaled = array_of(resize(px_of(spark, a), fx=1.5, fy=0.5, interpolation="linear"))
    assert scaled.shape == (2, 9, 1)  # rows by fy, columns by fx
    with pytest.raises(ValueError):
        resize(px, fx=2.0)
    with pytest.raises(ValueError):
        resize(px, (2, 2), interpolation=99)


def test_warp_identity_shift_and_zero_outside(spark):
    a = rng.random((9, 9, 3))
    px = px_of(spark, a)
    same = array_of(affine.affine_transform(px, ((1, 0, 0), (0, 1, 0)), (9, 9), S.LINEAR))
    assert np.abs(same - a).max() < 1e-12
    moved = array_of(affine.affine_transform(px, ((1, 0, 2), (0, 1, 1), (0, 0, 1)), (9, 9), "nearest"))
    assert (moved[1:, 2:] == a[:-1, :-2]).all() and (moved[0] == 0).all() and (moved[:, :2] == 0).all()
    with pytest.raises(ValueError):
        affine.affine_transform(px, ((1, 0, 0), (2, 0, 0)), (9, 9))
    with pytest.raises(ValueError):
        affine.get_inverse_matrix([[1, 2]])
    by = affine.affine_transform_by(px, spark.createDataFrame([(1,)], "image_id long").select("image_id", affine.matrix_column(((1, 0, 2), (0, 1, 1))).alias("matrix")), (9, 9), "nearest")
    assert (array_of(by) == moved).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=6, max_size=6))
def test_inverse_matrix(m):
    m = (tuple(m[:3]), tuple(m[3:]))
    det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    if abs(det) < 1e-3:
        return
    full = lambda r: np.array([*r, (0, 0, 1)])
    assert np.allclose(full(affine.get_inverse_matrix(m)) @ full(m), np.eye(3), atol=1e-6)


def test_alignment_equals_svd(spark):
    pts = rng.normal(0, 30, (20, 5, 2)) + np.array(affine.TEMPLATE)
    rows = [(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "image_id long, kps array<struct<x: double, y: double>>")
    for size in (112, 256):
        dst = np.array(affine.template(size))
        for r in df.select("image_id", affine.crop_matrix(F.col("kps"), size).alias("m")).collect():
            src = pts[r["image_id"]]
            s, d = src - src.mean(0), dst - dst.mean(0)
            u, _, vt = np.linalg.svd(d.T @ s)
            if np.linalg.det(u @ vt) < 0:
                u[:, -1] *= -1
            scale = np.linalg.norm(d, axis=1).sum() / np.linalg.norm(s, axis=1).sum()
            m = np.c_[scale * u @ vt, dst.mean(0) - scale * u @ vt @ src.mean(0)]
            assert np.allclose([list(r["m"])[:3], list(r["m"])[3:]], m, atol=1e-8)
    assert affine.template(256)[0][0] == pytest.approx(38.2946 * 2 + 16)


def test_crop_of_faces(spark):
    px = px_of(spark, rng.random((40, 40, 3)))
    kps = spark.createDataFrame([(1, [(float(x) / 3, float(y) / 3) for x, y in affine.TEMPLATE])], "image_id long, kps array<struct<x: double, y: double>>")
    crops, matrices = vision.crop_faces(px, kps, 16)
    assert array_of(crops).shape == (16, 16, 3)
    want = kps.select(affine.crop_matrix(F.col("kps"), 32).alias("m")).first()["m"]
    assert list(matrices.first()["matrix"]) == pytest.approx([v / 2 for v in want])


def test_blur(spark):
    a = rng.random((9, 7, 4))
    for k, sigma in ((3, 1.0), (4, 0.7), (9, 3.0)):
        ours = array_of(filters.gaussian_blur(px_of(spark, a), k, sigma))
        assert np.abs(ours - arrays.blur_array(a, k, sigma)).max() < 1e-9
        assert abs(ours.mean() - a.mean()) < 0.05 and ours.var() < a.var()
    assert len(filters.create_gaussian_kernel(4, 1.0)) == 5
    with pytest.raises(ValueError):
        filters.create_gaussian_kernel(3, 0)
    g = filters.GaussianBlur()
    px = px_of(spark, a)
    assert np.allclose(array_of(g.get(px, 3, 1.0)), arrays.blur_array(a, 3, 1.0)) and g._made[0] == (3, 1.0)


def test_erode(spark):
    a = rng.random((6, 5, 2))
    for mask in (np.ones((3, 3), int), np.ones((4, 4), int), np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]])):
        k = len(mask)
        for border in (0.0, 1.0):
            want = np.ones_like(a)
            for y in range(6):
                for x in range(5):
                    for i, j in zip(*np.nonzero(mask)):
                        yy, xx = y + i - k // 2, x + j - k // 2
                        want[y, x] = np.minimum(want[y, x], a[yy, xx] if 0 <= yy < 6 and 0 <= xx < 5 else border)
            given_mask = None if mask.all() else mask.tolist()
            assert np.abs(array_of(filters.erode(px_of(spark, a), k, given_mask, border)) - want).max() < 1e-12


def test_lut(spark):
    n = 5
    t = rng.random((n, n, n, 3))
    rows = [(n, i, j, k, *map(float, t[i, j, k])) for i in range(n) for j in range(n) for k in range(n)]
    table = spark.createDataFrame(rows, S.LUT)
    same = spark.createDataFrame([(n, i, j, k, i / (n - 1), j / (n - 1), k / (n - 1)) for i in range(n) for j in range(n) for k in range(n)], S.LUT)
    a = np.vstack([VALUES, [[1.5, -1, 0.3]]]).reshape(1, -1, 3)
    px = px_of(spark, a)
    for mode in (lut.TRILINEAR, lut.TETRAHEDRAL):
        assert np.abs(array_of(lut.apply_lut(px, same, mode)) - np.clip(a, 0, 1)).max() < 1e-12
    s = np.clip(a, 0, 1) * (n - 1)
    low = np.minimum(s.astype(int), n - 2)
    f = s - low
    want = np.zeros_like(a)
    for c in np.ndindex(2, 2, 2):
        w = np.prod([np.where(c[k], f[..., k], 1 - f[..., k]) for k in range(3)], axis=0)
        want += w[..., None] * t[low[..., 0] + c[0], low[..., 1] + c[1], low[..., 2] + c[2]]
    assert np.abs(array_of(lut.apply_lut(px, table)) - want).max() < 1e-12
    few = lut.CELLS
    for mode in (lut.TRILINEAR, lut.TETRAHEDRAL):  # the way of large tables gives the same
        cells = array_of(lut.apply_lut(px, table, mode))
        try:
            lut.CELLS = 0
            assert np.abs(array_of(lut.apply_lut(px, table, mode)) - cells).max() < 1e-12
        finally:
            lut.CELLS = few
    with pytest.raises(ValueError):
        lut.apply_lut(px, table, 2)
    with pytest.raises(ValueError):
        lut.apply_lut(px, table.where("bi > 0"))


def test_raw_frames(spark):
    frame = bytes(rng.integers(0, 256, 96, dtype=np.uint8))
    df = spark.createDataFrame([(1, frame), (2, b"")], "frame_id long, data binary")
    rows = chroma.frames_from_binary(df)
    assert {r["frame_id"]: bytes(r["bytes"]) for r in rows.collect()} == {1: frame, 2: b""}
    one = rows.where("frame_id = 1")
    with pytest.raises(ValueError):
        chroma.yuv420p_to_ycbcr444(one, 8, 8, 2)
    out = chroma.yuv420p_to_ycbcr444(one, 8, 8).toPandas()
    assert len(out) == 64 and out.c0.max() <= 1
    near = chroma.yuv420p_to_ycbcr444(one, 8, 8, S.NEAREST).toPandas()
    assert near.c0.min() >= 0 and not np.allclose(near.sort_values(["y", "x"]).c0, out.sort_values(["y", "x"]).c0)  # luma expanded


def test_nms_and_top(spark):
    boxes = [(1, i, float(s), *map(float, b)) for i, (s, b) in enumerate([(0.9, (0, 0, 10, 10)), (0.9, (1, 1, 11, 11)), (0.8, (50, 50, 60, 60)), (0.7, (0, 0, 9, 30)), (0.95, (52, 50, 62, 60))])]
    df = spark.createDataFrame(boxes, "image_id long, id long, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["id"] for r in vision.nms(df).collect()) == [0, 3, 4]
    assert vision.top_faces(df, 0, (64, 64)).count() == 5
    assert [r["id"] for r in vision.top_faces(df, 1, (64, 64), "max").collect()] == [3]
    assert vision.head_layout(9) == (3, (8, 16, 32), 2, True)
    with pytest.raises(ValueError):
        vision.head_layout(4)


def test_letterbox_and_blob(spark):
    a = rng.random((4, 8, 3))
    out = array_of(vision.letterbox(px_of(spark, a), (8, 4), (16, 16)))
    assert out.shape == (16, 16, 3) and (out[8:] == 0).all() and np.abs(out[:8] - arrays.resize_array(a, 16, 8)).max() < 1e-9
    assert vision.letterbox_size((100, 200), (640, 640)) == (320, 640, 3.2)
    blob = vision.to_blob(px_of(spark, a), 2.0, (0.5, 0.4, 0.3), True).first()["blob"]
    want = ((a[:, :, ::-1] - [0.5, 0.4, 0.3]) * 2).transpose(2, 0, 1).ravel()
    assert np.allclose(blob, want, atol=1e-6)


def test_paste_back(spark):
    target, paste = rng.random((12, 12, 3)), rng.random((6, 6, 3))
    m = ((0.5, 0, 0), (0, 0.5, 0))
    out = array_of(vision.paste_back(px_of(spark, target), px_of(spark, paste), m, (12, 12)))
    assert out.shape == target.shape and (out >= 0).all() and (out <= 1.2).all()
    done = vision.PasteBack(spark)
    first = done.get(px_of(spark, target), px_of(spark, paste), m, (12, 12), (6, 6))
    assert np.abs(array_of(first) - target).max() < 1e-9  # a plate of 6 pixels has no frame, so its mask is blank
    mask = done._mask
    done.get(px_of(spark, target), px_of(spark, paste), m, (12, 12), (6, 6))
    assert done._mask is mask


def test_tiles(spark):
    a = rng.random((11, 9, 2))
    px = px_of(spark, a)
    cut = tiles.tile_image(px, (11, 9), 6, 2)
    assert cut.groupBy("tile_idx").count().where("count <> 36").count() == 0
    assert np.abs(array_of(tiles.merge_tiles(cut, (11, 9), 1, 6, 2)) - a).max() < 1e-6
    padded = array_of(tiles.add_padding(px, (11, 9), 6, 2))
    want = np.pad(a, ((0, padded.shape[0] - 11), (0, padded.shape[1] - 9), (0, 0)), mode="reflect")
    assert (padded == want).all()
    tiny = rng.random((3, 4, 1))
    assert array_of(tiles.add_padding(px_of(spark, tiny), (3, 4), 8, 2)).shape == (8, 8, 1)  # wider than the image


def test_sql_functions(spark):
    names = Q.register(spark)
    assert "px_rgb_luma" in names
    plan = spark.sql("SELECT px_rgb_luma(id / 10e0, 0e0, 0e0) AS v FROM range(3)")
    assert "Python" not in plan._jdf.queryExecution().toString()
    assert [round(r["v"], 5) for r in plan.collect()] == [0, 0.02126, 0.04252]


def test_point_plan_has_no_exchange(spark, sf_dir):
    from rasterloom.plans import catalogue

    text = catalogue.QUERIES["rgb_to_hsv"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "l_shipdate" not in text and "WholeStageCodegen" not in text.replace("*(1)", "") and "*(1) Project" in text


def doubled(model):
    return lambda x: np.repeat(np.repeat(x, 2, axis=2), 2, axis=3)


def image_rows(spark, arrays_, dtype="uint8", space="bgr"):
    rows = [(i, "", a.shape[0], a.shape[1], a.shape[2], dtype, space, bytearray(arrays.encode_data(a, dtype))) for i, a in enumerate(arrays_)]
    return spark.createDataFrame(rows, S.IMAGE)


def test_inference(spark):
    images = image_rows(spark, [rng.random((3, 4, 3)), rng.random((5, 2, 1)), rng.random((2, 2, 4))], "float32")
    out = {r["image_id"]: r for r in infer.upscale(images, model_bytes=b"fake", backend=doubled).collect()}
    assert (out[0]["height"], out[0]["width"], out[1]["channels"]) == (6, 8, 3)
    a = arrays.decode_data(images.first()["data"], 3, 4, 3, "float32")
    b = arrays.decode_data(out[0]["data"], 6, 8, 3, "float32")
    assert (b[::2, ::2] == a).all()
    with pytest.raises(ValueError):
        infer.model_bytes_of()
    with pytest.raises(ValueError):
        infer.model_bytes_of("x", b"y")
    e = infer.embed(images.where("channels = 3"), model_bytes=b"fake", backend=lambda m: lambda x: x[:, :, :1, :1]).first()
    assert math.isclose(sum(v * v for v in e["normed_embedding"]), 1, rel_tol=1e-5) and len(e["embedding"]) == 3


def test_array_path_pixels(spark):
    a = rng.random((4, 5, 3))
    px = arrays.images_to_pixels(image_rows(spark, [a], "float64"))
    assert np.allclose(array_of(px), a)
    back = arrays.pixels_to_images(px, "uint16").first()
    assert (arrays.decode_data(back["data"], 4, 5, 3, "uint16") == np.floor(a * 65535)).all()
    blurred = arrays.blur_images(image_rows(spark, [a], "float64"), 3, 1.0, "float64").first()
    assert np.allclose(arrays.decode_data(blurred["data"], 4, 5, 3, "float64"), arrays.blur_array(a, 3, 1.0))
    with pytest.raises(ValueError):
        arrays.decode_data(b"", 0, 0, 3, "int8")


def fake_detector(model):
    """One face per image at stride 8, anchor 3, a weaker copy beside it and noise below the score."""

    def run(x):
        out = []
        for part, n in ((0, 1), (1, 4), (2, 10)):
            for stride in (8, 16, 32):
                cells = 2 * (64 // stride) ** 2
                a = np.full((cells, n), 0.1 if n == 1 else 1.0, np.float32)
                if stride == 8 and n == 1:
                    a[40], a[41] = 0.9, 0.8
                out.append(a)
        return out

    return run


def test_face_chain(spark):
    images = image_rows(spark, [rng.random((32, 64, 3)), rng.random((64, 64, 3))])
    faces = faces_op.detect(images, model_bytes=b"x", input_size=(64, 64), backend=fake_detector)
    rows = {r["image_id"]: r for r in faces.collect()}
    assert set(rows) == {0, 1} and all(r["face_idx"] == 0 for r in rows.values())  # the copy is suppressed
    cell = 40 // 2
    x, y = cell % 8 * 8, cell // 8 * 8
    assert (rows[1]["x1"], rows[1]["y1"], rows[1]["x2"], rows[1]["y2"]) == (x - 8, y - 8, x + 8, y + 8)
    assert (rows[1]["kps"][0]["x"], rows[1]["kps"][0]["y"]) == (x + 8, y + 8)
    assert faces_op.detect(images, model_bytes=b"x", input_size=(64, 64), max_num=1, metric="max", backend=fake_detector).count() == 2
    with pytest.raises(ValueError):
        faces_op.heads(images, model_bytes=b"x", outputs=6)
    near = spark.createDataFrame([(i, 0, [(float(px) / 3, float(py) / 3) for px, py in affine.TEMPLATE]) for i in (0, 1)], "image_id long, face_idx int, kps array<struct<x: double, y: double>>")
    crops, matrices = faces_op.align(images, near, 8)
    assert crops.count() == 2 * 64 and matrices.count() == 2
    latents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "image_id long, latent array<double>")
    out = faces_op.swap(images, latents, model_bytes=b"x", backend=lambda m: lambda a, z: [np.full_like(a, z[0, 0])]).collect()
    assert {r["image_id"]: float(arrays.decode_data(r["data"], r["height"], r["width"], 3, "float32").mean()) for r in out} == {0: 1.0, 1: 0.0}


def test_face_records(spark):
    images = image_rows(spark, [rng.random((32, 64, 3)), rng.random((64, 64, 3))])
    found = faces_op.detect(images, model_bytes=b"x", input_size=(64, 64), backend=fake_detector)
    kps = F.array(*(F.struct(F.lit(x / 3).alias("x"), F.lit(y / 3).alias("y")) for x, y in affine.TEMPLATE))
    rows = faces_op.records(images, found.withColumn("kps", kps), 8)
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema] == [(f.name, f.dataType.simpleString()) for f in S.FACE]
    got = rows.collect()
    assert len(got) == 2
    for r in got:
        assert (r["image"]["height"], r["image"]["width"], r["image"]["channels"]) == (8, 8, 3) and r["bbox"]["x2"] > r["bbox"]["x1"]
        want = array_of(faces_op.align(images.where(F.col("image_id") == r["image_id"]), found.withColumn("kps", kps), 8)[0].drop("face_idx"))
        assert np.abs(arrays.decode_data(r["image"]["data"], 8, 8, 3, "float32") - want).max() < 1e-6


def message(*fields):
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
    return b"".join(bytes([k << 3 | 2]) + size(len(v)) + v for k, v in fields)


def test_model_set_up():
    node = lambda name: (1, message((1, b"x"), (3, name)))
    own = message((7, message(node(b"Sub_0"), node(b"Mul_1"), (12, b"a"))))
    plain = b"\x08\x07" + message((7, message(*[node(b"Conv")] * 8, node(b"Sub"), node(b"Mul"), *[(12, b"o")] * 9)))
    assert infer.normalisation(own) == (0.0, 1.0) and infer.outputs_of(own) == 1
    assert infer.normalisation(plain) == (0.5, 0.5) and infer.outputs_of(plain) == 9
    opened = []
    both = [infer.session_of(lambda m, k=k: opened.append(m) or k, b"model") for k in (1, 1)]
    assert len(both) == 2 and len(opened) == 1


def test_batches(spark):
    a = [rng.random((4, 6, 3)) for _ in range(5)] + [rng.random((2, 2, 3))]
    images = image_rows(spark, a, "float64").coalesce(1)
    blobs = arrays.to_blobs(images, 2.0, None, (0.1, 0.2, 0.3), True, True, 2).collect()
    assert sorted(r["n"] for r in blobs) == [1, 1, 2, 2] and {r["dtype"] for r in blobs} == {"float16"}
    for r in blobs:
        planes = np.frombuffer(r["data"], "<f2").reshape(r["n"], 3, r["height"], r["width"])
        for i, p in zip(r["image_ids"], planes):
            assert np.abs(p - ((a[i] - [0.1, 0.2, 0.3]) * 2)[:, :, ::-1].transpose(2, 0, 1)).max() < 2e-3
    assert {(r["height"], r["width"]) for r in arrays.to_blobs(images, size=(3, 5)).collect()} == {(5, 3)}
    back = arrays.batch_to_tile(arrays.to_batch(images, 4)).collect()
    assert all(np.abs(arrays.decode_data(r["data"], r["height"], r["width"], 3, "float32") - a[r["image_id"]]).max() < 1e-6 for r in back) and len(back) == 6


def test_api_names():
    from rasterloom import api

    assert {"imread", "imwrite", "resize", "affine_transform", "apply_lut", "INTER_AUTO", "GaussianBlur", "Face", "nms"} <= set(api.__all__)

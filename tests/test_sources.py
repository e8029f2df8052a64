"""Files in and out, tables as text, raw video, and streams."""
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import schema as S
from rasterloom.operators import arrays
from rasterloom.sources import cube, exr, images, jpegfile, rawvideo
from rasterloom.streaming import frames

from .test_operators import image_rows

rng = np.random.default_rng(7)


@pytest.mark.parametrize("suffix, dtype", [("png", "uint8"), ("png", "uint16"), ("PNG", "float32"), ("bmp", "uint8"), ("tiff", "uint8"), ("tif", "uint16")])
def test_write_and_read(spark, tmp_path, suffix, dtype):
    a = [rng.random((5, 7, 3)), rng.random((3, 2, 3))]
    rows = image_rows(spark, a, dtype)
    done = images.imwrite(rows, str(tmp_path / "out"), suffix).collect()
    assert all(r["ok"] for r in done)
    kind = "uint16" if dtype == "float32" else dtype
    got = images.imread(spark, str(tmp_path / "out")).collect()
    assert {r["dtype"] for r in got} == {kind} and {r["space"] for r in got} == {"bgr"}
    want = {arrays.encode_data(np.asarray(arrays.decode_data(arrays.encode_data(x, dtype), *x.shape, dtype), np.float64) if dtype == "float32" else arrays.decode_data(arrays.encode_data(x, dtype), *x.shape, dtype), kind) for x in a}
    assert {bytes(r["data"]) for r in got} == want
    rgb = images.imread(spark, str(tmp_path / "out"), is_rgb=True).collect()
    first = next(r for r in got if r["height"] == 5)
    other = next(r for r in rgb if r["height"] == 5)
    assert (arrays.decode_data(other["data"], 5, 7, 3, kind)[:, :, ::-1] == arrays.decode_data(first["data"], 5, 7, 3, kind)).all()


def test_read_errors_and_unwritable(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        images.imread(spark, str(tmp_path / "missing.png"))
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="cannot decode"):
        images.imread(spark, str(tmp_path / "bad.png")).collect()
    done = images.imwrite(image_rows(spark, [rng.random((2, 2, 3))]), str(tmp_path / "x"), "webp").collect()
    assert [r["ok"] for r in done] == [False]


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.clip(np.stack([np.sin(x / 9) * 0.4 + 0.5, np.cos(y / 7) * 0.4 + 0.5, (x + y) / (h + w)], axis=2), 0, 1)


@pytest.mark.parametrize("quality, least", [(-1, 45), (90, 36), (30, 28)])
def test_jpeg_is_read_by_another_decoder(spark, tmp_path, quality, least):
    """Written files through Spark's own image source, beside a PNG in one folder."""
    a = [smooth(37, 50), smooth(8, 8), np.full((5, 3, 3), 0.25), rng.random((16, 16, 3)) * 0.5 + smooth(16, 16) * 0.5]
    out = str(tmp_path / "out")
    assert all(r["ok"] for r in images.imwrite(image_rows(spark, a, "float32"), out, "jpg", quality).collect())
    images.imwrite(image_rows(spark, a[:1], "uint8"), out, "png").collect()
    got = images.imread(spark, out).collect()
    assert len(got) == 5
    for k, x in enumerate(a[:3]):
        r = next(r for r in got if r["origin"].endswith(f"/{k}.jpg"))
        back = arrays.decode_data(r["data"], r["height"], r["width"], 3, "uint8", unit=True)
        assert arrays.psnr(back, np.floor(x * 255) / 255) > least
    sizes = {q: len(jpegfile.encode_jpeg((smooth(64, 64) * 255).astype(np.uint8), q)) for q in (30, 90, 100)}
    assert sizes[30] < sizes[90] < sizes[100]


def test_jpeg_codes_and_gray(spark, tmp_path):
    skewed = {s: 1 << min(s, 40) for s in range(60)}
    lengths = dict(jpegfile.code_lengths(skewed))
    assert max(lengths.values()) <= 16 and sum(2.0**-d for d in lengths.values()) < 1 and lengths[59] <= lengths[0]
    assert dict(jpegfile.code_lengths({5: 9})) == {5: 1}
    gray = (smooth(20, 20)[:, :, :1] * 255).astype(np.uint8)
    (tmp_path / "g.jpg").write_bytes(jpegfile.encode_jpeg(gray))
    r = images.imread(spark, str(tmp_path / "g.jpg")).first()
    assert arrays.psnr(arrays.decode_data(r["data"], 20, 20, 3, "uint8", unit=True), np.repeat(gray, 3, axis=2) / 255) > 45


@pytest.mark.parametrize("compression", [0, 2, 3])
@pytest.mark.parametrize("kind, name", [(1, "float16"), (2, "float32")])
def test_exr_round_trip(compression, kind, name):
    for shape in ((1, 1, 3), (37, 20, 3), (16, 5, 3)):
        a = (rng.random(shape) * 40 - 3).astype(name)
        back = exr.decode_exr(exr.encode_exr(a, kind, compression))
        assert back.dtype == name and (back == a).all()
    with pytest.raises(RuntimeError, match="cannot decode"):
        images.decode(exr.encode_exr(a, kind, compression).replace(b"compression\x00compression\x00\x01\x00\x00\x00" + bytes([compression]), b"compression\x00compression\x00\x01\x00\x00\x00\x09"))


def test_exr_rows(spark, tmp_path):
    a = smooth(20, 9)
    assert images.imwrite(image_rows(spark, [a], "float32"), str(tmp_path), "exr").first()["ok"]
    r = images.imread(spark, str(tmp_path)).first()
    assert (r["dtype"], r["space"], r["height"], r["width"]) == ("float16", "bgr", 20, 9)
    assert np.abs(arrays.decode_data(r["data"], 20, 9, 3, "float16") - a).max() < 1e-3


@pytest.mark.parametrize("compression", [1, 5, 8, 32946])
def test_tiff_compression(compression):
    for a in (rng.integers(0, 256, (60, 90, 3), dtype=np.uint8), np.zeros((70, 200, 3), np.uint8), (smooth(90, 80) * 65535).astype(np.uint16)):
        assert (images.decode_tiff(images.encode_tiff(a, compression)) == a).all()
    with pytest.raises(ValueError):
        images.encode_tiff(a, 7)


def test_lzw():
    for n in (0, 1, 2, 255, 256, 257, 5000, 40_000):
        for top in (2, 256):
            data = rng.integers(0, top, n, dtype=np.uint8).tobytes()
            assert images.unlzw(images.lzw(data)) == data


def test_png_filters_gray_and_alpha():
    a = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    raw = bytearray()
    prior = np.zeros(15, np.int64)
    for y in range(6):
        line, kind = a[y].reshape(-1).astype(np.int64), y % 5
        left = np.r_[np.zeros(3, np.int64), line[:-3]]
        corner = np.r_[np.zeros(3, np.int64), prior[:-3]]
        p = left + prior - corner
        near = np.abs(np.stack([p - left, p - prior, p - corner])).argmin(axis=0)
        paeth = np.choose(near, [left, prior, corner])
        guess = [np.zeros(15, np.int64), left, prior, (left + prior) // 2, paeth][kind]
        raw += bytes([kind]) + bytes(((line - guess) & 255).astype(np.uint8))
        prior = line
    head = (5).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    data = images._PNG + images._chunk(b"IHDR", head) + images._chunk(b"IDAT", zlib.compress(bytes(raw))) + images._chunk(b"IEND", b"")
    assert (images.decode_png(data) == a).all()
    gray = rng.integers(0, 256, (3, 4, 1), dtype=np.uint8)
    assert (images.decode(images.encode_png(gray)) == np.repeat(gray, 3, axis=2)).all()
    alpha = rng.integers(0, 65536, (3, 4, 4)).astype(np.uint16)
    assert (images.decode(images.encode_png(alpha)) == alpha[:, :, 2::-1]).all()


def test_preview(spark):
    rows = image_rows(spark, [rng.random((4, 4, 3)) for _ in range(5)])
    out = images.preview(rows, 2.0, 3).collect()
    assert len(out) == 3 and {(r["height"], r["dtype"]) for r in out} == {(8, "uint8")}


def test_cube_files(spark, tmp_path):
    n = 3
    t = rng.random((n, n, n, 3)).round(6)
    body = ['TITLE "x"', "# a comment", f"LUT_3D_SIZE {n}", "DOMAIN_MIN 0.0 0.0 0.0", "DOMAIN_MAX 1.0 1.0 1.0", ""]
    body += [" ".join(map(repr, map(float, t[i % n, i // n % n, i // n**2]))) for i in range(n**3)]  # red varies fastest
    (tmp_path / "a.cube").write_text("\n".join(body) + "\n")
    rows = cube.read_lut(spark, str(tmp_path / "a.cube")).collect()
    assert len(rows) == n**3 and all(np.allclose((r["r"], r["g"], r["b"]), t[r["ri"], r["gi"], r["bi"]]) for r in rows)
    cube.write_lut(spark.createDataFrame(rows, S.LUT), str(tmp_path / "copy"))
    part = next(f for f in os.listdir(tmp_path / "copy") if f.startswith("part"))
    again = cube.read_lut(spark, str(tmp_path / "copy" / part), use_cache=False).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    (tmp_path / "none.cube").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        cube.read_lut(spark, str(tmp_path / "none.cube"))


def test_raw_video_source(spark, tmp_path):
    rawvideo.register(spark)
    data = bytes(rng.integers(0, 256, 5 * 96 + 17, dtype=np.uint8))
    (tmp_path / "v.yuv").write_bytes(data)
    df = spark.read.format("rawvideo").option("width", 8).option("height", 8).option("framesPerPartition", 2).load(str(tmp_path / "v.yuv"))
    rows = sorted(df.collect(), key=lambda r: r["frame_id"])
    assert [bytes(r["data"]) for r in rows] == [data[k * 96 : (k + 1) * 96] for k in range(5)]  # the incomplete frame is left
    assert frames.frame_pixels(df, 8, 8).count() == 5 * 64
    with pytest.raises(ValueError):
        rawvideo.frame_bytes("x", 1, 1)


def test_streams(spark, tmp_path):
    rows = [(k, None, 8, 8, "yuv420p", bytearray(bytes(rng.integers(0, 256, 96, dtype=np.uint8)))) for k in range(4)]
    spark.createDataFrame(rows, S.FRAME).repartition(2).write.parquet(str(tmp_path / "in"))
    q = frames.frame_pixels(frames.read_frames(spark, str(tmp_path / "in")), 8, 8).select("frame_id", "y", "x", "c0", "c1", "c2")
    run = q.writeStream.format("memory").queryName("pixels").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    batch = frames.frame_pixels(spark.read.parquet(str(tmp_path / "in")), 8, 8)
    assert sorted(map(tuple, spark.table("pixels").collect())) == sorted(map(tuple, batch.select("frame_id", "y", "x", "c0", "c1", "c2").collect()))
    luma = frames.grayscale(batch.withColumns({c: F.col(c) for c in ("c0", "c1", "c2")}))
    assert luma.where("luma < 0 or luma > 1").count() == 0
    with pytest.raises(ValueError):
        frames.frame_pixels(batch.withColumn("pix_fmt", F.lit("x")).withColumn("data", F.lit(b"")), 8, 8, "yuv422p10le")


def test_image_stream(spark, tmp_path):
    image_rows(spark, [rng.random((3, 3, 3))]).write.parquet(str(tmp_path / "in"))
    out = frames.transform_images(frames.read_images(spark, str(tmp_path / "in")), lambda a: 1 - a)
    run = out.writeStream.format("memory").queryName("inverted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    assert spark.table("inverted").count() == 1

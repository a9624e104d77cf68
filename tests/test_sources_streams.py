"""Sources, sinks and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import mosaic, stages
from skylattice.sources import files, images, text
from skylattice.streaming import maps


def test_trajectory_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# a comment\n1 0 0 0 0 0 0.70710678 0.70710678\n2 1 2 3 0 0 0 1\n1 5 5 5 0 0 0 1\nbroken line\n")
    got = {r.ts: r for r in text.read_tum(spark, str(tmp_path / "a.txt")).collect()}
    assert set(got) == {1, 2} and got[1].x == 5 and got[2].r00 == 1
    text.write_tum(text.read_tum(spark, str(tmp_path / "a.txt")), str(tmp_path / "out"))
    again = {r.ts: r for r in text.read_tum(spark, str(tmp_path / "out")).collect()}
    assert again[2].z == 3 and again[1].r11 == pytest.approx(1)


def test_xyz_leaves_out_short_lines(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2 3\n4 5\n6 7 8\n")
    assert text.read_xyz(spark, str(tmp_path / "p.txt")).count() == 2


def test_camera_file(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("%YAML:1.0\ntype: pinhole\nfps: 10\nwidth: 1200\nheight: 1000\ncx: 600\ncy: 500\nfx: 1200.5\nfy: 1200\nk1: -0.1\n")
    cam = text.read_camera(spark, str(tmp_path / "c.yaml"))
    assert (cam.fx, cam.width, cam.k1, cam.k2) == (1200.5, 1200, -0.1, 0.0)
    (tmp_path / "d.yaml").write_text("type: fisheye\n")
    with pytest.raises(ValueError):
        text.read_camera(spark, str(tmp_path / "d.yaml"))
    assert text.read_matrix("t_w: !!m\n   rows: 2\n   cols: 2\n   dt: d\n   data: [1., 2, 3, 4.5]", "t_w") == [[1, 2], [3, 4.5]]


def test_grid_files(spark, tmp_path):
    files.register(spark)
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    m[0, 0] = np.nan
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.grid.bin").write_bytes(files.grid_bytes((10.0, 20.0, 3.0, 2.0), 1.0, {"elevation": (m, 1), "angle": (m.astype(np.float64), 0)}))
    cells = spark.read.format("gridbin").load(str(tmp_path / "in"))
    assert cells.count() == 22
    assert cells.where("layer = 'elevation' and gx = 13 and gy = 20").first().value == 11
    cells.where("layer = 'elevation'").select("layer", "gx", "gy", "value", "res").coalesce(1).write.format("gridbin").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("gridbin").load(str(tmp_path / "out"))
    assert {(r.gx, r.gy): r.value for r in back.collect()} == {(r.gx, r.gy): r.value for r in cells.where("layer = 'elevation'").collect()}
    with pytest.raises(Exception):
        spark.read.format("gridbin").load(str(tmp_path / "nowhere")).count()


def test_ply_files(spark, tmp_path):
    files.register(spark)
    spark.range(5).select(*[F.col("id").cast("double").alias(c) for c in "xyz"]).coalesce(1).write.format("ply").mode("overwrite").save(str(tmp_path / "p"))
    (out,) = (tmp_path / "p").glob("*.ply")
    head, body = out.read_bytes().split(b"end_header\n")
    assert b"element vertex 5" in head and np.frombuffer(body, "<f4").reshape(5, 3)[4].tolist() == [4, 4, 4]


def test_raw_matrices(spark, tmp_path):
    m = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "a.bin").write_bytes(images.matrix_bytes(m))
    rows = images.read_matrices(spark, str(tmp_path)).collect()
    assert len(rows) == 24 and {(r.r, r.c, r.channel): r.value for r in rows}[1, 2, 3] == 23


def exif_file(lat, ref):
    """A JPEG file with a GPS directory."""
    gps_at = 8 + 2 + 12 + 4
    entries = [(1, 2, 2, ref.encode() + b"\0\0\0"), (2, 5, 3, None), (6, 5, 1, None)]
    data_at = gps_at + 2 + 12 * len(entries) + 4
    data, body = b"", struct.pack("<H", len(entries))
    for tag, kind, count, value in entries:
        if value is None:
            value = struct.pack("<I", data_at + len(data))
            data += b"".join(struct.pack("<II", n, 100) for n in (lat if tag == 2 else (12345,)))
        body += struct.pack("<HHI", tag, kind, count) + value[:4]
    main = struct.pack("<H", 1) + struct.pack("<HHII", images.GPS_POINTER, 4, 1, gps_at) + b"\0\0\0\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + main + body + b"\0\0\0\0" + data
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


def test_exif_frames(spark, tmp_path):
    (tmp_path / "img_0042.jpg").write_bytes(exif_file((1000, 3000, 0), "S"))
    (tmp_path / "img_0043.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    got = {r.frame_no: r for r in images.read_frames(spark, str(tmp_path)).collect()}
    assert got[42].latitude == pytest.approx(-10.5) and got[42].altitude == pytest.approx(123.45) and got[43].latitude == 0
    assert [r.path[-12:] for r in images.list_files(spark, str(tmp_path), ".jpg").collect()] == ["img_0042.jpg", "img_0043.jpg"]
    assert {r.path[-8:-4]: r.tags["latitude"] for r in images.present_tags(spark, str(tmp_path)).collect()} == {"0042": True, "0043": False}


def observations(spark):
    return spark.range(600).select(
        F.col("id").alias("seq"), (F.col("id") * 7 % 90).alias("gx"), (F.col("id") % 3).alias("gy"), (F.col("id") % 50).cast("double").alias("color"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 40).cast("double")).alias("elevation"), (F.col("id") * 13 % 17).cast("double").alias("angle"),
    )


def test_streamed_mosaic_is_the_batch_mosaic(spark, tmp_path):
    obs = observations(spark)
    obs.repartition(6).write.parquet(str(tmp_path / "in"))
    state = maps.MosaicState(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError):
        state.mosaic()
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    maps.stream_mosaic(stream, state, str(tmp_path / "ck")).awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.select("gx", "gy", "color", "elevation", "angle", "n_obs").collect())
    assert rows(state.mosaic()) == rows(mosaic.blend(obs))
    state.merge(obs, 99)  # again: nothing changes
    assert rows(state.mosaic()) == rows(mosaic.blend(obs))
    state.compact()
    state.vacuum()
    assert len([p for p in (tmp_path / "state").iterdir() if p.name != "manifest"]) == 1 and rows(state.mosaic()) == rows(mosaic.blend(obs))
    state.merge(obs.where("angle < 0"), 100)
    later = obs.withColumns({"angle": F.col("angle") + 1, "seq": F.col("seq") + 1000})
    state.merge(later, 101)
    assert rows(state.mosaic()) == rows(mosaic.blend(obs.unionByName(later)))


def frames(spark):
    return spark.range(60).select(
        (F.col("id") % 3).alias("camera_id"), F.col("id").alias("frame_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"),
        (F.col("id") * 1.5).alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"),
    )


def test_streamed_throttle_and_rates(spark, tmp_path):
    f = frames(spark)
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    for name, df in (("throttled", maps.throttled_stream(stream(), 60.0)), ("rates", maps.rates_stream(stream()))):
        mode = "append" if name == "throttled" else "complete"
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.table("throttled")) == rows(stages.throttled(f, 60.0))
    assert rows(spark.table("rates")) == rows(stages.frame_rates(f))


def test_settings_bind_declared_keys():
    from skylattice.sources import settings

    got = settings.load_stage("%YAML:1.0\ntype: tileing\nqueue_size: 9\nmin_zoom: 12\nunknown: 3\n", "tileing")
    assert (got.queue_size, got.min_zoom, got.max_zoom) == (9, 12, -1)
    for text, stage in (("type: mosaicing\n", "tileing"), ("type: x\n", "x"), ("type: tileing\nmin_zoom: high\n", "tileing")):
        with pytest.raises(ValueError):
            settings.load_stage(text, stage)


def test_streamed_intervals_are_the_batch_join(spark, tmp_path):
    f = frames(spark).select("frame_id", "camera_id", "ts")
    readings = spark.range(90).select((F.col("id") % 3).alias("sensor_id"), F.timestamp_seconds(F.col("id") / 1.5 + 1_700_000_000).alias("at"), F.col("id").alias("reading"))
    f.write.parquet(str(tmp_path / "f"))
    readings.write.parquet(str(tmp_path / "r"))
    streams = [spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for df, n in ((f, "f"), (readings, "r"))]
    pairs = lambda df: df.select("frame_id", "reading")
    pairs(maps.frames_with_imu(*streams, "4 seconds")).writeStream.format("memory").queryName("intervals").trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.table("intervals")) == rows(pairs(maps.frames_with_imu(f, readings, "4 seconds"))) != []

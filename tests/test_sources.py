import json

import numpy as np
import pytest

from verdure.sources import files, images, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_label_and_review_logs(spark, tmp_path):
    p = write(tmp_path / "l.jsonl", '{"crop": "region_1.png", "family": "x"}\nnot json\n\n{"crop": "region_2.png", "ts": 5}\n')
    assert sorted((r.crop, r.family, r.ts) for r in files.labels(spark, p).collect()) == [("region_1.png", "x", 0), ("region_2.png", "", 5)]
    lines = [{"src": "a", "n": 0, "state": "reviewed", "w": 3, "h": 4}, {"src": "a", "n": 0, "state": "rejected"}, {"src": "b", "n": 0, "state": "reviewed"}, {"src": "b", "n": 0, "state": "none"}, {"n": 1}]
    p = write(tmp_path / "r.jsonl", "\n".join(map(json.dumps, lines)))
    assert [(r.src, r.state, r.w) for r in files.review_state(spark, p).collect()] == [("a", "rejected", 0)]


def test_sort_log(spark, tmp_path):
    p = write(tmp_path / "s.csv", "source_path,status\n/a,b/x.png, good\n/a,b/x.png,bad\n/y.png,good\n")
    assert sorted((r.source_path, r.status) for r in files.sort_state(spark, p).collect()) == [("/a,b/x.png", "bad"), ("/y.png", "good")]


def test_logs_that_grow_file_by_file(spark, tmp_path):
    import time

    p = f"{tmp_path}/log"
    for k, state in enumerate(("first", "second", "third")):
        df = spark.createDataFrame([("a", 0, f"{state}{j}", 1, 1) for j in range(3)], "src string, n int, state string, w int, h int").repartition(3)
        sinks.append_json(df, p, ["state"])
        time.sleep(0.02)
    assert [r.state for r in files.review_state(spark, p).collect()] == ["third2"]
    for k, status in enumerate(("x", "y", "z")):
        (tmp_path / "sort").mkdir(exist_ok=True)
        (tmp_path / "sort" / f"{9 - k}.csv").write_text(f"source_path,status\n/a.png,{status}\n")
        time.sleep(0.02)
    assert [(r.source_path, r.status) for r in files.sort_state(spark, f"{tmp_path}/sort").collect()] == [("/a.png", "z")]


def test_places_of_lines_are_numbers(spark, tmp_path):
    """A line carries no path through the sort of its key: the row would be several times as wide."""
    (tmp_path / "log").mkdir()
    for k in range(3):
        (tmp_path / "log" / f"{k}.csv").write_text("source_path,status\n/a.png,x\n")
    rows = files._numbered(spark, f"{tmp_path}/log")
    assert all(kind in ("int", "bigint") for name, kind in rows.dtypes if name != "text")
    assert sorted({r._file for r in rows.collect()}) == [1, 2, 3]


def test_polygon_lines(spark, tmp_path):
    (tmp_path / "im.txt").write_text("1 0.5 x 0.25 1 1 0 0.5\nx 0 0 1 0 1 1\n2 0 0 1 0 1\n3 0 0 1 0 1 1\n1.5 0 0 1 0 1 1\n")
    sizes = spark.createDataFrame([("im", 100, 200)], "stem string, w int, h int")
    got = sorted((r["class"], [(q.x, q.y) for q in r.ring]) for r in files.polygons(spark, str(tmp_path / "im.txt"), sizes).collect())
    assert got == [(1, [(50.0, 50.0), (100.0, 200.0), (0.0, 100.0)]), (3, [(0.0, 0.0), (100.0, 0.0), (100.0, 200.0)])]


def test_png_rows_against_the_definition():
    rng = np.random.default_rng(3)
    for kind in range(5):
        line, above = rng.integers(0, 256, (9, 3)).astype(np.uint8), rng.integers(0, 256, (9, 3)).astype(np.uint8)
        flat, up, want = line.ravel().astype(int), above.ravel().astype(int), np.zeros(27, int)
        for i in range(27):
            a, b, c = (want[i - 3] if i >= 3 else 0), up[i], (up[i - 3] if i >= 3 else 0)
            p = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(v - (a + b - c)))][kind]
            want[i] = (flat[i] + p) % 256
        assert images._unfilter(line, kind, above).ravel().tolist() == want.tolist()


def png(kind, depth, rows, more=()):
    """A PNG of unfiltered rows of bytes."""
    import struct
    import zlib

    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", rows[0][0], len(rows), depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + b"".join(part(k, v) for k, v in more) + part(b"IDAT", zlib.compress(b"".join(b"\0" + r for _, r in rows))) + part(b"IEND", b"")


def test_png_depths():
    import struct

    assert images.decode(png(0, 1, [(10, bytes([0b10110000, 0b01000000]))]))[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 0, 0, 0, 255]
    assert images.decode(png(0, 4, [(3, bytes([0x0F, 0x80]))]))[0, :, 1].tolist() == [0, 255, 136]
    two = images.decode(png(3, 2, [(3, bytes([0b00011000]))], [(b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])), (b"tRNS", bytes([9]))]))
    assert two[0].tolist() == [[1, 2, 3, 9], [4, 5, 6, 255], [7, 8, 9, 255]]
    deep = struct.pack(">6H", 0x1234, 0xFF00, 1, 0x0101, 2, 3)
    assert images.decode(png(2, 16, [(2, deep)], [(b"tRNS", struct.pack(">3H", 0x0101, 2, 3))]))[0].tolist() == [[0x12, 0xFF, 0, 255], [1, 0, 0, 0]]


def test_bmp_and_tiff():
    import struct
    import zlib

    rgb = np.random.default_rng(4).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    want = np.concatenate([rgb, np.full((3, 5, 1), 255, np.uint8)], axis=2)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in rgb[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (images.decode(bmp) == want).all()
    top = b"BM" + struct.pack("<IHHI", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 8, 0, 4, 0, 0, 2, 0) + bytes([3, 2, 1, 0, 6, 5, 4, 0]) + bytes([1, 0, 0, 0])
    assert images.decode(top)[0].tolist() == [[4, 5, 6, 255], [1, 2, 3, 255]]
    for end, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        for packing, predictor in ((1, 1), (8, 2)):
            px = np.diff(rgb, axis=1, prepend=np.zeros((3, 1, 3), np.uint8)) if predictor == 2 else rgb
            strips = [px[:2].tobytes(), px[2:].tobytes()]
            strips = [zlib.compress(x) for x in strips] if packing == 8 else strips
            entries = [(256, 3, 1, 5), (257, 3, 1, 3), (258, 3, 3, 200), (259, 3, 1, packing), (262, 3, 1, 2), (273, 4, 2, 210), (277, 3, 1, 3), (278, 3, 1, 2), (279, 4, 2, 220), (317, 3, 1, predictor)]
            ifd = struct.pack(end + "H", len(entries)) + b"".join(struct.pack(end + "HHI", t, k, n) + (struct.pack(end + "HH", v, 0) if k == 3 and n == 1 else struct.pack(end + "I", v)) for t, k, n, v in entries) + b"\0" * 4
            data = bytearray(300)
            data[:8] = mark + struct.pack(end + "I", 8)
            data[8 : 8 + len(ifd)] = ifd
            data[200:206] = struct.pack(end + "3H", 8, 8, 8)
            data[210:218] = struct.pack(end + "2I", 300, 300 + len(strips[0]))
            data[220:228] = struct.pack(end + "2I", *map(len, strips))
            assert (images.decode(bytes(data) + b"".join(strips)) == want).all()
    for bad in (b"BM" + b"\0" * 60, b"II*\0" + b"\x08\0\0\0" + b"\0" * 20):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_scan_outside_a_folder(spark, tmp_path):
    for d in ("in", "in/out", "in/about/out", "in/output"):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
        (tmp_path / d / "a.png").write_bytes(b"x")
    found = images.scan(spark, f"{tmp_path}/in", outside=f"file://{tmp_path}/in//out/")
    assert sorted(r.path.split("/in/")[1] for r in found.select("path").collect()) == ["a.png", "about/out/a.png", "output/a.png"]
    assert images.count(found).first().n == 3
    for a, b in (("/x/in", "file:///x/in/out"), ("file:/x/in/", "/x//in"), ("/x/in/./out", "/x/in")):
        with pytest.raises(ValueError):
            images.check_apart(a, b)
    images.check_apart("/x/in", "/x/inner")


def test_meta_and_head(spark, tmp_path):
    p = write(tmp_path / "m.json", json.dumps({"threshold": 1.0, "ch_thresholds": {"dist": 2.0}, "scale_floors": {}, "dim": 3}))
    meta = files.detector_meta(spark, p)
    assert files.channel_threshold(meta, "dist").first()[0] == 2.0 and files.channel_threshold(meta, "color").first() == (float("inf"), 0.0)
    good = {"dim": 2, "classes": [0, 3], "intercept": [0.1, 0.2], "coef": [[1, 2], [3, 4]], "tau_default": 0.8, "families": {"3": "spots"}, "per_family_tau": {"3": 0.6}}
    h = files.classifier_head(spark, write(tmp_path / "h.json", json.dumps(good))).collect()
    assert [(r["class"], r.name, r.tau) for r in h] == [(0, None, 0.8), (3, "spots", 0.6)]
    with pytest.raises(Exception, match="shapes disagree"):
        files.classifier_head(spark, write(tmp_path / "b.json", json.dumps(good | {"intercept": [1.0]}))).collect()


def test_bank_round_trip(spark, tmp_path):
    v = np.arange(6, dtype=np.float32).reshape(2, 3)
    (tmp_path / "bank.bin").write_bytes(files.bank_bytes(v))
    rows = files.bank(spark, str(tmp_path / "bank.bin")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.row_id)] == v.tolist()
    (tmp_path / "cut.bin").write_bytes(files.bank_bytes(v)[:-1])
    assert "match" in files.bank(spark, str(tmp_path / "cut.bin")).first().error


def test_banks_and_dumps_in_parts_by_ranges(spark, tmp_path):
    from verdure.sources import binary

    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 5)).astype(np.float32)
    rows = spark.createDataFrame([(i, i % 3, i * 0.5, x.tolist()) for i, x in enumerate(v)], "id long, class int, weight double, v array<float>").repartition(7)
    assert binary.write_bank(rows, ["id"], f"{tmp_path}/bank", 64) == 8
    assert len((tmp_path / "bank" / "000000000000064.bin").read_bytes()) == 8 + 64 * 20
    assert binary.write_dump(rows, ["id"], f"{tmp_path}/dump", 200) == 3
    (tmp_path / "one.bin").write_bytes(files.bank_bytes(v))
    for size in (19, 333, 1 << 20):
        for path in ("bank", "one.bin"):
            got = sorted(binary.bank(spark, f"{tmp_path}/{path}", size).collect(), key=lambda r: r.row_id)
            assert [r.row_id for r in got] == list(range(500)) and np.allclose([r.v for r in got], v)
        got = sorted(binary.base_set(spark, f"{tmp_path}/dump", size).collect(), key=lambda r: r.row_id)
        assert [(r.row_id, r["class"], r.weight) for r in got] == [(i, i % 3, i * 0.5) for i in range(500)] and np.allclose([r.v for r in got], v)
    (tmp_path / "bank" / "000000000000448.bin").write_bytes(b"\1\0")
    bad = binary.bank(spark, f"{tmp_path}/bank", 333)
    assert [r.error for r in bad.where("error is not null").collect()] == ["ValueError: no header"] and bad.where("error is null").count() == 448
    with pytest.raises(ValueError, match="don't fit"):
        binary.write_bank(rows.union(spark.createDataFrame([(900, 0, 0.0, [1.0])], rows.schema)), ["id"], f"{tmp_path}/x")


def test_polygons_and_maps(spark, tmp_path):
    p = write(tmp_path / "p.txt", "1 0 0 1 0 1 1\n2 0 0 1\n3 0 0 1 0 1 x\n\n")
    rows = files.polygons(spark, p).collect()
    assert len(rows) == 1 and rows[0]["class"] == 1 and len(rows[0].ring) == 3
    p = write(tmp_path / "e.json", json.dumps({"a.png": {"index": 4, "split": "val"}}))
    assert files.export_map(spark, p).collect() == [("a.png", 4, "val")]
    assert files.sidecar(spark, write(tmp_path / "k.txt", "epoch=3\niou=0.5")).collect() == [(3, 0.5)]


def test_images(spark, tmp_path):
    rgba = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.PNG").write_bytes(images.encode(rgba))
    (tmp_path / "img" / "b.png").write_bytes(b"broken")
    (tmp_path / "img" / "c.txt").write_bytes(b"no image")
    got = images.decoded(images.scan(spark, str(tmp_path / "img"))).collect()
    good = [r for r in got if r.error is None]
    assert len(got) == 2 and np.frombuffer(good[0].rgba, np.uint8).reshape(5, 7, 4).tolist() == rgba.tolist()
    with pytest.raises(ValueError):
        images.check_apart("/a/b", "/a/b/c")


def test_csv_quotes_and_empty_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"', 0.5), (2, "c", None)], "i int, name string, v double")
    sinks.write_csv(sinks.fixed(df, {"v": 2}).coalesce(1), str(tmp_path / "out"), ["i"])
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == 'i,name,v\n1,"a, ""b""",0.50\n2,c,\n'


def test_stable_index(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "src string")
    known = spark.createDataFrame([("b", 7)], "src string, index int")
    assert {r["src"]: r["index"] for r in sinks.dataset_index(items, known).collect()} == {"a": 8, "b": 7, "c": 9}


def test_parts_of_one_append_are_in_order_of_their_numbers(spark, tmp_path):
    """The first part of an append may be done last."""
    import os

    line = '{"src": "a", "n": 0, "state": "%s"}\n'
    for k, (name, state) in enumerate((("part-00000-x-c000.txt", "first"), ("part-00001-x-c000.txt", "second"))):
        os.utime(write(tmp_path / name, line % state), (1000 - 500 * k, 1000 - 500 * k))
    assert [r.state for r in files.review_state(spark, str(tmp_path)).collect()] == ["second"]
    os.utime(write(tmp_path / "part-00000-a-c000.txt", line % "third"), (2000, 2000))
    assert [r.state for r in files.review_state(spark, str(tmp_path)).collect()] == ["third"]

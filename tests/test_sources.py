import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tabloom.operators.routing import ROUTES, filter_rows, tagged
from tabloom.sources import files, images, sinks


def listed(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "latin-1", "gbk", "shift-jis"])
def test_csv_encodings(spark, tmp_path, encoding):
    word = {"gbk": "地图", "shift-jis": "地図"}.get(encoding, "café")
    path = tmp_path / "t.csv"
    path.write_bytes(f'id;name;n\n1;{word};1.5\n;;\n2;"a ""q""\nb";\n'.encode(encoding))
    df = files.read_csv(spark, str(path), encoding, ";", multi_line=True)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("n", "double")]
    assert listed(df, "id") == [(1, word, 1.5), (2, 'a "q"\nb', None)]
    assert files.read_csv(spark, str(path), encoding, ";", max_rows=1, order_by="-id", multi_line=True).first().id == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, str(path), "ebcdic")


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a\tb\tc\td\te\n1\tTrue\tNA\t2020-01-01\t1\n2\tFalse\tx\t2020-01-02\t\n")
    df = files.read_csv(spark, str(path), delimiter="\\t")
    assert [t for _, t in df.dtypes] == ["bigint", "boolean", "string", "string", "double"]
    assert df.orderBy("a").first().c is None


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_csv_sink(spark, tmp_path, encoding):
    df = spark.createDataFrame([(2, 'é "x",\ny', 1.5e8, None), (1, "", None, True)], "i int, `s t` string, d double, b boolean")
    sinks.write_csv(df, str(tmp_path / "out"), encoding, ",", include_index=True, order_by="i")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*")))
    assert raw.startswith(b"\xef\xbb\xbf") == (encoding == "utf-8-sig")
    assert '""x""' in raw.decode(encoding) and "150000000.0" in raw.decode(encoding)
    back = files.read_csv(spark, str(tmp_path / "out"), encoding, multi_line=True)
    assert [r[1:3] for r in back.orderBy("i").collect()] == [(1, None), (2, 'é "x",\ny')]
    assert [r[0] for r in back.orderBy("i").collect()] == [0, 1]


def test_json_documents(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"data": {"items": [{"a": 1, "b": "x"}, {"a": 2.5, "c": [1]}]}, "cols": {"p": [1, 2], "q": ["u", "v"]}, "one": {"k": 3}, "n": 7, "l": [4, 5]}')
    assert listed(files.read_json(spark, str(path), "data.items"), "a") == [(1.0, "x", None), (2.5, None, [1])]
    assert files.read_json(spark, str(path), "data.items.1.c.0", "auto").first()["value"] == 1
    assert listed(files.read_json(spark, str(path), "cols", "columns"), "p") == [(1, "u"), (2, "v")]
    assert files.read_json(spark, str(path), "one", "auto").first().k == 3
    assert [r[0] for r in files.read_json(spark, str(path), "l", "auto").collect()] == [4, 5]
    with pytest.raises(ValueError):
        files.read_json(spark, str(path), "nope")
    root = tmp_path / "root.json"
    root.write_text('[{"a": "x"}, {"a": null}]')
    assert files.read_json(spark, str(root)).count() == 2
    assert files.read_json(spark, str(root), "0.a", "auto").first()["value"] == "x"


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "i int, s string")
    sinks.write_json(df, str(tmp_path / "r"))
    assert '"s":null' in "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    sinks.write_json(df, str(tmp_path / "c"), "columns")
    lines = lambda c: sorted(x for p in (tmp_path / "c" / f"column={c}").glob("part*") for x in p.read_text().split())
    assert lines("i") == ['{"row":0,"value":1}', '{"row":1,"value":2}'] and lines("s") == ['{"row":0,"value":null}', '{"row":1,"value":"b"}']
    sinks.write_json(spark.range(10_001), str(tmp_path / "x"), "columns")
    assert spark.read.json(str(tmp_path / "x")).selectExpr("count(distinct row)", "count(distinct value)").first() == (10_001, 10_001)


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + b"\0\0\0" * width for _ in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    (tmp_path / "b 1.PNG").write_bytes(png(3, 2))
    (tmp_path / "a.tif").write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.jpg").write_bytes(b"x")
    flat = images.read_folder(spark, str(tmp_path), dimensions=True)
    assert [(r.filename, r.extension, r.size_bytes > 0, r.width, r.height) for r in flat.orderBy("filename").collect()] == [
        ("a.tif", ".tif", True, None, None), ("b 1.PNG", ".png", True, 3, 2)]
    assert flat.filter("filename = 'b 1.PNG'").first().file_path == str(tmp_path / "b 1.PNG")
    assert images.read_folder(spark, str(tmp_path), scan_subfolders=True).count() == 3
    assert [r.filename for r in images.read_folder(spark, str(tmp_path), True, max_images=2).collect()] == ["a.tif", "b 1.PNG"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("")
    with pytest.raises(ValueError):
        images.read_folder(spark, str(tmp_path / "none"))


def test_large_archive_is_listed_by_its_directory(spark, tmp_path):
    """An archive with a gap of 6 GB before its directory: only the directory is read."""
    path = tmp_path / "large.zip"
    with open(path, "wb") as file:
        with zipfile.ZipFile(file, "w") as z:
            z.writestr("a.png", b"first")
            file.seek(6 * 2**30)
            z.start_dir = file.tell()
            for i in range(12_000):
                z.writestr(f"deep/b {i}.jpg", b"x")
    assert path.stat().st_size > 6 * 2**30
    got = images.read_archives(spark, str(tmp_path / "*.zip"))
    assert got.count() == 12_001 and got.select("file_path").distinct().count() == 12_001
    assert "ReadSchema: struct<path:string>" in got._jdf.queryExecution().executedPlan().toString()
    paths = sorted(r.file_path for r in got.filter("filename in ('a.png', 'b 7.jpg')").collect())
    assert [images.read_bytes(p) for p in paths] == [b"first", b"x"]
    assert images.read_bytes(str(path) + "!/none") is None and images.read_bytes("/no/such/file") is None
    assert images.read_bytes(None) is None
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        images.read_archives(spark, str(tmp_path / "broken.zip")).collect()


def test_archives(spark, tmp_path):
    long_name = "x" * 170 + ".jpeg"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one/a.jpg", b"12")
        z.writestr("two/a.jpg", b"123")
        z.writestr("readme.md", b"")
        z.writestr(long_name, b"1")
    got = images.read_archives(spark, str(tmp_path / "*.zip")).orderBy("file_path").collect()
    assert [(r.filename, r.disk_filename, r.size_bytes) for r in got if r.filename == "a.jpg"] == [
        ("a.jpg", "a.jpg", 2), ("a.jpg", "a_1.jpg", 3)]
    cut = next(r for r in got if r.filename == long_name)
    assert len(cut.disk_filename) == 150 and cut.disk_filename.endswith(".jpeg") and len(got) == 3


def test_routed_sink_reads_its_parent_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    df = spark.range(100).selectExpr("id", "CAST(id % 7 AS STRING) AS s").mapInPandas(counted, "id long, s string")
    rules = [{"output": f"route_{i}", "conditions": [{"column": "s", "value": str(i)}]} for i in (1, 2, 3)]
    rows = tagged(df, rules)
    sinks.write_routed(rows, str(tmp_path / "ports"))
    assert seen.value == 100
    ports = sinks.read_routed(rows, str(tmp_path / "ports"), ROUTES)
    want = {name: sorted(i for i in range(100) if (f"route_{i % 7}" if i % 7 in (1, 2, 3) else "default") == name) for name in ROUTES}
    assert {name: sorted(r.id for r in part.collect()) for name, part in ports.items()} == want
    assert ports["route_4"].columns == ["id", "s"]
    with pytest.raises(Exception, match="without a port"):
        sinks.write_routed(df.withColumn("_port", F.lit(None).cast("string")), str(tmp_path / "none"))
    sinks.write_routed(rows.limit(0), str(tmp_path / "empty"))
    assert all(part.isEmpty() for part in sinks.read_routed(rows, str(tmp_path / "empty"), ROUTES).values())


def test_ports_sink(spark, tmp_path):
    ports = filter_rows(spark.range(10).withColumn("s", F.lit("x")), "id", "less_than", "4")
    sinks.write_ports(ports, {name: str(tmp_path / name) for name in ports})
    assert spark.read.parquet(str(tmp_path / "matched")).count() == 4
    assert spark.read.parquet(str(tmp_path / "unmatched")).count() == 6


def test_catalogue_enrichment_from_a_million_on(spark, tmp_path):
    """Keys beyond those of sf0.1 next to the query's SQL, up to several commas in a scale."""
    import duckdb

    from queries import all_queries, all_sql

    keys = [0, 998_999, 999_000, 1_000_001, 7_199_999, 1_234_567_890]
    rows = [(k, f"red ring {k % 7}", "Brand#1", "LARGE", 1 + i % 2, 1.0) for i, k in enumerate(keys)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(all_sql()["catalogue_enrichment"]).fetchall()
    got = all_queries()["catalogue_enrichment"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 6

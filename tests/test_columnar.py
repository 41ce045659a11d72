import gc
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import CorruptMetadata, CorruptPage, InvalidColumnData, InvalidParquetFile, InvalidSchema, UnsupportedCompression, UnsupportedNestedSchema
from quernel.operators import digest, nested, stats
from quernel.plans import columnar
from quernel.sources import metadata, scan, sink

LIST = [(0, [5]), (1, None), (2, []), (3, [None, 6, 7, None]), (4, [])]
NESTED = [(0, [[7, 8], []]), (1, [[]]), (2, None), (3, [None, [None], [9]]), (4, [])]
MAP = [(0, {4: 40, 5: 50, 6: None}), (1, None), (2, {}), (3, {7: None}), (4, {})]
LIST_MAP = [(0, [{"p": 4}, {"q": None, "r": 6}]), (1, [{}]), (2, [None, {"s": 2}]), (3, None), (4, [])]
NESTED_MAP = [(0, {"left": {8: False}, "right": {}}), (1, {}), (2, {"up": None, "down": {5: None, 6: True, 9: False}}), (3, None)]


def levels(df, path):
    return [(r.rep, r["def"], r.value) for r in nested.triplets(df, path, "id").orderBy("row", "entry").collect()]


def test_triplets_of_a_list(spark):
    df = spark.createDataFrame(LIST, "id long, a array<int>")
    assert levels(df, "a.list.element") == [(0, 3, 5), (0, 0, None), (0, 1, None), (0, 2, None), (1, 3, 6), (1, 3, 7), (1, 2, None), (0, 1, None)]
    made = nested.triplets(df, "a.list.element", "id")
    nested.check_levels(made, 3, 1)
    assert {r.row: r["items"] for r in nested.assemble_lists(made).collect()} == dict(LIST)
    assert nested.level_starts(made, 0).count() == 5
    with pytest.raises(CorruptPage):
        nested.check_levels(made.withColumn("rep", F.lit(1)), 3, 1)


def test_triplets_of_nested_lists(spark):
    df = spark.createDataFrame(NESTED, "id long, a array<array<int>>")
    got = levels(df, "a.list.element.list.element")
    assert len(got) == 9 and sum(v is None for _, _, v in got) == 6
    assert got == [(0, 5, 7), (2, 5, 8), (1, 3, None), (0, 3, None), (0, 0, None), (0, 2, None), (1, 4, None), (1, 5, 9), (0, 1, None)]
    outer, inner, slots = nested.nested_levels(df, "a.list.element.list.element", "id")
    assert (outer.agg(F.sum("length")).first()[0], inner.agg(F.sum("length")).first()[0]) == (6, 4)
    assert outer.where("not valid").count() == 1 and inner.where("not valid").count() == 1
    total = nested.payload(df, "a.list.element.list.element", "id").first()
    assert (total.slots, total.present, total.nulls, total.total) == (4, 3, 1, 24) and slots.count() == 4


def test_levels_of_maps(spark):
    df = spark.createDataFrame(MAP, "id long, m map<int,int>")
    assert len(levels(df, "m.key_value.key")) == 7 and len(levels(df, "m.key_value.value")) == 7
    assert {(r.row, r.key, r.value) for r in nested.map_view(df, "m", "id").collect()} == {(0, 4, 40), (0, 5, 50), (0, 6, None), (3, 7, None)}
    deep = spark.createDataFrame(NESTED_MAP, "id long, m map<string,map<int,boolean>>")
    paths = ["m.key_value.key", "m.key_value.value.key_value.key", "m.key_value.value.key_value.value"]
    assert [len(levels(deep, p)) for p in paths] == [6, 8, 8]
    listed = spark.createDataFrame(LIST_MAP, "id long, a array<map<string,int>>")
    assert [len(levels(listed, f"a.list.element.key_value.{p}")) for p in ("key", "value")] == [8, 8]
    pairs = nested.map_pair(listed, "a.list.element.key_value.key", "a.list.element.key_value.value", "id").collect()
    assert {(r.row, tuple(r["at"]), r.key, r.value) for r in pairs} == {(0, (0, 0), "p", 4), (0, (1, 0), "q", None), (0, (1, 1), "r", 6), (2, (1, 0), "s", 2)}
    with pytest.raises(UnsupportedNestedSchema):
        nested.map_pair(df.withColumn("a", F.array(F.lit(1))), "m.key_value.key", "a.list.element", "id")


def test_leaves_and_paths(spark):
    schema = T.StructType.fromDDL("id long not null, p struct<x: int, y: array<struct<z: string>>>, m map<string, int>")
    found = nested.leaves(schema)
    assert [x.name for x in found] == ["id", "p.x", "p.y.list.element.z", "m.key_value.key", "m.key_value.value"]
    assert [(x.max_definition, x.max_repetition) for x in found] == [(0, 0), (2, 0), (5, 1), (2, 1), (3, 1)]
    assert nested.leaf_index(schema, "m.key_value.key") == 3 and found[2].repeated == (("p", "y", "list"),) and found[2].ancestors == (("list", ("p", "y")),)
    df = spark.createDataFrame([(1, (5, [("q",), None]), {"k": 7})], schema)
    got = nested.select_leaves(df, ["m.key_value.value", "p.y.list.element.z", "id", "id"]).first()
    assert tuple(got) == ([7], ["q", None], 1, 1)
    with pytest.raises(InvalidColumnData):
        nested.leaf(schema, "p.nothing")
    with pytest.raises(UnsupportedNestedSchema):
        nested.select_leaves(df, ["m.key_value.key"], flat=True)


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "lz4_raw", "zstd"])
@pytest.mark.parametrize("version", [1, 2])
def test_every_codec_and_page_version(spark, tmp_path, codec, version):
    spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    rows = [(k, k * 0.25, None if k % 7 == 0 else f"label-{k & 15}", bytes([k % 256] * (k % 5)), LIST[k % 5][1], MAP[k % 5][1], NESTED[k % 5][1]) for k in range(1025)]
    df = spark.createDataFrame(rows, "id long, score double, name string, blob binary, l array<int>, m map<int,int>, n array<array<int>>")
    path = str(tmp_path / "out")
    sink.write(df.coalesce(1), path, codec=codec, page_rows=100, page_version=version, crc=True, dictionary=version == 1)
    back = scan.scan(spark, path)
    assert digest.table_digest(back).first() == digest.table_digest(df).first()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_empty_tables_and_all_nulls(spark, tmp_path):
    df = spark.createDataFrame([(None, None)] * 64, "a string, b binary")
    sink.write(df, str(tmp_path / "nulls"))
    assert scan.scan(spark, str(tmp_path / "nulls")).where("a is null and b is null").count() == 64
    sink.write(df.limit(0), str(tmp_path / "none"))
    assert scan.scan(spark, str(tmp_path / "none")).count() == 0


def test_what_cannot_be_written(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(UnsupportedCompression):
        sink.write(df, str(tmp_path / "x"), codec="brotli")
    with pytest.raises(InvalidColumnData):
        sink.write(df, str(tmp_path / "x"), page_rows=0)
    with pytest.raises(InvalidSchema):
        sink.check_schema(T.StructType([]))
    with pytest.raises(InvalidSchema):
        sink.check_schema(T.StructType.fromDDL("a struct<b: int>").add("", T.LongType()))


def one_file(tmp_path, table, **options):
    path = str(tmp_path / "f.parquet")
    pq.write_table(table, path, **options)
    return path


def test_row_groups_by_ordinal(spark, tmp_path):
    path = one_file(tmp_path, pa.table({"id": list(range(100))}), row_group_size=30)
    assert metadata.row_ranges(spark, path) == [(0, 30), (30, 30), (60, 30), (90, 10)]
    assert [r.id for r in scan.scan(spark, path, ["id"], row_groups=[3, 1]).orderBy("id").collect()] == [*range(30, 60), *range(90, 100)]
    with pytest.raises(InvalidColumnData):
        scan.scan(spark, path, row_groups=[4])


def test_the_row_group_query_reads_all_groups(spark, tmp_path):
    pq.write_table(pa.table({"o_orderkey": list(range(100)), "o_totalprice": [k * 0.5 for k in range(100)]}), tmp_path / "orders.parquet", row_group_size=30)
    assert sorted(map(tuple, columnar.scan_row_group(spark, str(tmp_path)).collect())) == [(k, k * 0.5) for k in range(100)]


def test_footers_of_all_files_decide_on_the_reader(spark, tmp_path, monkeypatch):
    path = tmp_path / "many"
    path.mkdir()
    names = [f"label-{k:04}" for k in range(3000)]
    for k, delta in enumerate([False, False, True]):
        pq.write_table(pa.table({"name": names}), path / f"part-{k}.parquet", compression="none", use_dictionary=not delta, column_encoding={"name": "DELTA_BYTE_ARRAY"} if delta else None)
    needs = [scan.needs_row_reader(spark, f) for f in sorted(spark.read.parquet(str(path)).inputFiles())]
    assert needs == [False, False, True]
    spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    try:
        assert sorted(r.name for r in scan.scan(spark, str(path)).collect()) == sorted(names * 3)
        assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "false"
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
        (path / "part-2.parquet").unlink()
        scan.scan(spark, str(path))
        assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"
        monkeypatch.setattr(scan, "CHECKED_FILES", 1)
        scan.scan(spark, str(path))
        assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "false"
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")


def test_footers(spark, tmp_path):
    path = one_file(tmp_path, pa.table({"id": pa.array([1, 2, 3, 4, 5], pa.int64()), "name": ["ann", None, "cat", "dan", "eve"]}), row_group_size=3)
    got = {(r.row_group, r.column): (r["values"], r.nulls, r.least, r.most) for r in metadata.validate(spark, path).collect()}
    assert got == {(0, "id"): (3, 0, "1", "3"), (0, "name"): (3, 1, "ann", "cat"), (1, "id"): (2, 0, "4", "5"), (1, "name"): (2, 0, "dan", "eve")}
    many = {(r.row_group, r.column): (r["values"], r.nulls, r.least, r.most) for r in metadata.footers(spark, [path, path]).collect()}
    assert many == got and metadata.footers(spark, [path, path]).count() == 8


def test_page_index(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k < 1000 else f"{k:05d}") for k in range(5000)], "id long, name string").coalesce(1)
    sink.write(df, str(tmp_path / "out"), page_rows=1000)
    path = next(f for f in spark.read.parquet(str(tmp_path / "out")).inputFiles())
    pages = metadata.page_index(spark, path).orderBy("column", "page").collect()
    ids = [p for p in pages if p.column == "id"]
    assert [(p.row_start, p.rows) for p in ids] == [(k, 1000) for k in range(0, 5000, 1000)]
    assert [metadata.decode("INT64", bytes(p.least)) for p in ids] == list(range(0, 5000, 1000))
    names = [p for p in pages if p.column == "name"]
    assert names[0].nulls == 1000 and names[0].least is None and bytes(names[1].least) == b"01000"


def pages_one_by_one(spark, path):
    """What page_index should give, asked of the reader value by value."""
    reader, out = metadata._open(spark, path), []
    raw = lambda b: bytes(b.duplicate().get(k) & 0xFF for k in range(b.position(), b.limit()))
    for g, block in enumerate(reader.getFooter().getBlocks()):
        for c in block.getColumns():
            offsets, stats = reader.readOffsetIndex(c), reader.readColumnIndex(c)
            for p in range(offsets.getPageCount() if offsets is not None else 0):
                first, known = offsets.getFirstRowIndex(p), stats is not None and not stats.getNullPages()[p]
                nulls = stats.getNullCounts() if stats is not None else None
                out.append((
                    g, c.getPath().toDotString(), p, offsets.getOffset(p), offsets.getCompressedPageSize(p), first, offsets.getLastRowIndex(p, block.getRowCount()) - first + 1,
                    nulls[p] if nulls is not None else None, raw(stats.getMinValues()[p]) if known else None, raw(stats.getMaxValues()[p]) if known else None,
                ))
    reader.close()
    return out


def found_pages(spark, path):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in metadata.page_index(spark, path).collect()]


@pytest.mark.parametrize("slab", [1, 300, 1 << 19])
def test_page_index_of_odd_columns(spark, tmp_path, monkeypatch, slab):
    monkeypatch.setattr(metadata, "SLAB_BYTES", slab)
    df = spark.range(2000, numPartitions=1).selectExpr(
        "id", "id % 3 = 0 flag", "if(id < 300, null, if(id % 7 = 0, '', concat('é', id))) name", "cast(null as int) none", "if(id % 5 = 0, double('NaN'), -id) d",
        "timestamp_seconds(id) at", "cast(id as decimal(30,2)) amount", "if(id % 4 = 0, null, array(id, null, -id)) l", "map(id, cast(id as string)) m", "struct(-id as x) s",
    )
    for kind in ("INT96", "TIMESTAMP_MICROS"):
        spark.conf.set("spark.sql.parquet.outputTimestampType", kind)
        try:
            sink.write(df, str(tmp_path / kind), page_rows=100, row_group_bytes=40_000)
        finally:
            spark.conf.unset("spark.sql.parquet.outputTimestampType")
        path = next(iter(spark.read.parquet(str(tmp_path / kind)).inputFiles()))
        want = pages_one_by_one(spark, path)
        assert found_pages(spark, path) == want and len({w[0] for w in want}) > 1
    held = pa.table({"id": list(range(5000)), "name": [None if k < 2000 else "x" * (k % 300) for k in range(5000)], "flag": [None] * 5000})
    path = one_file(tmp_path, held, row_group_size=1500, write_page_index=True, data_page_size=500, write_batch_size=100, use_dictionary=False)
    assert len(found_pages(spark, path)) > 50 and found_pages(spark, path) == pages_one_by_one(spark, path)
    for made in (held, held.slice(0, 0)):
        assert found_pages(spark, one_file(tmp_path, made)) == []


def test_page_index_asks_the_reader_by_chunk_and_not_by_page(spark, tmp_path, monkeypatch):
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    asked, found = [], []
    for rows in (4000, 20):
        sink.write(spark.range(8000, numPartitions=1), str(tmp_path / str(rows)), page_rows=rows)
        path = next(iter(spark.read.parquet(str(tmp_path / str(rows))).inputFiles()))
        gc.collect()
        calls.clear()
        with monkeypatch.context() as patch:
            patch.setattr(client, "send_command", lambda *a, **k: (calls.append(1), send(*a, **k))[1])
            made = metadata.page_index(spark, path)
        asked.append(len(calls))
        found.append(made.count())
        assert made.agg(F.sum("rows")).first()[0] == 8000
    assert found[0] == 2 and found[1] > 350 and asked[1] < asked[0] + 350


def test_an_index_that_ends_early():
    raw = bytes([0x19, 0x1C, 0x16, 8, 0x15, 20, 0x16, 0, 0, 0])
    assert metadata._compact(raw, 0) == ({1: [{1: 4, 2: 10, 3: 0}]}, len(raw))
    for cut in range(len(raw)):
        with pytest.raises(CorruptMetadata):
            metadata._compact(raw[:cut], 0)


def test_statistics_of_the_wrong_width():
    assert metadata.decode("DOUBLE", b"\0\0\0\0\0\0\xf0?") == 1.0 and metadata.decode("BOOLEAN", b"\1") is True and metadata.decode("BYTE_ARRAY", b"x") == b"x" and metadata.decode("INT32", None) is None
    for kind, raw in (("INT32", b"\0"), ("INT64", b"\0" * 4), ("BOOLEAN", b"\0\0")):
        with pytest.raises(CorruptMetadata):
            metadata.decode(kind, raw)


def test_a_wrong_checksum_is_an_error(spark, tmp_path):
    path = one_file(tmp_path, pa.table({"s": ["x" * 50 + str(k) for k in range(200)]}), compression="none", use_dictionary=False, write_page_checksum=True)
    raw = bytearray((tmp_path / "f.parquet").read_bytes())
    raw[400] ^= 1
    (tmp_path / "g.parquet").write_bytes(raw)
    assert scan.scan(spark, path).count() == 200
    with pytest.raises((PySparkException, Py4JJavaError), match="checksum|FAILED_READ_FILE"):
        scan.scan(spark, str(tmp_path / "g.parquet")).collect()


def test_truncated_and_mutated_files_fail_cleanly(spark, tmp_path):
    one_file(tmp_path, pa.table({"a": list(range(1000)), "b": ["v"] * 1000}), write_page_checksum=True)
    whole = (tmp_path / "f.parquet").read_bytes()
    for cut in (0, 3, 11, 40, len(whole) - 1):
        with pytest.raises(InvalidParquetFile):
            scan.read_bytes(spark, whole[:cut])
        (tmp_path / "t.parquet").write_bytes(whole[:cut])
        with pytest.raises(InvalidParquetFile):
            metadata.row_ranges(spark, str(tmp_path / "t.parquet"))
    assert scan.read_bytes(spark, whole, ["a"]).count() == 1000


def test_files_in_a_binary_column(spark, tmp_path):
    one_file(tmp_path, pa.table({"a": pa.array(range(10), pa.int64())}))
    content = (tmp_path / "f.parquet").read_bytes()
    held = spark.read.format("binaryFile").load(str(tmp_path / "f.parquet"))
    assert sorted(r.a for r in scan.read_binary(held, scan.schema_of(content)).collect()) == list(range(10))


def test_byte_stream_split(spark, tmp_path):
    path = one_file(tmp_path, pa.table({"x": [k * 0.5 for k in range(50)]}), use_byte_stream_split=["x"], use_dictionary=False)
    try:
        assert scan.scan(spark, path).agg(F.sum("x")).first()[0] == sum(k * 0.5 for k in range(50))
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")


def test_statistics_rules(spark):
    nan = float("nan")
    df = spark.createDataFrame([(True, 1.0, "b", 1), (False, nan, "a", None), (None, 3.0, "ÿ", 5)], "f boolean, d double, s string, i int")
    got = {r.column: (r.rows, r.nulls, r.least, r.most) for r in stats.chunk_stats(df, ["f", "d", "s", "i"]).collect()}
    assert got == {"f": (3, 1, "false", "true"), "d": (3, 0, None, None), "s": (3, 0, "a", "ÿ"), "i": (3, 1, "1", "5")}
    pages = stats.page_stats(spark.range(10).withColumn("v", F.col("id") * 2), "v", F.col("id"), 4).orderBy("page").collect()
    assert [(p.row_start, p.rows, p.nulls, p.least, p.most) for p in pages] == [(0, 4, 0, 0, 6), (4, 4, 0, 8, 14), (8, 2, 0, 16, 18)]
    useful = {r.column: r.useful for r in stats.dictionary_useful(spark.createDataFrame([("a", 1), ("a", 2)], "x string, y int"), ["x", "y"]).collect()}
    assert useful == {"x": True, "y": False}


def test_digests_tell_values_apart(spark):
    base = [(1, "a", 1.5), (2, None, -0.0)]
    schema = "i int, s string, d double"
    same = spark.createDataFrame(base[::-1], schema)
    df = spark.createDataFrame(base, schema)
    assert digest.table_digest(df).first() == digest.table_digest(same).first()
    for other in ([(1, "a", 1.5), (2, "", -0.0)], [(1, "a", 1.5), (2, None, 0.0)], [(1, "a", 1.5)]):
        assert digest.table_digest(spark.createDataFrame(other, schema)).first() != digest.table_digest(df).first()
    assert digest.ordered_digest(df.coalesce(1)) != digest.ordered_digest(same.coalesce(1))


def test_random_tables_survive(spark, tmp_path):
    r = random.Random(0x5EED)
    special = [float("inf"), float("-inf"), float("nan"), -0.0, 0.0, 1e-300]
    for case in range(6):
        gap = r.choice([0, 0.05, 0.25, 0.8])
        pick = lambda f, gap=gap: None if r.random() < gap else f()
        rows = [(pick(lambda: r.random() < 0.5), pick(lambda: r.choice([-(2**31), 2**31 - 1, r.randrange(100)])), pick(lambda: r.choice([-(2**63), 2**63 - 1])), pick(lambda: r.choice([*special, r.random()])), pick(lambda: "é" * r.choice([0, 1, 3000])), pick(lambda: bytes(r.randrange(256) for _ in range(r.randrange(12))))) for _ in range(r.choice([1, 7, 513]))]
        df = spark.createDataFrame(rows, "f boolean, i int, l long, d double, s string, b binary")
        sink.write(df, str(tmp_path / str(case)), codec=r.choice(list(sink.CODECS)))
        assert digest.table_digest(scan.scan(spark, str(tmp_path / str(case)))).first() == digest.table_digest(df).first()
    assert math.isnan(special[2])


def test_pages_of_a_column(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 3)
    assert {r.page: r["items"] for r in scan.pages(df, "v", F.col("id"), 4).collect()} == {0: [0, 3, 6, 9], 1: [12, 15, 18, 21], 2: [24, 27]}

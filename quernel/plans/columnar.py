"""Queries of scans, sinks, statistics and nested columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import digest, nested, ordered, stats
from quernel.plans.registry import query, table
from quernel.sources import metadata, scan, sink


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: in the checkpoint folder, or in local mode without one a temporary folder."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="quernel-")
    return f"{base}/{uuid.uuid4().hex}"


@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_returnflag"], flat=True)


@query("SELECT n_name, n_nationkey, n_name AS n_name_again FROM nation")
def scan_by_path_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(spark, f"{sf}/nation.parquet", ["n_name", "n_nationkey", "n_name"]).toDF("n_name", "n_nationkey", "n_name_again")


@query("SELECT vec_id, len(embedding) AS items, list_max(embedding)::DOUBLE AS most FROM embeddings")
def scan_nested_path(spark: SparkSession, sf: str) -> DataFrame:
    df = scan.scan(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding.list.element"]).toDF("vec_id", "e")
    return df.select("vec_id", F.size("e").cast("long").alias("items"), F.array_max("e").cast("double").alias("most"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_row_group(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/orders.parquet"
    every = list(range(len(metadata.row_ranges(spark, path))))
    return scan.scan(spark, path, row_groups=every).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM part")
def sink_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    sink.write(table(spark, sf, "part"), path, codec="zstd", page_rows=1000, page_version=2, crc=True)
    return scan.scan(spark, path)


@query("SELECT count(*) AS leaves, 0 AS deepest FROM (DESCRIBE lineitem)")
def schema_leaves(spark: SparkSession, sf: str) -> DataFrame:
    found = nested.leaves(table(spark, sf, "lineitem").schema)
    return spark.createDataFrame([(len(found), max(x.max_repetition for x in found))], "leaves long, deepest int")


@query("""
    SELECT path_in_schema AS "column", num_values AS "values", stats_null_count AS nulls, total_compressed_size AS compressed, total_uncompressed_size AS uncompressed
    FROM parquet_metadata('/root/testdata/sf0.01/nation.parquet')
""")
def footer_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.validate(spark, f"{sf}/nation.parquet").select("column", "values", "nulls", "compressed", "uncompressed")


@query()
def page_index(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    sink.write(table(spark, sf, "orders").coalesce(1), path, page_rows=1000)
    part = next(f for f in table_files(spark, path) if f.endswith(".parquet"))
    return metadata.page_index(spark, part)


def table_files(spark: SparkSession, path: str) -> list[str]:
    return list(spark.read.parquet(path).inputFiles())


@query()
def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digest.table_digest(table(spark, sf, "lineitem"))


@query("""
    WITH r AS (SELECT o_totalprice AS v, (row_number() OVER ()) - 1 AS i FROM orders)
    SELECT i // 4096 AS page, min(i) AS row_start, count(*) AS rows, count(*) - count(v) AS nulls, min(v) AS least, max(v) AS most FROM r GROUP BY 1
""")
def page_stats_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_totalprice", F.col("_metadata.row_index").alias("at"))
    return stats.page_stats(df, "o_totalprice", F.col("at"))


@query("""
    SELECT 'l_orderkey' AS "column", count(*) AS rows, count(*) - count(l_orderkey) AS nulls, min(l_orderkey)::VARCHAR AS least, max(l_orderkey)::VARCHAR AS most FROM lineitem
    UNION ALL SELECT 'l_linenumber', count(*), count(*) - count(l_linenumber), min(l_linenumber)::VARCHAR, max(l_linenumber)::VARCHAR FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), min(l_returnflag), max(l_returnflag) FROM lineitem
""")
def chunk_stats_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return stats.chunk_stats(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("""
    WITH e AS (SELECT event_type, CASE WHEN event_id % 997 = 0 AND event_type <> 'view' THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
    SELECT event_type, CASE WHEN bool_or(isnan(v)) THEN NULL ELSE min(v) END AS least, CASE WHEN bool_or(isnan(v)) THEN NULL ELSE max(v) END AS most FROM e GROUP BY 1
""")
def float_stats_nan(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    df = df.select("event_type", F.when((F.col("event_id") % 997 == 0) & (F.col("event_type") != "view"), F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    low, high = stats.least_and_most(df, "v")
    return df.groupBy("event_type").agg(low.alias("least"), high.alias("most"))


@query("SELECT event_type, bool_and(value > 1) AS least, bool_or(value > 1) AS most FROM events GROUP BY 1")
def bool_stats(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_type", (F.col("value") > 1).alias("flag"))
    low, high = stats.least_and_most(df, "flag")
    return df.groupBy("event_type").agg(low.alias("least"), high.alias("most"))


@query("""
    SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS distinct_values, count(o_orderstatus) AS present, count(DISTINCT o_orderstatus) < count(o_orderstatus) AS useful FROM orders
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(o_orderpriority), count(DISTINCT o_orderpriority) < count(o_orderpriority) FROM orders
""")
def dictionary_useful(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dictionary_useful(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
    SELECT o_orderpriority AS page, coalesce(CASE WHEN o_orderpriority < '3' THEN min(o_totalprice) END, -1.0) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1
""")
def stats_overlay(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("page")).agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
    index = found.select("page", F.when(F.col("page") < "3", F.col("least")).alias("least"), "most")
    return stats.overlay(index, found.select("page", F.lit(-1.0).alias("least"), F.lit(-2.0).alias("most")), ["page"], ["least", "most"])


@query("""
    SELECT vec_id AS row, i - 1 AS entry, CASE WHEN i = 1 THEN 0 ELSE 1 END AS rep, 3 AS def, embedding[i]::DOUBLE AS value
    FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
""")
def embedding_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return nested.triplets(table(spark, sf, "embeddings"), "embedding.list.element", "vec_id").withColumn("value", F.col("value").cast("double"))


@query("""
    SELECT vec_id AS row, embedding IS NOT NULL AS valid, coalesce(len(embedding), 0) AS length,
           coalesce(sum(coalesce(len(embedding), 0)) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM embeddings
""")
def embedding_list_view(spark: SparkSession, sf: str) -> DataFrame:
    lists = nested.list_view(table(spark, sf, "embeddings"), "embedding", "vec_id")
    return ordered.running_sum(lists, "row", F.col("length"), "start")


def order_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as a list, by the order's key."""
    return nested.assemble(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderkey", "orders")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def list_assemble(spark: SparkSession, sf: str) -> DataFrame:
    return order_lists(spark, sf).select("o_custkey", F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"))


@query("SELECT count(*) AS slots, count(o_orderkey) AS present, 0 AS nulls, sum(o_orderkey)::BIGINT AS total FROM orders")
def list_payload_sum(spark: SparkSession, sf: str) -> DataFrame:
    return nested.payload(order_lists(spark, sf), "orders.list.element", "o_custkey")


@query("SELECT o_custkey AS row, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1")
def triplets_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    levels = nested.triplets(order_lists(spark, sf), "orders.list.element", "o_custkey")
    return nested.assemble_lists(levels).select("row", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def status_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's number of orders by status, as a map."""
    counts = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("o_orderstatus", "n")))
    return counts.groupBy("o_custkey").agg(F.map_from_entries(entries).alias("by_status"))


@query("""
    SELECT o_custkey AS row, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1 AS pos, o_orderstatus AS key, true AS valid, count(*) AS value
    FROM orders GROUP BY o_custkey, o_orderstatus
""")
def map_view(spark: SparkSession, sf: str) -> DataFrame:
    return nested.map_view(status_maps(spark, sf), "by_status", "o_custkey")


@query("""
    SELECT o_custkey AS row, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1)::VARCHAR AS at, o_orderstatus AS key, count(*) AS value
    FROM orders GROUP BY o_custkey, o_orderstatus
""")
def map_pair(spark: SparkSession, sf: str) -> DataFrame:
    pairs = nested.map_pair(status_maps(spark, sf), "by_status.key_value.key", "by_status.key_value.value", "o_custkey")
    return pairs.select("row", F.array_join(F.col("at").cast("array<string>"), ".").alias("at"), "key", "value")


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders),
         l AS (SELECT o.o_custkey, o.p, count(l_orderkey) AS n FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT 0 AS level, o_custkey AS row, '' AS at, count(*) AS length FROM o GROUP BY 2
    UNION ALL SELECT 1, o_custkey, p::VARCHAR, n FROM l
""")
def nested_logical_2level(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    by_order = nested.assemble(parts, "l_orderkey", "l_linenumber", "l_partkey", "parts")
    orders = table(spark, sf, "orders").join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lists = nested.assemble(orders.select("o_custkey", "o_orderkey", F.coalesce("parts", F.array().cast("array<long>")).alias("parts")), "o_custkey", "o_orderkey", "parts", "orders")
    levels = nested.nested_levels(lists, "orders.list.element.list.element", "o_custkey")[:2]
    text = [x.select(F.lit(k).alias("level"), "row", F.array_join(F.col("at").cast("array<string>"), ".").alias("at"), "length") for k, x in enumerate(levels)]
    return text[0].unionByName(text[1])

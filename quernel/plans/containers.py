"""Queries of keyed and ordered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import ordered
from quernel.operators.keyed import Keyed
from quernel.plans.registry import query, table

ORDERS = Keyed("o_orderkey", "o_custkey")
#: Events as a log on users: an operation for each type of event (the same in the SQL).
OPS = {"purchase": "put", "error": "remove", "click": "insert", "signup": "get_or_put", "view": "get"}
OPS_SQL = """
    ops AS (SELECT event_id AS seq, user_id AS key, event_id * 10 AS value,
                   CASE event_type WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'remove' WHEN 'click' THEN 'insert' WHEN 'signup' THEN 'get_or_put' ELSE 'get' END AS op
            FROM events),
    parts AS (SELECT *, sum(CASE WHEN op IN ('put', 'remove') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS part FROM ops),
    marked AS (SELECT *, min(CASE WHEN op IN ('put', 'insert', 'get_or_put') THEN seq END) OVER (PARTITION BY key, part ORDER BY seq) AS made_at FROM parts),
    after AS (SELECT m.*, o.value AS new_value FROM marked m LEFT JOIN ops o ON o.seq = m.made_at AND o.key = m.key)
"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), (F.col("event_id") * 10).alias("value"), kinds[F.col("event_type")].alias("op"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_id").alias("value"))


def shown(results: DataFrame) -> DataFrame:
    """Results with -1 where there is no value."""
    return results.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("old_value", "new_value")})


@query("SELECT user_id AS key, min(event_id) AS value FROM events GROUP BY 1")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    batch = users(spark, sf)
    return Keyed().insert(batch.select("key", "value").limit(0), batch)


@query("SELECT c_custkey AS key, coalesce(max(o_orderkey), any_value(c_nationkey)) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def put_batch(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"))
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("seq"))
    return Keyed().put(held, batch)


@query("""
    SELECT event_id AS seq, 'put' AS op, user_id AS key, lag(event_id) OVER w IS NOT NULL AS found, coalesce(lag(event_id) OVER w, -1) AS old_value, event_id AS new_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def put_results(spark: SparkSession, sf: str) -> DataFrame:
    return shown(Keyed().op_results(users(spark, sf).withColumn("op", F.lit("put"))))


@query(f"WITH {OPS_SQL} SELECT key, arg_max(new_value, seq) AS value FROM (SELECT key, seq, coalesce(new_value, -1) AS new_value FROM after) GROUP BY key HAVING arg_max(new_value, seq) >= 0")
def apply_ops(spark: SparkSession, sf: str) -> DataFrame:
    return Keyed().apply_ops(None, log(spark, sf))


@query(f"WITH {OPS_SQL} SELECT seq, op, key, lag(new_value) OVER w IS NOT NULL AS found, coalesce(lag(new_value) OVER w, -1) AS old_value, coalesce(new_value, -1) AS new_value FROM after WINDOW w AS (PARTITION BY key ORDER BY seq)")
def op_results(spark: SparkSession, sf: str) -> DataFrame:
    return shown(Keyed().op_results(log(spark, sf)))


@query("SELECT p_partkey AS o_orderkey, o.o_orderkey IS NOT NULL AS found, coalesce(o.o_custkey, -9) AS o_custkey FROM part LEFT JOIN orders o ON o.o_orderkey = p_partkey")
def lookup_hit_miss(spark: SparkSession, sf: str) -> DataFrame:
    got = ORDERS.get(table(spark, sf, "orders"), table(spark, sf, "part").select(F.col("p_partkey").alias("o_orderkey")))
    return got.withColumn("o_custkey", F.coalesce("o_custkey", F.lit(-9).cast("long")))


@query("SELECT p_partkey AS o_orderkey, o.o_orderkey IS NOT NULL AS found, coalesce(o.o_custkey, -1) AS o_custkey FROM part LEFT JOIN orders o ON o.o_orderkey = p_partkey")
def get_or_put(spark: SparkSession, sf: str) -> DataFrame:
    return ORDERS.get(table(spark, sf, "orders"), table(spark, sf, "part").select(F.col("p_partkey").alias("o_orderkey")), F.lit(-1).cast("long"))


CUSTOMERS = Keyed("c_custkey", "c_name")


def buyers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def contains(spark: SparkSession, sf: str) -> DataFrame:
    return CUSTOMERS.contains(buyers(spark, sf), table(spark, sf, "customer").select("c_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def remove(spark: SparkSession, sf: str) -> DataFrame:
    return CUSTOMERS.remove(table(spark, sf, "customer").select("c_custkey", "c_name"), buyers(spark, sf))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def fetch_remove(spark: SparkSession, sf: str) -> DataFrame:
    return CUSTOMERS.fetch_remove(table(spark, sf, "customer").select("c_custkey", "c_name"), buyers(spark, sf))


@query("SELECT DISTINCT o_custkey FROM orders")
def set_insert(spark: SparkSession, sf: str) -> DataFrame:
    keys = Keyed("o_custkey", None, "o_orderkey")
    batch = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return keys.insert(batch.select("o_custkey").limit(0), batch)


@query("SELECT min(o_orderkey) AS o_orderkey, arg_max(o_custkey, o_orderkey) AS o_custkey FROM orders GROUP BY o_orderkey // 10")
def custom_equality(spark: SparkSession, sf: str) -> DataFrame:
    tens = Keyed("o_orderkey", "o_custkey", "seq", canonical=lambda k: F.floor(k / 10))
    batch = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("seq"))
    return tens.put(batch.select("o_orderkey", "o_custkey").limit(0), batch)


@query("SELECT o_custkey AS canonical, count(*) AS entries FROM orders GROUP BY 1 HAVING count(*) > 1")
def validate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return Keyed("o_custkey", "o_orderkey").check(table(spark, sf, "orders"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_partkey") * 37 - 5).alias("probe"))


@query("SELECT p_partkey * 37 - 5 AS probe, coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= p_partkey * 37 - 5), -1) AS bound FROM part")
def lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    found = ordered.lower_bound(table(spark, sf, "orders"), "o_orderkey", probes(spark, sf), "probe")
    return found.withColumn("bound", F.coalesce("bound", F.lit(-1).cast("long")))


@query("SELECT p_partkey * 37 - 5 AS probe, coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderkey > p_partkey * 37 - 5), -1) AS bound FROM part")
def upper_bound(spark: SparkSession, sf: str) -> DataFrame:
    found = ordered.upper_bound(table(spark, sf, "orders"), "o_orderkey", probes(spark, sf), "probe")
    return found.withColumn("bound", F.coalesce("bound", F.lit(-1).cast("long")))


@query("SELECT s_name AS probe, (SELECT min(c_name) FROM customer WHERE c_name >= replace(s_name, 'Supplier', 'Customer')) AS bound FROM supplier")
def lower_bound_text(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "supplier").select(F.col("s_name").alias("probe"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("at"))
    return ordered.lower_bound(table(spark, sf, "customer"), "c_name", asked, "at").select("probe", "bound")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000")
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.range_scan(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 9000)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders")
def forward_iter(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.positions(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part")
def reverse_comparator(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.positions(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", descending=True, tie="p_partkey")


@query("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS prev, coalesce(lead(o_orderkey) OVER w, -1) AS next FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def cursor_next_prev(spark: SparkSession, sf: str) -> DataFrame:
    near = ordered.neighbours(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return near.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("prev", "next")})


@query("""
    SELECT 'begin' AS side, o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
    UNION ALL SELECT 'end', o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)
""")
def begin_end(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.ends(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("""
    WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders)
    SELECT p_partkey * 37 - 5 AS probe, coalesce(position, -1) AS position FROM part LEFT JOIN p ON o_orderkey = p_partkey * 37 - 5
""")
def find_cursor(spark: SparkSession, sf: str) -> DataFrame:
    found = ordered.find(table(spark, sf, "orders"), "o_orderkey", probes(spark, sf), "probe")
    return found.select("probe", F.coalesce("position", F.lit(-1)).cast("long").alias("position"))


@query("""
    (SELECT o_orderkey, 'on' AS way FROM orders WHERE o_orderkey >= 5000 ORDER BY o_orderkey LIMIT 25)
    UNION ALL (SELECT o_orderkey, 'back' FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 25)
""")
def steps_from_bound(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").select("o_orderkey")
    on, back = ordered.steps(keys, "o_orderkey", 5000, 25), ordered.steps(keys, "o_orderkey", 5000, 25, back=True)
    return on.withColumn("way", F.lit("on")).unionByName(back.withColumn("way", F.lit("back")))


@query("SELECT o_custkey AS key, min(o_orderkey) AS value FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def get_or_put_state(spark: SparkSession, sf: str) -> DataFrame:
    """The table after looking up every customer and putting a default for those that aren't there."""
    keyed = Keyed()
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("seq"))
    held = keyed.insert(batch.select("key", "value").limit(0), batch)
    probed = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("value"), F.lit(0).alias("seq"))
    return keyed.insert(held, probed)


@query("SELECT count(*) AS entries, count(*) = 0 AS empty, 0 AS broken FROM orders")
def size_and_order(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey")
    broken = ordered.same_order(df, "o_orderkey").agg(F.count(F.lit(1)).alias("broken"))
    counted = df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(1).alias("one"), "entries", (F.col("entries") == 0).alias("empty"))
    return counted.join(broken.withColumn("one", F.lit(1)), "one").drop("one")

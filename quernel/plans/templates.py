"""Queries of the template language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.compiler import interpreted, render
from quernel.functions.interpreter import Environment
from quernel.plans.registry import query, table

ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


def _each(spark: SparkSession, sf: str, name: str, key: str, source: str, environment: Environment | None = None) -> DataFrame:
    df = table(spark, sf, name)
    return df.select(key, render(df, source, environment).alias("text"))


@query("SELECT c_custkey, '#' || c_custkey || ' ' || c_name || ' [' || lower(c_mktsegment) || ']' AS text FROM customer")
def tmpl_row(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "customer", "c_custkey", "#{{ c_custkey }} {{ c_name }} {# no #}[{{ c_mktsegment|lower }}]")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'big' WHEN o_orderstatus = 'F' OR o_orderstatus = 'P' THEN 'done' ELSE 'open' END AS text FROM orders")
def tmpl_if(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "orders", "o_orderkey", '{% if o_totalprice >= 200000 -%} big {%- elif o_orderstatus == "F" or o_orderstatus == "P" %}done{% else %}open{% endif %}')


LOOP = "{{ c_name|upper }}:{% for o in orders %}{{ loop.index }}.{{ o.key }}{% if o.status == 'F' %}*{% endif %}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}"


def customers_with_orders(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))))
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(entries.alias("orders"))
    both = table(spark, sf, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", "c_name", F.coalesce("orders", F.array().cast("array<struct<key: long, status: string>>")).alias("orders"))


LOOP_SQL = """
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
    SELECT c_custkey, upper(c_name) || ':' || coalesce(string_agg(i || '.' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '*' ELSE '' END, ',' ORDER BY i), 'none') AS text
    FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey, c_name
"""


@query(LOOP_SQL)
def tmpl_loop(spark: SparkSession, sf: str) -> DataFrame:
    df = customers_with_orders(spark, sf)
    return df.select("c_custkey", render(df, LOOP).alias("text"))


@query(LOOP_SQL)
def tmpl_loop_interpreted(spark: SparkSession, sf: str) -> DataFrame:
    df = customers_with_orders(spark, sf)
    return df.select("c_custkey", interpreted(df, LOOP).alias("text"))


@query("""
    WITH o AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '>' ORDER BY o_orderkey) AS chain, max(o_orderkey)::VARCHAR AS last FROM orders GROUP BY 1)
    SELECT c_custkey, '0' || coalesce('>' || chain, '') AS text FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def tmpl_carried_set(spark: SparkSession, sf: str) -> DataFrame:
    """A value set in one turn and read in the next, which only the interpreter can do."""
    df = customers_with_orders(spark, sf)
    source = "0{% for o in orders %}{% if seen is defined %}{{ '>'|safe }}{% else %}{{ '>'|safe }}{% endif %}{% set seen = o.key %}{{ seen }}{% endfor %}"
    return df.select("c_custkey", render(df, source).alias("text"))


@query("SELECT n_nationkey, 'nation ' || lower(n_name) || '/' || n_regionkey || '!' AS text FROM nation")
def tmpl_include(spark: SparkSession, sf: str) -> DataFrame:
    environment = Environment()
    environment.add_template("name", "{{ n_name|lower }}{% include 'region' %}")
    environment.add_template("region", "/{{ n_regionkey }}")
    return _each(spark, sf, "nation", "n_nationkey", "nation {% include \"name\" %}!", environment)


@query("SELECT n_nationkey, upper(n_name) || '-' || (n_regionkey = 1)::VARCHAR AS text FROM nation")
def tmpl_set(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "nation", "n_nationkey", "{% set big = n_name|upper %}{% set here = n_regionkey == 1 %}{{ big }}-{{ here }}")


@query(f"SELECT page_id, {ESCAPED.format('html')} || '|' || strlen(html) AS text FROM pages")
def tmpl_escape(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "pages", "page_id", "{{ html }}|{{ html|length }}")


@query("SELECT page_id, html || '<' AS text FROM pages")
def tmpl_safe(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "pages", "page_id", "{{ html|safe }}{{ '<'|safe }}")


@query("""
    SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '|' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '|' || strlen(text) AS text
    FROM documents
""")
def tmpl_filters_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "documents", "doc_id", "{{ text|upper|safe }}|{{ text|lower|safe }}|{{ text|length }}")


@query("""
    SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(p_name, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') || '|' || upper(p_type[1]) || lower(p_type[2:]) AS text
    FROM part
""")
def tmpl_title(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "part", "p_partkey", "{{ p_name|title }}|{{ p_type|capitalize }}")


@query("SELECT p_partkey, '[' || trim(chr(9) || ' ' || p_name || ' ', chr(9) || ' ') || ']' || replace(p_brand, 'Brand#', 'B-') AS text FROM part")
def tmpl_trim_replace(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.lit("\t "), "p_name", F.lit(" ")).alias("wide"))
    return df.select("p_partkey", render(df, "[{{ wide|trim }}]{{ p_brand|replace('Brand#', 'B-') }}").alias("text"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' + ' ORDER BY o_orderkey) || ' = ' || count(*) AS text FROM orders GROUP BY 1")
def tmpl_join(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    return lists.select("o_custkey", render(lists, "{{ keys|join(' + ') }} = {{ keys|length }}").alias("text"))


@query("SELECT o_orderkey, trunc(o_totalprice)::BIGINT || '|' || 0 || '|' || o_orderkey AS text FROM orders")
def tmpl_int_float(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "orders", "o_orderkey", "{{ o_totalprice|int }}|{{ o_orderstatus|int }}|{{ o_orderkey|float }}")


@query("SELECT c_custkey, 'none|' || CASE WHEN c_custkey % 3 = 0 THEN 'gap' ELSE c_name END || '|' || CASE WHEN c_nationkey = 0 THEN -1 ELSE c_nationkey END AS text FROM customer")
def tmpl_default(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").withColumn("maybe", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    return df.select("c_custkey", render(df, "{{ nothing|default('none') }}|{{ maybe|default('gap') }}|{{ c_nationkey|default(-1, true) }}").alias("text"))


@query("""
    SELECT p_partkey, (p_size < 10)::VARCHAR || '|' || (p_size = 7)::VARCHAR || '|' || (p_brand > 'Brand#3')::VARCHAR || '|' || (p_size BETWEEN 5 AND 20)::VARCHAR AS text FROM part
""")
def tmpl_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, "part", "p_partkey", "{{ p_size < 10 }}|{{ p_size == '7.0' }}|{{ p_brand > 'Brand#3' }}|{{ not (p_size < 5 or p_size > 20) }}")


@query("""
    WITH o AS (SELECT o_custkey, list(o_orderkey) AS keys FROM orders GROUP BY 1)
    SELECT o_custkey, list_contains(keys, 7)::VARCHAR || '|' || (o_custkey::VARCHAR LIKE '%1%')::VARCHAR || '|' || (NOT list_contains(keys, o_custkey))::VARCHAR AS text FROM o
""")
def tmpl_in(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    lists = lists.withColumn("name", F.col("o_custkey").cast("string"))
    return lists.select("o_custkey", render(lists, "{{ '7' in keys }}|{{ 1 in name }}|{{ o_custkey not in keys }}").alias("text"))


@query("""
    SELECT c_custkey, 'true|true|true|true|false|' || (c_custkey % 3 = 0)::VARCHAR || '|' || (c_custkey % 3 <> 0)::VARCHAR || '|false' AS text FROM customer
""")
def tmpl_tests(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").withColumn("maybe", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    source = "{{ maybe is defined }}|{{ nothing is undefined }}|{{ c_name is string }}|{{ c_acctbal is number }}|{{ c_name is iterable }}|{{ maybe is none }}|{{ maybe is not none }}|{{ maybe is odd }}"
    return df.select("c_custkey", render(df, source).alias("text"))

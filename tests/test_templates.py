import json

import pytest

from quernel.errors import BadExpression, BadSyntax, IncludeNotFound, TemplateError, TypeMismatch, UnexpectedEnd, UnknownTag
from quernel.functions.compiler import Compiler, NeedsInterpreter, Value, interpreted, render
from quernel.functions.interpreter import Environment, Options, float_text

#: (document, template, text); each goes through the interpreter and the compiler.
CASES = [
    ({"part": {"sku": "A&B \"x\"", "spare": False}}, "{{ part.sku }}:{% if part.spare %}spare{% elif part.sku %}named{% else %}bare{% endif %}", "A&amp;B &#34;x&#34;:named"),
    ({"depths": [4, 0, 9], "shelf": [""][:0]}, "{% for d in depths %}{{ d }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %};{% for b in shelf %}{{ b }}{% else %}bare{% endfor %}", "4,0,9;bare"),
    ({"note": "5 > 3 & so on"}, "{{ note }}~{{ note|safe }}~{{ note|safe|upper }}", "5 &gt; 3 &amp; so on~5 > 3 & so on~5 &gt; 3 &amp; SO ON"),
    ({"rivers": ["Oder", "Main"], "flow": 7.5}, "{% if flow > 7 and 'Main' in rivers %}deep{% endif %}{% if 'Rhein' not in rivers|join('/') %} no{% endif %}{% if gauge is defined %}!{% else %} gauge{% endif %}", "deep no gauge"),
    ({"n": 2}, "x\n {%- set m = n -%} \ty {{- m -}}  z", "xy2z"),
    ({"a": "x"}, "{# note #}{{ a }}{# {{ a }} #}", "x"),
    ({"a": "x"}, "open {{ a", "open {{ a"),
    ({"a": 10}, "{{ '10' == a }}{{ a == 10.0 }}{{ true == 1 }}{{ nothing == '' }}", "truetruetruetrue"),
    ({"a": 3}, "{{ 1 < 2 < 3 }}{{ 3 > 2 > 1 }}{{ 'b' > 'a' }}{{ 'é' > 'z' }}", "truefalsetruetrue"),
    ({"a": [1, 2], "s": "abc"}, "{{ 1 in a }}{{ '1' in a }}{{ 3 not in a }}{{ 'b' in s }}{{ 'x' in nothing }}", "truetruetruetruefalse"),
    ({"a": "o'neil a1b É"}, "{{ a|title|safe }}|{{ a|capitalize|safe }}|{{ a|upper|safe }}", "O'Neil A1B É|O'neil a1b É|O'NEIL A1B É"),
    ({"a": "\t x\r\n"}, "[{{ a|trim }}]", "[x]"),
    ({"a": "é", "l": [1, 2, 3], "n": 5}, "{{ a|length }}{{ l|length }}{{ n|length }}{{ nothing|length }}", "2310"),
    ({"a": "aXbX"}, "{{ a|replace('X', '-') }}{{ a|replace('', '-') }}", "a-b-aXbX"),
    ({"a": "3.7", "b": " 42 ", "c": 3.9, "d": True}, "{{ a|int }}|{{ b|int }}|{{ c|int }}|{{ d|int }}|{{ a|float }}|{{ 'x'|float }}", "0|42|3|1|3.7|0"),
    ({"a": None, "b": "", "c": "x"}, "{{ a|default('n') }}{{ b|default('e') }}{{ b|default('f', true) }}{{ c|default('y') }}", "nfx"),
    ({"a": "<"}, "{{ a|escape }}{{ a|e|upper }}{{ a|safe|lower }}{{ a|string }}", "&lt;&amp;LT;&lt;&lt;"),
    ({"a": 1.0, "b": 42.5, "c": 1e20, "d": 1.5e-7, "e": -0.001}, "{{ a }} {{ b }} {{ c }} {{ d }} {{ e }}", "1 42.5 100000000000000000000 0.00000015 -0.001"),
    ({"a": {"b": [{"c": "deep"}]}}, "{{ a.b[0].c }}{{ a['b'][0][\"c\"] }}{{ a.b[7].c }}{{ a.x.y }}", "deepdeep"),
    ({"l": [[1, 2], [3]]}, "{% for r in l %}{% for x in r %}{{ loop.index0 }}{{ x }}{% if loop.last %};{% endif %}{% endfor %}{% endfor %}", "0112;03;"),
    ({"l": [1]}, "{% set t = 'top' %}{% for x in l %}{{ t }}{{ x }}{{ loop.first }}{{ loop.length }}{% endfor %}", "top1true1"),
    ({"l": [1, 2, 3]}, "{% for x in l %}{{ was|default('-') }}{% set was = x %}{% endfor %}{{ was|default('gone') }}", "-12gone"),
    ({"a": True}, "{{ a and not nothing }}{{ nothing or '' }}{{ (a) }}", "truefalsetrue"),
    ({"a": "x", "n": 1, "b": False, "l": [0]}, "{{ a is string }}{{ n is number }}{{ b is boolean }}{{ l is iterable }}{{ a is not iterable }}{{ a is unknown }}{{ a is none }}", "truetruetruetruetruefalsefalse"),
    ({"a": "q\"'&"}, "{{ a }}", "q&#34;&#39;&amp;"),
    ({"a": 1}, "{{ 'line\\n\\t\\q' }}{{ -5 }}{{ 2.50 }}", "line\n\tq-52.5"),
    ({"l": ["a", None, "b"]}, "{{ l|join('-') }}", "a--b"),
    ({"a": 5}, "{% if a == 1 %}1{% elif a == 5 %}5{% endif %}", "5"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_both_ways(spark, case):
    document, source, text = CASES[case]
    assert Environment().render(source, document) == text
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(document)]))
    assert df.select(render(df, source).alias("t")).first().t == text


def test_includes(spark):
    environment = Environment()
    environment.add_template("ring", "{{ tree.name }}/{{ tree.rings }}")
    source = "{% for tree in grove %}{% include 'ring' %}{% if not loop.last %} + {% endif %}{% endfor %}"
    document = {"grove": [{"name": "oak", "rings": 120.0}, {"name": "yew", "rings": 8.25}]}
    assert environment.render(source, document) == "oak/120 + yew/8.25"
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(document)]))
    assert df.select(render(df, source, environment).alias("t")).first().t == "oak/120 + yew/8.25"
    environment.add_template("depth", "{{ metres }}m")
    assert environment.render("( {%- include 'depth' -%}\n)", {"metres": 12}) == "(12m)"
    environment.add_template("self", "{% include 'self' %}")
    with pytest.raises(BadSyntax):
        environment.render("{% include 'self' %}", {})


@pytest.mark.parametrize(("source", "error"), [
    ("{% endif %}", UnknownTag), ("{% if a %}", UnexpectedEnd), ("{% for x in a %}", UnexpectedEnd), ("{% for 1 in a %}{% endfor %}", BadSyntax), ("{% set a %}", BadSyntax),
    ("{{ a|nope }}", BadExpression), ("{{ a b }}", BadExpression), ("{{ 'open }}", BadExpression), ("{{ a|default }}", BadExpression), ("{{ a|replace('x') }}", BadExpression),
    ("{% include 'none' %}", IncludeNotFound), ("{% for x in a %}{% endfor %}", TypeMismatch), ("{{ a|join }}", TypeMismatch), ("{{ (a }}", BadExpression), ("{{ }}", BadExpression), ("{{ - }}", BadExpression),
])
def test_errors(spark, source, error):
    with pytest.raises(error):
        Environment().render(source, {"a": 1})
    df = spark.range(1).selectExpr("1 as a")
    with pytest.raises(error):
        render(df, source)
    assert issubclass(error, TemplateError)


def test_options(spark):
    with pytest.raises(BadExpression):
        Environment(Options(missing_is_error=True)).render("{{ nothing }}", {})
    assert Environment(Options(missing_is_error=True)).render("{{ nothing|default('x') }}{% if nothing %}y{% endif %}", {}) == "x"
    assert Environment(Options(autoescape=False)).render("{{ a }}", {"a": "<"}) == "<"
    df = spark.range(1).selectExpr("'<' as a")
    assert df.select(render(df, "{{ a }}", Environment(Options(autoescape=False))).alias("t")).first().t == "<"


def test_carried_values_go_to_the_interpreter(spark):
    df = spark.range(1).selectExpr("array(1, 2) as l")
    root = {"l": Value(df["l"], df.schema["l"].dataType)}
    from quernel.functions import syntax

    with pytest.raises(NeedsInterpreter):
        Compiler(Environment(), root).body(syntax.parse("{% for x in l %}{% set y = x %}{% endfor %}"))
    assert df.select(interpreted(df, "{{ l|length }}").alias("t")).first().t == "2"


def test_numbers_as_text():
    assert [float_text(x) for x in (1.0, 0.1 + 0.2, 1e21, 1e-9, -0.0, float("nan"), float("-inf"))] == ["1", "0.30000000000000004", "1000000000000000000000", "0.000000001", "-0", "nan", "-inf"]

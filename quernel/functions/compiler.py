"""Templates compiled to column expressions.

The template is parsed once on the driver and typed against the schema; what comes out is one string
column that runs inside code generation, with higher-order functions for loops.  What can't be typed ahead
(values that one turn of a loop leaves for the next, includes that recurse) is rendered by the interpreter
in Arrow batches instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import BadExpression, TypeMismatch
from quernel.functions import expressions, syntax
from quernel.functions.interpreter import NEEDED, Environment

BLANK = expressions.BLANK
A_TO_Z, a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


class NeedsInterpreter(Exception):
    """This template can't be one column expression."""


@dataclass(frozen=True)
class Value:
    """A column with its type; no type means that the value is missing, NullType that it is null."""

    column: Column | None
    kind: T.DataType | None
    safe: bool = False


MISSING = Value(None, None)


def literal(x) -> Value:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
    kind = kinds[type(x)]
    return Value(F.lit(x).cast(kind) if x is not None else F.lit(None), kind)


def is_text(v: Value) -> bool:
    return isinstance(v.kind, (T.StringType, T.VarcharType, T.CharType))


def is_number(v: Value) -> bool:
    return isinstance(v.kind, T.NumericType)


def float_text(x: Column) -> Column:
    """Digits without an exponent and without a trailing point zero."""
    plain = x.cast("string")
    sign = F.when(plain.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    parts = F.split(F.regexp_replace(plain, "^-", ""), "E")
    digits = F.regexp_replace(F.regexp_replace(parts[0], r"\.", ""), "0+$", "")
    power = parts[1].cast("int")
    grown = F.when(F.length(digits) > power + 1, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(F.rpad(digits, power + 1, F.lit("0")))
    shrunk = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return (
        F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
        .when(plain.contains("E"), F.concat(sign, F.when(power >= 0, grown).otherwise(shrunk)))
        .otherwise(F.regexp_replace(plain, r"\.0$", ""))
    )


def text_of(v: Value) -> Column:
    if v.kind is None or isinstance(v.kind, T.NullType):
        return F.lit("")
    if isinstance(v.kind, (T.DoubleType, T.FloatType)):
        made = float_text(v.column)
    elif isinstance(v.kind, (T.ArrayType, T.StructType, T.MapType)):
        made = F.to_json(v.column)
    else:
        made = v.column.cast("string")
    return F.coalesce(made, F.lit(""))


def truthy(v: Value) -> Column:
    if v.kind is None or isinstance(v.kind, T.NullType):
        return F.lit(False)
    if isinstance(v.kind, T.BooleanType):
        made = v.column
    elif is_number(v):
        made = v.column != 0
    elif isinstance(v.kind, (T.ArrayType, T.MapType)):
        made = F.size(v.column) > 0
    elif isinstance(v.kind, T.StructType):
        made = v.column.isNotNull() & F.lit(len(v.kind.fields) > 0)
    else:
        made = F.length(v.column.cast("string")) > 0
    return F.coalesce(made, F.lit(False))


def as_float(v: Value) -> Column:
    """Null where the value isn't a number."""
    if isinstance(v.kind, (T.NumericType, T.BooleanType)):
        return v.column.cast("double")
    if is_text(v):
        trimmed = F.btrim(v.column, F.lit(BLANK))
        return F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))
    return F.lit(None).cast("double")


def compare(op: str, a: Value, b: Value) -> Column:
    x, y, s, t = as_float(a), as_float(b), text_of(a), text_of(b)
    of = {"==": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    numbers = F.when(F.isnan(x) | F.isnan(y), F.lit(op == "!=")).otherwise(of(x, y))
    return F.when(x.isNotNull() & y.isNotNull(), numbers).otherwise(of(s, t))


def contains(needle: Value, within: Value) -> Column:
    if is_text(within):
        return F.coalesce(F.contains(within.column, text_of(needle)), F.lit(False))
    if isinstance(within.kind, T.ArrayType):
        wanted = text_of(needle)
        return F.coalesce(F.exists(within.column, lambda x: text_of(Value(x, within.kind.elementType)) == wanted), F.lit(False))
    return F.lit(False)


def has_type(name: str, v: Value) -> Column:
    there = v.column.isNotNull() if v.kind is not None else F.lit(False)
    known = {
        "defined": F.lit(v.kind is not None),
        "undefined": F.lit(v.kind is None),
        "none": F.lit(False) if v.kind is None else v.column.isNull(),
        "string": there if is_text(v) else F.lit(False),
        "number": there if is_number(v) else F.lit(False),
        "boolean": there if isinstance(v.kind, T.BooleanType) else F.lit(False),
        "iterable": there if isinstance(v.kind, T.ArrayType) else F.lit(False),
    }
    return known["none" if name == "null" else name] if name in known or name == "null" else F.lit(False)


def escaped(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def upper(text: Column) -> Column:
    return F.translate(text, a_to_z, A_TO_Z)


def lower(text: Column) -> Column:
    return F.translate(text, A_TO_Z, a_to_z)


def capitalised(text: Column) -> Column:
    return F.concat(upper(F.substring(text, 1, 1)), lower(F.substr(text, F.lit(2))))


def title(text: Column) -> Column:
    """Runs of letters are capitalised; whatever stands between them starts the next one."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    return F.array_join(F.transform(runs, capitalised), "")


def length(v: Value) -> Column:
    if v.kind is None or isinstance(v.kind, T.NullType):
        return F.lit(0).cast("long")
    if is_text(v):
        made = F.octet_length(v.column)
    elif isinstance(v.kind, (T.ArrayType, T.MapType)):
        made = F.size(v.column)
    else:
        made = F.lit(len(v.kind.fields) if isinstance(v.kind, T.StructType) else 1)
    return F.when(v.column.isNull(), F.lit(0)).otherwise(made).cast("long")


def whole(v: Value) -> Column:
    if is_text(v):
        trimmed = F.btrim(v.column, F.lit(BLANK))
        made = F.when(trimmed.rlike("^[+-]?[0-9]+$"), trimmed.try_cast("long"))
    elif isinstance(v.kind, (T.DoubleType, T.FloatType)):
        made = v.column.try_cast("long")
    elif isinstance(v.kind, (T.NumericType, T.BooleanType)):
        made = v.column.cast("long")
    else:
        made = F.lit(None).cast("long")
    return F.coalesce(made, F.lit(0).cast("long"))


def chosen(condition: Column, a: Value, b: Value) -> Value:
    """a where the condition holds, else b; of two types their common one."""
    if a.kind is None or isinstance(a.kind, T.NullType):
        return Value(F.when(~condition, b.column), b.kind, b.safe) if b.kind is not None else b
    if b.kind is None or isinstance(b.kind, T.NullType):
        return Value(F.when(condition, a.column), a.kind, a.safe)
    if a.kind == b.kind and a.safe == b.safe:
        return Value(F.when(condition, a.column).otherwise(b.column), a.kind, a.safe)
    if is_number(a) and is_number(b):
        kind = T.LongType() if isinstance(a.kind, T.IntegralType) and isinstance(b.kind, T.IntegralType) else T.DoubleType()
        return Value(F.when(condition, a.column.cast(kind)).otherwise(b.column.cast(kind)), kind)
    if a.safe != b.safe:
        sides = [text_of(v) if v.safe else escaped(text_of(v)) for v in (a, b)]
        return Value(F.when(condition, sides[0]).otherwise(sides[1]), T.StringType(), True)
    return Value(F.when(condition, text_of(a)).otherwise(text_of(b)), T.StringType(), a.safe)


class Compiler:
    def __init__(self, environment: Environment, root: dict[str, Value]):
        self.environment = environment
        #: Innermost last; names that hold a dot stand for themselves (``loop.index``).
        self.scopes: list[dict[str, Value]] = [root]
        self.depth = 0

    def body(self, nodes: tuple) -> Column:
        made = [self._node(n) for n in nodes]
        made = [c for c in made if c is not None]
        return F.concat(*made) if len(made) > 1 else made[0] if made else F.lit("")

    def _node(self, node: tuple) -> Column | None:
        kind = node[0]
        if kind == "text":
            return F.lit(node[1])
        if kind == "out":
            v = self.value(node[1])
            if v.kind is None and self.environment.options.missing_is_error:
                raise BadExpression("a missing value is printed")
            return text_of(v) if v.safe or not self.environment.options.autoescape else escaped(text_of(v))
        if kind == "if":
            return self._if(node[1])
        if kind == "set":
            if len(self.scopes) > 2 or self.depth < 0:
                raise NeedsInterpreter("a loop or a branch sets a value")
            if len(self.scopes) == 1:
                self.scopes.append({})
            self.scopes[-1][node[1]] = self.value(node[2])
            return None
        if kind == "include":
            return self._include(node[1])
        return self._loop(*node[1:])

    def _if(self, branches: tuple) -> Column:
        before = [dict(s) for s in self.scopes]
        made, other = None, F.lit("")
        for condition, nodes in branches:
            test = None if condition is None else truthy(self.value(condition))
            body = self.body(nodes)
            if [list(s) for s in self.scopes] != [list(s) for s in before] or any(s[k] is not b[k] for s, b in zip(self.scopes, before, strict=True) for k in s):
                raise NeedsInterpreter("a branch sets a value")
            if test is None:
                other = body
            else:
                made = F.when(test, body) if made is None else made.when(test, body)
        return made.otherwise(other)

    def _include(self, name: str) -> Column:
        nodes = syntax.parse(self.environment.source(name))
        self.depth += 1
        if self.depth > self.environment.options.max_include_depth:
            raise NeedsInterpreter("includes are nested too deep")
        made = self.body(nodes)
        self.depth -= 1
        return made

    def _loop(self, name: str, over, nodes: tuple, other: tuple) -> Column:
        items = self.value(over)
        if not isinstance(items.kind, T.ArrayType):
            raise TypeMismatch("a loop needs an array")
        n = F.size(items.column)

        def turn(x: Column, k: Column) -> Column:
            self.scopes.append({
                name: Value(x, items.kind.elementType), "loop.index": Value(k + 1, T.LongType()), "loop.index0": Value(k, T.LongType()),
                "loop.first": Value(k == 0, T.BooleanType()), "loop.last": Value(k == n - 1, T.BooleanType()), "loop.length": Value(n, T.LongType()),
            })
            depth = len(self.scopes)
            try:
                # A third scope tells a nested ``set`` apart from one at the top.
                if depth == 2:
                    self.scopes.insert(1, {})
                return self.body(nodes)
            finally:
                self.scopes.pop()
                if depth == 2:
                    self.scopes.pop(1)

        # A null array is an error of its row, as a loop over anything but an array is.
        checked = F.when(items.column.isNotNull(), items.column).otherwise(F.raise_error(F.lit("TypeMismatch: a loop needs an array")).cast(items.kind))
        made = F.array_join(F.transform(checked, turn), "")
        return F.when(F.size(checked) == 0, self.body(other)).otherwise(made)

    def lookup(self, path: str) -> Value:
        for scope in reversed(self.scopes[1:]):
            if path in scope:
                return scope[path]
        way = expressions.steps(path)
        if not way:
            return MISSING
        for scope in reversed(self.scopes):
            if way[0] in scope:
                return follow(scope[way[0]], way[1:])
        return MISSING

    def value(self, tree) -> Value:
        kind = tree[0]
        if kind == "lit":
            return literal(tree[1])
        if kind == "path":
            return self.lookup(tree[1])
        if kind == "not":
            return Value(~truthy(self.value(tree[1])), T.BooleanType())
        if kind in ("and", "or"):
            a, b = truthy(self.value(tree[1])), truthy(self.value(tree[2]))
            return Value(a & b if kind == "and" else a | b, T.BooleanType())
        if kind == "test":
            made = has_type(tree[1], self.value(tree[3]))
            return Value(~made if tree[2] else made, T.BooleanType())
        if kind == "cmp":
            a, b = self.value(tree[2]), self.value(tree[3])
            made = compare(tree[1], a, b) if "in" not in tree[1] else contains(a, b)
            return Value(~made if tree[1] == "not in" else made, T.BooleanType())
        return self._filter(tree[1], self.value(tree[2]), [self.value(a) for a in tree[3]])

    def _filter(self, name: str, v: Value, args: list[Value]) -> Value:
        text = T.StringType()
        one = {
            "safe": lambda: Value(text_of(v), text, True), "escape": lambda: Value(escaped(text_of(v)), text, True), "e": lambda: Value(escaped(text_of(v)), text, True),
            "string": lambda: Value(text_of(v), text), "lower": lambda: Value(lower(text_of(v)), text), "upper": lambda: Value(upper(text_of(v)), text),
            "capitalize": lambda: Value(capitalised(text_of(v)), text), "title": lambda: Value(title(text_of(v)), text),
            "trim": lambda: Value(F.btrim(text_of(v), F.lit(BLANK)), text), "length": lambda: Value(length(v), T.LongType()),
            "int": lambda: Value(whole(v), T.LongType()), "float": lambda: Value(F.coalesce(as_float(v), F.lit(0.0)), T.DoubleType()),
        }
        if name in one:
            return one[name]()
        if name not in NEEDED or len(args) < NEEDED[name]:
            raise BadExpression(f"filter {name}")
        if name == "replace":
            return Value(F.replace(text_of(v), text_of(args[0]), text_of(args[1])), text)
        if name == "join":
            if not isinstance(v.kind, T.ArrayType):
                raise TypeMismatch("join needs an array")
            parts = F.transform(v.column, lambda x: text_of(Value(x, v.kind.elementType)))
            made = F.concat_ws("", F.transform(parts, lambda x, k: F.concat(F.when(k > 0, text_of(args[0])).otherwise(F.lit("")), x))) if args else F.array_join(parts, "")
            return Value(F.when(v.column.isNull(), F.raise_error(F.lit("TypeMismatch: join needs an array")).cast("string")).otherwise(made), text)
        if v.kind is None or isinstance(v.kind, T.NullType):
            return args[0]
        instead = v.column.isNull()
        if len(args) > 1:
            instead = instead | (truthy(args[1]) & ~truthy(v))
        return chosen(instead, args[0], v)


def follow(v: Value, way: list[str | int]) -> Value:
    for step in way:
        if isinstance(step, int) and isinstance(v.kind, T.ArrayType):
            v = Value(F.get(v.column, F.lit(step)), v.kind.elementType)
        elif isinstance(step, str) and isinstance(v.kind, T.StructType) and step in v.kind.names:
            v = Value(v.column.getField(step), v.kind[step].dataType)
        elif isinstance(step, str) and isinstance(v.kind, T.MapType):
            v = Value(F.try_element_at(v.column, F.lit(step)), v.kind.valueType)
        else:
            return MISSING
    return v


def render(df: DataFrame, source: str, environment: Environment | None = None) -> Column:
    """The template rendered for every row, whose columns are the document; one expression if it can be."""
    environment = environment or Environment()
    root = {f.name: Value(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields}
    try:
        return Compiler(environment, root).body(syntax.parse(source))
    except NeedsInterpreter:
        return interpreted(df, source, environment)


def interpreted(df: DataFrame, source: str, environment: Environment | None = None) -> Column:
    """The same by the interpreter, in Arrow batches."""
    environment = environment or Environment()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for documents in batches:
            yield pd.Series([environment.render(source, json.loads(d)) for d in documents])

    return run(F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]), {"ignoreNullFields": "false"}))

"""The template language's expressions: a lexer, and a parser to a small tree.

The tree is made of tuples whose first item names the kind:
``("lit", value)``, ``("path", text)``, ``("not", e)``, ``("and"|"or", a, b)``, ``("cmp", op, a, b)``,
``("test", name, negated, e)`` and ``("filter", name, e, args)``.
"""

from __future__ import annotations

import re

from quernel.errors import BadExpression

BLANK = " \t\r\n"
TOKEN = re.compile(
    r"""[ \t\r\n]*(?:
        (?P<op>==|!=|<=|>=|[<>|(),])
      | (?P<number>-[0-9]*(?:\.[0-9]*)?|[0-9]+(?:\.[0-9]*)?)
      | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      | (?P<path>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]*|\[(?:[^\]"']|"[^"]*"|'[^']*')*\]?)*)
      | (?P<end>\Z)
    )""",
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(.)", re.S)
WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None, "null": None}
SMALLEST, LARGEST = -(2**63), 2**63 - 1


def unquote(token: str) -> str:
    return ESCAPE.sub(lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), token[1:-1])


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of an expression's tokens, with an end mark."""
    out, at = [], 0
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            raise BadExpression(f"unexpected text in expression: {text[at : at + 20]!r}")
        kind = m.lastgroup or "end"
        out.append((kind, m[kind]))
        if kind == "end":
            return out
        at = m.end()


class Parser:
    """Binding, loosest first: filters of the whole, or, and, not, comparison, filters of an operand, ``is``."""

    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def parse(self):
        tree = self.whole()
        if self.items[self.at][0] != "end":
            raise BadExpression(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def _take(self, kind: str, *texts: str) -> str | None:
        k, t = self.items[self.at]
        if k == kind and (not texts or t in texts):
            self.at += 1
            return t
        return None

    def _name(self) -> str:
        t = self._take("path")
        if t is None or not t.replace("_", "a").isalnum():
            raise BadExpression("a name is missing")
        return t

    def whole(self):
        return self._filtered(self._joined(0))

    def _filtered(self, tree):
        while self._take("op", "|"):
            name, args = self._name(), []
            if self._take("op", "(") and not self._take("op", ")"):
                args.append(self.whole())
                while self._take("op", ","):
                    args.append(self.whole())
                if not self._take("op", ")"):
                    raise BadExpression("a filter's arguments aren't closed")
            tree = ("filter", name, tree, tuple(args))
        return tree

    def _joined(self, level: int):
        word = ("or", "and")[level]
        below = self._negated if level else lambda: self._joined(1)
        tree = below()
        while self._take("path", word):
            tree = (word, tree, below())
        return tree

    def _negated(self):
        if self._take("path", "not"):
            return ("not", self._negated())
        return self._compared()

    def _compared(self):
        tree = self._filtered(self._tested())
        while True:
            op = self._take("op", "==", "!=", "<=", ">=", "<", ">") or self._take("path", "in")
            if not op and self.items[self.at] == ("path", "not") and self.items[self.at + 1] == ("path", "in"):
                self.at += 2
                op = "not in"
            if not op:
                return tree
            tree = ("cmp", op, tree, self._filtered(self._tested()))

    def _tested(self):
        tree = self._operand()
        if self._take("path", "is"):
            negated = bool(self._take("path", "not"))
            tree = ("test", self._name(), negated, tree)
        return tree

    def _operand(self):
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "op" and text == "(":
            tree = self.whole()
            if not self._take("op", ")"):
                raise BadExpression("a bracket isn't closed")
            return tree
        if kind == "string":
            return ("lit", unquote(text))
        if kind == "number":
            try:
                value = float(text) if "." in text else int(text)
            except ValueError:
                raise BadExpression(f"not a number: {text!r}") from None
            if isinstance(value, int) and not SMALLEST <= value <= LARGEST:
                raise BadExpression(f"not a 64-bit number: {text!r}")
            return ("lit", value)
        if kind == "path":
            return ("lit", WORDS[text]) if text in WORDS else ("path", text)
        raise BadExpression(f"unexpected {text!r}")


def parse(text: str):
    return Parser(text).parse()


STEP = re.compile(r"(?:^|\.)([A-Za-z_][A-Za-z0-9_]*)|\[[ \t\r\n]*(?:([0-9]+)|(\"[^\]]*\"|'[^\]]*'))[ \t\r\n]*\]")


def steps(path: str) -> list[str | int] | None:
    """Keys and indexes of a path; None if it isn't well formed, which makes its value missing."""
    out: list[str | int] = []
    at = 0
    while at < len(path):
        m = STEP.match(path, at)
        if m is None:
            return None
        out.append(m[1] if m[1] is not None else int(m[2]) if m[2] is not None else unquote(m[3]))
        at = m.end()
    return out

"""The template language's statements: tags to a small tree.

Nodes: ``("text", s)``, ``("out", expr)``, ``("if", ((condition or None, body), ...))``,
``("for", name, expr, body, else_body)``, ``("set", name, expr)`` and ``("include", name)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quernel.errors import BadSyntax, UnexpectedEnd, UnknownTag
from quernel.functions import expressions

OPENER = re.compile(r"\{[{%#]")
CLOSER = {"{{": "}}", "{%": "%}", "{#": "#}"}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
HEAD = re.compile(r"[A-Za-z0-9_]*")
IN = re.compile(r"(?<![A-Za-z0-9_])in(?![A-Za-z0-9_])")
BLANK = expressions.BLANK


@dataclass
class Piece:
    """Literal text, or a tag with its content."""

    kind: str  # "text", "{{" or "{%"
    text: str


def pieces(source: str) -> list[Piece]:
    """Text and tags in order.  A dash inside a tag's edge trims the text on that side; a tag that isn't closed is text."""
    out, at = [], 0
    while True:
        m = OPENER.search(source, at)
        body = m.end() + source.startswith("-", m.end()) if m else 0
        end = source.find(CLOSER[m[0]], body) if m else -1
        if m is None or end < 0:
            out.append(Piece("text", source[at:]))
            return [p for p in out if p.kind != "text" or p.text]
        before = source[at : m.start()]
        out.append(Piece("text", before.rstrip(BLANK) if body > m.end() else before))
        trim_after = end > body and source[end - 1] == "-"
        if m[0] != "{#":
            out.append(Piece(m[0], source[body : end - trim_after].strip(BLANK)))
        at = end + 2
        if trim_after:
            at += len(source) - at - len(source[at:].lstrip(BLANK))


class Parser:
    def __init__(self, source: str):
        self.items, self.at = pieces(source), 0

    def parse(self) -> tuple:
        return self._until(())[0]

    def _until(self, stops: tuple[str, ...]) -> tuple[tuple, str, str]:
        """Nodes up to one of the closing tags, its name, and what stands in it."""
        nodes = []
        while self.at < len(self.items):
            p = self.items[self.at]
            self.at += 1
            if p.kind == "text":
                nodes.append(("text", p.text))
            elif p.kind == "{{":
                nodes.append(("out", expressions.parse(p.text)))
            else:
                head = HEAD.match(p.text)[0]
                rest = p.text[len(head) :].strip(BLANK)
                if head in stops:
                    return tuple(nodes), head, rest
                made = {"if": self._if, "for": self._for, "set": self._set, "include": self._include}.get(head)
                if made is None:
                    raise UnknownTag(head)
                nodes.append(made(rest))
        if stops:
            raise UnexpectedEnd(f"one of {', '.join(stops)} is missing")
        return tuple(nodes), "", ""

    def _if(self, rest: str):
        branches, stop = [], "elif"
        while stop == "elif":
            condition = expressions.parse(rest)
            body, stop, rest = self._until(("elif", "else", "endif"))
            branches.append((condition, body))
        if stop == "else":
            branches.append((None, self._until(("endif",))[0]))
        return ("if", tuple(branches))

    def _for(self, rest: str):
        m = IN.search(rest)
        name, over = (rest[: m.start()].strip(BLANK), rest[m.end() :].strip(BLANK)) if m else ("", "")
        if not NAME.match(name) or not over:
            raise BadSyntax(f"for {rest}")
        body, stop, _ = self._until(("else", "endfor"))
        other = self._until(("endfor",))[0] if stop == "else" else ()
        return ("for", name, expressions.parse(over), body, other)

    def _set(self, rest: str):
        name, mark, value = rest.partition("=")
        name, value = name.strip(BLANK), value.strip(BLANK)
        if not mark or not NAME.match(name) or not value:
            raise BadSyntax(f"set {rest}")
        return ("set", name, expressions.parse(value))

    def _include(self, rest: str):
        kinds = expressions.tokens(rest)
        if len(kinds) != 2 or kinds[0][0] != "string":
            raise BadSyntax(f"include {rest}")
        return ("include", expressions.unquote(kinds[0][1]))


def parse(source: str) -> tuple:
    return Parser(source).parse()

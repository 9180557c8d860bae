"""The infix formula language: one operator-precedence parser for the model and the table dialect.

``compile_masked`` yields masked columns for the model language, ``compile_plain`` ordinary ones. Formula
text is data: it is parsed, never evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import masked, plain
from quillon.mcol import MCol, literal

_TOKEN = re.compile(
    r"\s*(?:(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<op>\*\*|//|<<|>>|<=|>=|==|!=|<>|[-+*/%&|^~<>=(),{}])|(?P<name>[A-Za-z_][\w.]*))"
)
_COMPARE = {"<", "<=", ">", ">=", "==", "=", "!=", "<>"}
#: Binding strengths, loosest first: or, xor, and, not, comparison, |, ^, &, shifts, sums, products, signs, power.
_LEVELS = {"or": 1, "xor": 2, "and": 3, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "//": 11, "%": 11, "**": 13}
_NOT, _CHECK, _SIGN = 4, 5, 12


@dataclass(frozen=True)
class Node:
    kind: str
    value: object
    args: tuple[Node, ...] = ()


class FormulaError(ValueError):
    """Text that is no formula."""


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, [], 0
        pos = 0
        while text[pos:].strip():
            m = _TOKEN.match(text, pos)
            if not m:
                raise FormulaError(f"unexpected text at {pos}: {text[pos : pos + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def word(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k][1].lower() if k < len(self.tokens) and self.tokens[k][0] == "name" else self.peek(ahead)

    def take(self, expected: str | None = None) -> str:
        found = self.peek()
        if expected is not None and found != expected:
            raise FormulaError(f"expected {expected!r}, found {found!r} in {self.text!r}")
        self.at += 1
        return found

    def whole(self) -> list[Node]:
        out = [self.expression(0)]
        while self.peek() == ",":
            self.take()
            out.append(self.expression(0))
        if self.at != len(self.tokens):
            raise FormulaError(f"unexpected {self.peek()!r} in {self.text!r}")
        return out

    def expression(self, least: int) -> Node:
        left = self.prefix()
        while True:
            op = self.word()
            if op in _COMPARE or op in ("in", "like", "between") or (op == "not" and self.word(1) in ("in", "between")):
                if least > _CHECK:
                    return left
                left = self.comparison(left)
                continue
            level = _LEVELS.get(op)
            if level is None or level < least:
                return left
            self.take()
            right = self.expression(level if op == "**" else level + 1)
            left = Node("call", op, (left, right))

    def comparison(self, left: Node) -> Node:
        parts: list[Node] = []
        while True:
            op = self.word()
            negated = op == "not"
            if negated:
                self.take()
                op = self.word()
            if op in _COMPARE:
                self.take()
                right = self.expression(_CHECK + 1)
                parts.append(Node("call", op, (left, right)))
                left = right
            elif op == "in":
                self.take()
                close = "}" if self.take() == "{" else ")"
                items = []
                while self.peek() != close:
                    items.append(self.expression(0))
                    if self.peek() == ",":
                        self.take()
                self.take(close)
                parts.append(Node("call", "isNotIn" if negated else "isIn", (left, *items)))
            elif op == "like":
                self.take()
                parts.append(Node("call", "like", (left, self.expression(_CHECK + 1))))
            elif op == "between":
                self.take()
                low = self.expression(_CHECK + 1)
                if self.word() != "and":
                    raise FormulaError("between needs 'and'")
                self.take()
                parts.append(Node("call", "notBetween" if negated else "between", (left, low, self.expression(_CHECK + 1))))
            else:
                break
        out = parts[0]
        for p in parts[1:]:
            out = Node("call", "and", (out, p))
        return out

    def prefix(self) -> Node:
        if self.at >= len(self.tokens):
            raise FormulaError(f"unexpected end of {self.text!r}")
        kind, text = self.tokens[self.at]
        if text == "(":
            self.take()
            inner = self.expression(0)
            self.take(")")
            return inner
        if text in ("-", "+", "~"):
            self.take()
            inner = self.expression(_SIGN)
            return inner if text == "+" else Node("call", "negative" if text == "-" else "~", (inner,))
        self.take()
        if kind == "num":
            return Node("constant", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "str":
            return Node("constant", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind != "name":
            raise FormulaError(f"unexpected {text!r} in {self.text!r}")
        low = text.lower()
        if low == "not" and self.peek() != "(":
            return Node("call", "not", (self.expression(_NOT),))
        if low in ("true", "false") and self.peek() != "(":
            return Node("constant", low == "true")
        if self.peek() == "(":
            self.take()
            args = []
            while self.peek() != ")":
                args.append(self.expression(0))
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return Node("call", text, tuple(args))
        return Node("field", text)


def parse(text: str) -> Node:
    """One expression."""
    nodes = _Parser(text).whole()
    if len(nodes) != 1:
        raise FormulaError(f"one expression expected: {text!r}")
    return nodes[0]


def parse_list(text: str) -> list[Node]:
    """A comma-separated list of expressions."""
    return _Parser(text).whole()


def fields(node: Node) -> set[str]:
    """Names of the columns a formula reads."""
    return ({str(node.value)} if node.kind == "field" else set()).union(*(fields(a) for a in node.args))


def compile_masked(node: Node, scope: Mapping[str, MCol], legacy: bool = False, macros: Mapping[str, Callable[[list[MCol]], MCol]] | None = None) -> MCol:
    if node.kind == "constant":
        return literal(node.value)
    if node.kind == "field":
        if node.value not in scope:
            raise FormulaError(f"unknown field {node.value!r}")
        return scope[str(node.value)]
    return call(str(node.value), [compile_masked(a, scope, legacy, macros) for a in node.args], [a.value if a.kind == "constant" else None for a in node.args], legacy, macros)


def call(name: str, args: list[MCol], constants: list[object], legacy: bool = False, macros: Mapping[str, Callable[[list[MCol]], MCol]] | None = None) -> MCol:
    """Apply a function by name; both spellings of formatDatetime are known."""
    if macros and name in macros:
        return macros[name](args)
    if name.lower() == "formatdatetime":
        return masked.format_datetime(args[:1], str(constants[1]))
    table = masked.LEGACY if legacy else masked.TABLE
    if name not in table:
        raise FormulaError(f"unknown function {name!r}")
    return table[name](args)


def compile_plain(node: Node, scope: Mapping[str, Column] | None = None) -> Column:
    if node.kind == "constant":
        return F.lit(node.value)
    if node.kind == "field":
        return scope[str(node.value)] if scope is not None and node.value in scope else F.col(str(node.value))
    name = str(node.value)
    if name not in plain.TABLE:
        raise FormulaError(f"unknown function {name!r}")
    return plain.TABLE[name](*(compile_plain(a, scope) for a in node.args))


def column(text: str) -> Column:
    """A formula of the table language as a column."""
    return compile_plain(parse(text))

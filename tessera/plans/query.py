"""The boolean query language: words, AND, OR, NOT and parentheses.

Parsing happens on the driver and raises at once. By default odd operator positions are taken the
way an operator-stack machine takes them (NOT is left-associative there); `strict=True` reads NOT as
a prefix operator and rejects misplaced ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"NOT": (3, 1, "NOT requires one operand"), "AND": (2, 2, "AND requires two operands"), "OR": (1, 2, "OR requires two operands")}
# Unicode white space.
SPACE = re.compile("[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """A word (`op` empty) or an operator over operands."""

    op: str
    word: str = ""
    args: tuple[Node, ...] = ()

    def fold(self, leaf: Callable, ops: dict[str, Callable]):
        return ops[self.op](*(a.fold(leaf, ops) for a in self.args)) if self.op else leaf(self.word)

    def words(self) -> set[str]:
        return set().union(*(a.words() for a in self.args)) if self.op else {self.word} - {""}


def lex(query: str) -> list[str]:
    """Words as they are, operators in upper case behind a NUL so that they can't be words."""
    parts = [p for p in SPACE.split(re.sub(r"([()])", r" \1 ", query)) if p]
    return ["\0" + p.upper() if p in ("(", ")") or p.upper() in OPERATORS else p for p in parts]


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard with all operators left-associative."""
    out: list[str] = []
    held: list[str] = []
    rank = lambda t: OPERATORS[t[1:]][0] if t[1:] in OPERATORS else 0
    for t in tokens:
        if t[0] != "\0":
            out.append(t)
        elif t == "\0(":
            held.append(t)
        elif t == "\0)":
            while held and held[-1] != "\0(":
                out.append(held.pop())
            if not held:
                raise QueryError("mismatched parentheses")
            held.pop()
        else:
            while held and rank(held[-1]) >= rank(t):
                out.append(held.pop())
            held.append(t)
    if "\0(" in held:
        raise QueryError("mismatched parentheses")
    return out + held[::-1]


def _lenient(tokens: list[str], normalize: Callable[[str], str]) -> Node:
    stack: list[Node] = []
    for t in to_postfix(tokens):
        if t[0] != "\0":
            stack.append(Node("", normalize(t)))
            continue
        _, arity, message = OPERATORS[t[1:]]
        if len(stack) < arity:
            raise QueryError(message)
        args = tuple(stack[-arity:])
        stack[-arity:] = [Node(t[1:], args=args)]
    if len(stack) != 1:
        raise QueryError("invalid query evaluation")
    return stack[0]


def _strict(tokens: list[str], normalize: Callable[[str], str]) -> Node:
    left = list(reversed(tokens))

    def binary(ops: list[str]) -> Node:
        if not ops:
            return unary()
        node = binary(ops[1:])
        while left and left[-1] == "\0" + ops[0]:
            left.pop()
            node = Node(ops[0], args=(node, binary(ops[1:])))
        return node

    def unary() -> Node:
        if not left:
            raise QueryError("operand expected at the end")
        t = left.pop()
        if t == "\0NOT":
            return Node("NOT", args=(unary(),))
        if t == "\0(":
            node = binary(["OR", "AND"])
            if not left or left.pop() != "\0)":
                raise QueryError("mismatched parentheses")
            return node
        if t[0] == "\0":
            raise QueryError(f"operand expected before {t[1:]}")
        return Node("", normalize(t))

    node = binary(["OR", "AND"])
    if left:
        raise QueryError("invalid query evaluation")
    return node


def parse(query: str, normalize: Callable[[str], str] = str, strict: bool = False) -> Node:
    """The query as a tree whose words went through `normalize`; "" is a word that nothing matches."""
    return (_strict if strict else _lenient)(lex(query), normalize)


def predicate(node: Node, terms: Column) -> Column:
    """The query as one boolean Column over a document's array of matched terms."""
    leaf = lambda w: F.array_contains(terms, w) if w else F.lit(False)
    return node.fold(leaf, {"NOT": lambda a: ~a, "AND": lambda a, b: a & b, "OR": lambda a, b: a | b})


def matches_nothing(node: Node) -> bool:
    """Whether a document without any of the words fits."""
    return node.fold(lambda _: False, {"NOT": lambda a: not a, "AND": lambda a, b: a and b, "OR": lambda a, b: a or b})


__all__ = ["Node", "QueryError", "lex", "matches_nothing", "parse", "predicate", "to_postfix"]

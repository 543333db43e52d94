"""Rewrite rules as s-expressions: ``(add ?x (sub ?y ?x)) => ?y``."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<arrow>=>)|(?P<var>\?[A-Za-z][A-Za-z0-9]*)|(?P<ident>[A-Za-z][A-Za-z0-9]*)|(?P<int>[0-9]+))")


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Ident:
    name: str


#: A term is a Var, an Ident, an int, a bool or a tuple of terms.
Term = Var | Ident | int | bool | tuple


@dataclass(frozen=True)
class Rule:
    left: Term
    right: Term

    def __post_init__(self):
        unbound = variables(self.right) - variables(self.left)
        if unbound:
            raise ValueError(f"the left side does not bind {sorted(unbound)}")


def variables(term: Term) -> set[str]:
    if isinstance(term, Var):
        return {term.name}
    return set().union(*map(variables, term)) if isinstance(term, tuple) else set()


def _tokens(text: str):
    at = 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        yield m.lastgroup, m[m.lastgroup]
        at = m.end()


def parse(text: str) -> Rule:
    stack: list[list] = [[]]
    left = None
    for kind, word in _tokens(text):
        if kind == "open":
            stack.append([])
        elif kind == "close":
            if len(stack) == 1:
                raise SyntaxError("a list ends that never began")
            done = tuple(stack.pop())
            stack[-1].append(done)
        elif kind == "arrow":
            if left is not None or len(stack) > 1 or len(stack[0]) != 1:
                raise SyntaxError("one term is expected before =>")
            left, stack = stack[0][0], [[]]
        else:
            stack[-1].append(Var(word[1:]) if kind == "var" else int(word) if kind == "int" else word == "true" if word in ("true", "false") else Ident(word))
    if left is None or len(stack) > 1 or len(stack[0]) != 1:
        raise SyntaxError("a rule is two terms around =>")
    return Rule(left, stack[0][0])

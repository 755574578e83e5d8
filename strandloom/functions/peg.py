"""Parsing expressions that run inside the JVM.

A grammar is a tree of the nodes below.  ``java()`` writes it as a Java pattern in which every ordered choice is an
atomic group and every repetition is possessive, which is exactly the meaning of a parsing expression: the first
alternative that matches is taken and never reconsidered, a repetition never gives back.  Backtracking happens only where
an alternative fails as a whole and the next one starts from the same place.  ``match()`` is a plain interpreter of the
same tree; tests hold the two against each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class Node:
    def java(self) -> str:
        raise NotImplementedError

    def match(self, text: str, at: int) -> int | None:
        """The end of the match that starts at ``at``, or None."""
        raise NotImplementedError

    def __add__(self, other: Node) -> Node:
        return Seq((self, other))

    def __or__(self, other: Node) -> Node:
        return Choice((self, other))


@dataclass(frozen=True)
class Lit(Node):
    text: str

    def java(self) -> str:
        return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", self.text)

    def match(self, text, at):
        return at + len(self.text) if text.startswith(self.text, at) else None


@dataclass(frozen=True)
class OneOf(Node):
    chars: str
    negated: bool = False

    def java(self) -> str:
        return "[" + "^" * self.negated + "".join(f"\\x{{{ord(c):x}}}" for c in self.chars) + "]"

    def match(self, text, at):
        return at + 1 if at < len(text) and (text[at] in self.chars) != self.negated else None


@dataclass(frozen=True)
class End(Node):
    def java(self) -> str:
        return r"\z"

    def match(self, text, at):
        return at if at == len(text) else None


@dataclass(frozen=True)
class Seq(Node):
    parts: tuple[Node, ...]

    def java(self) -> str:
        return "".join(p.java() for p in self.parts)

    def match(self, text, at):
        for p in self.parts:
            if (at := p.match(text, at)) is None:
                return None
        return at


@dataclass(frozen=True)
class Choice(Node):
    parts: tuple[Node, ...]

    def java(self) -> str:
        return "(?>" + "|".join(p.java() for p in self.parts) + ")"

    def match(self, text, at):
        return next((e for p in self.parts if (e := p.match(text, at)) is not None), None)


@dataclass(frozen=True)
class Many(Node):
    part: Node
    least: int = 0

    def java(self) -> str:
        inner = self.part.java()
        return (inner if isinstance(self.part, OneOf) else f"(?:{inner})") + ("++" if self.least else "*+")

    def match(self, text, at):
        n = 0
        while (e := self.part.match(text, at)) is not None and e > at:
            at, n = e, n + 1
        return at if n >= self.least else None


@dataclass(frozen=True)
class Maybe(Node):
    part: Node

    def java(self) -> str:
        return f"(?:{self.part.java()})?+"

    def match(self, text, at):
        e = self.part.match(text, at)
        return at if e is None else e


@dataclass(frozen=True)
class Ahead(Node):
    part: Node
    negated: bool = False

    def java(self) -> str:
        return f"(?{'!' if self.negated else '='}{self.part.java()})"

    def match(self, text, at):
        return at if (self.part.match(text, at) is None) == self.negated else None

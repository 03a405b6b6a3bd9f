"""The query syntax of text search: words, phrases, prefixes, NEAR, columns, AND, OR, NOT.

A small reader turns a question into leaves (phrases, or several that must be near each other) and
the conjunctions of leaves, wanted and unwanted, that make it true.  What the matching does is Spark's.
"""

from __future__ import annotations

import re

# Columns of the index, and the distance of NEAR where none is given.
COLUMNS, DISTANCE = ("title", "content"), 10
#: Conjunctions of a question at most; it is refused beyond.
CLAUSES = 256

_PART = re.compile(r'\s*(?:(?P<text>"(?:[^"]|"")*")|(?P<word>\w+)|(?P<mark>[():*+,{}-]))')
_WORDS = re.compile(r"\w+")


class Refused(ValueError):
    """A question that does not follow the syntax."""


class Reader:
    def __init__(self, question: str):
        self.parts: list[tuple[str, str]] = []
        at, question = 0, question.rstrip()
        while at < len(question):
            m = _PART.match(question, at)
            if not m:
                raise Refused(question[at:])
            self.parts.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.leaves: list[dict] = []

    def peek(self, *marks: str, ahead: int = 0) -> bool:
        k = self.at + ahead
        return k < len(self.parts) and self.parts[k][0] != "text" and self.parts[k][1] in marks

    def take(self, *marks: str) -> bool:
        if self.peek(*marks):
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise Refused(mark)

    # clauses are pairs (wanted leaves, unwanted leaves)

    def question(self) -> list:
        out = self.either(None)
        if self.at < len(self.parts):
            raise Refused("rest")
        return out

    def either(self, column: str | None) -> list:
        out = self.all_of(column)
        while self.take("OR"):
            out = bounded(out + self.all_of(column))
        return out

    def all_of(self, column: str | None) -> list:
        out = self.without(column)
        while self.take("AND"):
            out = both(out, self.without(column))
        return out

    def without(self, column: str | None) -> list:
        out = self.row(column)
        while self.take("NOT"):
            no: list = [(frozenset(), frozenset())]
            for want, unwanted in self.row(column):  # none of its conjunctions may hold
                no = both(no, [(frozenset(), frozenset([k])) for k in want] + [(frozenset([k]), frozenset()) for k in unwanted])
            out = both(out, no)
        return out

    def row(self, column: str | None) -> list:
        out = self.one(column)
        while self.at < len(self.parts) and not self.peek("OR", "AND", "NOT", ")"):
            out = both(out, self.one(column))
        return out

    def one(self, column: str | None) -> list:
        if self.peek(*COLUMNS) and self.peek(":", ahead=1):
            column, self.at = self.parts[self.at][1], self.at + 2
        elif self.peek("-") and self.peek(*COLUMNS, ahead=1) and self.peek(":", ahead=2):
            column, self.at = COLUMNS[1 - COLUMNS.index(self.parts[self.at + 1][1])], self.at + 3
        if self.take("("):
            out = self.either(column)
            self.need(")")
            return out
        if self.peek("NEAR") and self.peek("(", ahead=1):
            self.at += 2
            phrases, distance = [self.phrase()], DISTANCE
            while not self.peek(",", ")"):
                phrases.append(self.phrase())
            if self.take(","):
                if not (self.at < len(self.parts) and self.parts[self.at][1].isdecimal()):
                    raise Refused("distance")
                distance, self.at = int(self.parts[self.at][1]), self.at + 1
            self.need(")")
            return self.leaf(phrases, distance, column)
        return self.leaf([self.phrase()], 0, column)

    def leaf(self, phrases: list, distance: int, column: str | None) -> list:
        self.leaves.append({"leaf": len(self.leaves), "distance": distance, "column": column, "phrases": [{"words": w, "prefix": p} for w, p in phrases]})
        return [(frozenset([len(self.leaves) - 1]), frozenset())]

    def phrase(self) -> tuple[list[str], bool]:
        words: list[str] = []
        while True:
            if self.at >= len(self.parts) or self.parts[self.at][0] == "mark" or self.peek("AND", "OR", "NOT"):
                raise Refused("phrase")
            words += _WORDS.findall(self.parts[self.at][1].lower())
            self.at += 1
            if not self.take("+"):
                return words, self.take("*")


def bounded(clauses: list) -> list:
    clauses = [c for c in dict.fromkeys(clauses) if not c[0] & c[1]]
    if len(clauses) > CLAUSES:
        raise Refused("too many alternatives")
    return clauses


def both(a: list, b: list) -> list:
    return bounded([(x | z, y | w) for x, y in a for z, w in b])


SCHEMA = "struct<leaves: array<struct<leaf: int, distance: int, column: string, phrases: array<struct<words: array<string>, prefix: boolean>>>>, clauses: array<struct<want: array<int>, unwanted: array<int>>>>"


def read(question: str | None) -> dict | None:
    """Leaves and conjunctions of a question; None for one that does not follow the syntax."""
    try:
        reader = Reader(question or "")
        clauses = reader.question()
    except Refused:
        return None
    return {"leaves": reader.leaves, "clauses": [{"want": sorted(a), "unwanted": sorted(b)} for a, b in clauses]}

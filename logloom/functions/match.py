"""Full-text conditions on an array column of tokens, and search expressions as such conditions.

Every condition is a native Column, so that it joins the other filters of a scan. An expression is words, "phrases",
prefix*, ^first, NEAR(a b, n), AND, OR, NOT and parentheses; words side by side are all required.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.tokens import tokenize
from logloom.schema import InvalidInput, QueryFailed

MAX_BYTES, MAX_TERMS = 512, 16


@dataclass(frozen=True)
class Phrase:
    """Consecutive stems; prefix: the last is the beginning of a stem; first: at the first token."""

    stems: tuple[str, ...]
    prefix: bool = False
    first: bool = False


def _stands_at(tokens: Column, at: Column, phrase: Phrase) -> Column:
    last = len(phrase.stems) - 1
    token = lambda k: F.get(tokens, (at + k).cast("int"))
    fits = [F.startswith(token(k), F.lit(s)) if k == last and phrase.prefix else token(k) == s for k, s in enumerate(phrase.stems)]
    return F.coalesce(reduce(and_, fits), F.lit(False))


def _places(tokens: Column, phrase: Phrase) -> Column:
    n = F.size(tokens) - len(phrase.stems)
    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), n), lambda i: _stands_at(tokens, i, phrase))).otherwise(F.array().cast("array<int>"))


def has_phrase(tokens: Column, phrase: Phrase) -> Column:
    """True where the phrase stands; an empty phrase stands nowhere."""
    if not phrase.stems:
        return F.lit(False)
    if phrase.first:
        return _stands_at(tokens, F.lit(0), phrase)
    if len(phrase.stems) == 1:
        return F.exists(tokens, lambda t: F.startswith(t, F.lit(phrase.stems[0]))) if phrase.prefix else F.array_contains(tokens, phrase.stems[0])
    n = F.size(tokens) - len(phrase.stems)
    return F.when(n >= 0, F.exists(F.sequence(F.lit(0), n), lambda i: _stands_at(tokens, i, phrase))).otherwise(F.lit(False))


def near(tokens: Column, phrases: list[Phrase], distance: int = 10) -> Column:
    """True where all phrases stand with at most `distance` tokens between the end of each and the start of the last."""
    phrases = [p for p in phrases if p.stems]
    if len(phrases) < 2:
        return has_phrase(tokens, phrases[0]) if phrases else F.lit(False)
    places = [_places(tokens, p) for p in phrases]

    def clump(last: Column) -> Column:
        return reduce(and_, (_within(at, last, len(p.stems) + distance) for at, p in zip(places, phrases)))

    return reduce(or_, (F.exists(at, clump) for at in places))


def _within(places: Column, last: Column, reach: int) -> Column:
    return F.exists(places, lambda i: (i <= last) & (i >= last - reach))


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w\x1a]+)|([(){}:,+*^-]))', re.UNICODE)


def _lex(text: str) -> list[tuple[str, str]]:
    """Pairs of kind (string, word or the sign itself) and value."""
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryFailed("Search query failed")
        quoted, word, sign = m.groups()
        out.append(("string", quoted[1:-1].replace('""', '"')) if quoted is not None else ("word", word) if word else (sign, sign))
        at = m.end()
    return out


#: A stem that a row must have, True if it is the beginning of one.
Stem = tuple[str, bool]
#: Alternatives kept when conditions are joined; beyond them one side's alone are needed, which is also true.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Found:
    """A condition, and what a row that meets it must have: all stems of one of the alternatives. No alternative: no row meets it."""

    column: Column
    needs: tuple[frozenset[Stem], ...]

    def __and__(self, other: Found) -> Found:
        both = tuple(dict.fromkeys(a | b for a in self.needs for b in other.needs))
        return Found(self.column & other.column, both if len(both) <= MOST_ALTERNATIVES else min(self.needs, other.needs, key=len))

    def __or__(self, other: Found) -> Found:
        return Found(self.column | other.column, tuple(dict.fromkeys(self.needs + other.needs)))

    def but_not(self, other: Found) -> Found:
        return Found(self.column & ~other.column, self.needs)


NOWHERE = ()


def _nothing() -> Found:
    return Found(F.lit(False), NOWHERE)


def _all_of(column: Column, phrases: list[Phrase]) -> Found:
    stems = frozenset((s, p.prefix and k == len(p.stems) - 1) for p in phrases for k, s in enumerate(p.stems))
    return Found(column, (stems,) if stems else NOWHERE)


class _Expression:
    """Reads one expression into a condition. OR binds least, then AND, NOT, and words side by side."""

    def __init__(self, text: str, tokens: Column):
        self.items, self.at, self.tokens = _lex(text), 0, tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str) -> str:
        if self.peek()[0] != kind:
            raise QueryFailed("Search query failed")
        self.at += 1
        return self.items[self.at - 1][1]

    def operator(self, name: str) -> bool:
        if self.peek() == ("word", name):
            self.at += 1
            return True
        return False

    def any_of(self) -> Found:
        out = self.all_of()
        while self.operator("OR"):
            out = _both(out, self.all_of(), or_)
        return out

    def all_of(self) -> Found:
        out = self.but_not()
        while self.operator("AND"):
            out = _both(out, self.but_not(), and_)
        return out

    def but_not(self) -> Found:
        out = self.part()
        while self.operator("NOT"):
            more = self.part()
            out = out if out is None or more is None else out.but_not(more)
        return out

    def part(self) -> Found:
        negated = self.columns()
        if self.peek()[0] == "(":
            self.take("(")
            out = self.any_of()
            self.take(")")
            return _nothing() if negated else out
        out = self.group(negated)
        while self.starts_group():
            out = _both(out, self.group(self.columns()), and_)
        return out

    def starts_group(self) -> bool:
        kind, value = self.peek()
        return kind in ("string", "^", "{", "-") or kind == "word" and value not in ("AND", "OR", "NOT")

    def columns(self) -> bool:
        """Reads a column filter, if there is one; message is the only column. True if the filter is negated."""
        negated = self.peek()[0] == "-"
        if negated:
            self.take("-")
        if self.peek()[0] == "{":
            self.take("{")
            names = []
            while self.peek()[0] in ("word", "string"):
                names.append(self.take(self.peek()[0]))
            self.take("}")
        elif self.peek()[0] in ("word", "string") and self.peek(1)[0] == ":":
            names = [self.take(self.peek()[0])]
        elif negated:
            raise QueryFailed("Search query failed")
        else:
            return False
        self.take(":")
        if not names or any(n.lower() != "message" for n in names):
            raise QueryFailed("Search query failed")
        return negated

    def group(self, negated: bool) -> Found:
        if self.peek() == ("word", "NEAR") and self.peek(1)[0] == "(":
            self.take("word"), self.take("(")
            phrases, distance = [self.phrase()], 10
            while self.peek()[0] in ("string", "word"):
                phrases.append(self.phrase())
            if self.peek()[0] == ",":
                self.take(",")
                number = self.take("word")
                if not number.isascii() or not number.isdigit():
                    raise QueryFailed("Search query failed")
                distance = int(number)
            self.take(")")
            return _nothing() if negated else _all_of(near(self.tokens, phrases, distance), phrases)
        first = self.peek()[0] == "^"
        if first:
            self.take("^")
        phrase = self.phrase(first)
        return _nothing() if negated else _all_of(has_phrase(self.tokens, phrase), [phrase]) if phrase.stems else None

    def phrase(self, first: bool = False) -> Phrase:
        stems, prefix = [], False
        while True:
            kind, value = self.peek()
            if kind not in ("string", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QueryFailed("Search query failed")
            self.at += 1
            stems += tokenize(value)
            prefix = self.peek()[0] == "*"
            if prefix:
                self.at += 1
            if self.peek()[0] != "+":
                return Phrase(tuple(stems), prefix and bool(stems), first)
            self.at += 1


def _both(a: Found | None, b: Found | None, join) -> Found | None:
    """a and b joined; an empty phrase (None) leaves the other."""
    return b if a is None else a if b is None else join(a, b)


def search(tokens: Column, query: str) -> Found:
    """The condition of a search expression; InvalidInput if it is too long, QueryFailed if it can't be read."""
    if len(query.encode()) > MAX_BYTES:
        raise InvalidInput(f"query is longer than {MAX_BYTES} bytes")
    if len(query.split()) > MAX_TERMS:
        raise InvalidInput(f"query has more than {MAX_TERMS} terms")
    expression = _Expression(query, tokens)
    out = expression.any_of()
    expression.take("end") if expression.at < len(expression.items) else None
    return _nothing() if out is None else out


def matches(tokens: Column, query: str) -> Column:
    return search(tokens, query).column

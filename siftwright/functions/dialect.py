"""Patterns and predicates that mean the same in Java's and RE2's regular expressions.

Line rules were defined on ECMAScript strings: ``\\s`` takes no-break and other Unicode spaces, ``\\b`` is about ASCII
word characters, ``$`` is the very end. ``js`` rewrites a pattern so that Catalyst's engine agrees; ``re2`` does the same
for engines without look-around. ``Pred`` keeps one predicate in both forms, so a rule is stated once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ECMAScript beyond ``\\s``; fixed values.
WS = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_OPENS = re.compile(r"[A-Za-z(]|\\[wd]|\[a-zA-Z")


def _rewrite(pattern: str, edge: str | None) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "s":
                out.append(WS if inside else f"[{WS}]")
            elif n == "b" and not inside:  # an edge before a word or after one, told by what follows
                out.append(edge or (_BEFORE if _OPENS.match(pattern, i + 2) else _AFTER))
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "$" and not inside:
            c = r"\z"
        elif c == "'":
            c = r"\x27"
        out.append(c)
        i += 1
    return "".join(out)


def js(pattern: str) -> str:
    """For Catalyst."""
    return _rewrite(pattern, None)


def re2(pattern: str) -> str:
    """For engines without look-around and possessive repeats (which only bound the work)."""
    return _rewrite(pattern, r"\b").replace("*+", "*").replace("++", "+")


@dataclass(frozen=True)
class Pred:
    """One predicate as a Column (built when a session is there) and as SQL text."""

    build: Callable[[], Column]
    sql: str

    @property
    def column(self) -> Column:
        return self.build()

    def __and__(self, other: Pred) -> Pred:
        return Pred(lambda: self.build() & other.build(), f"({self.sql} AND {other.sql})")

    def __or__(self, other: Pred) -> Pred:
        return Pred(lambda: self.build() | other.build(), f"({self.sql} OR {other.sql})")

    def __invert__(self) -> Pred:
        return Pred(lambda: ~self.build(), f"(NOT {self.sql})")


def has(pattern: str, col: str = "line", ignore_case: bool = False) -> Pred:
    flag = "(?i)" if ignore_case else ""
    return Pred(lambda: F.col(col).rlike(flag + js(pattern)), f"regexp_matches({col}, '{flag}{re2(pattern)}')")


def at_least(pattern: str, n: int, col: str = "line") -> Pred:
    """The pattern matches ``n`` times or more, one after the other."""
    return Pred(lambda: F.regexp_count(F.col(col), F.lit(js(pattern))) >= n, f"len(regexp_extract_all({col}, '{re2(pattern)}')) >= {n}")


def many(char: str, n: int, col: str = "line") -> Pred:
    """``char`` occurs ``n`` times or more; a cheap test to put before a pattern that needs as many."""
    return Pred(lambda: F.length(col) - F.length(F.replace(F.col(col), F.lit(char), F.lit(""))) >= n, f"length({col}) - length(replace({col}, '{char}', '')) >= {n}")


def truth(name: str) -> Pred:
    """A Boolean column."""
    return Pred(lambda: F.col(name), name)


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def sql_trim(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def js_round(col: Column, places: int = 0) -> Column:
    """Half up on the binary value."""
    k = 10**places
    return F.floor(col * k + 0.5) / k if places else F.floor(col + 0.5)

"""The text of a search box as a condition.

Words, ``"phrases"``, ``AND`` / ``&&``, ``OR`` / ``||``, ``NOT`` / ``!`` / ``-``, ``+``,
parentheses and ``field:`` before any of them. Clauses side by side are
optional (``default="and"``: required); ``AND`` requires the clauses on both
sides; ``+`` requires and ``NOT`` forbids the next one. A list matches when all
required clauses match, none of the forbidden ones, and, if nothing is
required, one of the optional ones; a list of forbidden clauses alone matches
all else. Words are analysed like the documents: one that falls into several
tokens means any of them, one without a letter or digit is dropped. A field
that is not searchable matches nothing. Open quotes and parentheses end with the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

_TOKENS = re.compile(r'"(?P<phrase>[^"]*)"?|(?P<sign>[()]|&&|\|\||[+!-](?=[^\s]))|(?P<field>\w+):(?=[^\s])|(?P<word>[^\s()":]+)|:')


@dataclass(frozen=True)
class Words:
    """One token, or several in a row; in one field or in any."""
    terms: tuple[str, ...]
    field: str | None = None


@dataclass(frozen=True)
class Clauses:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()

    @property
    def empty(self) -> bool:
        return not (self.must or self.should or self.must_not)


def analysed(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def parse(q: str, default: str = "or") -> Clauses:
    tokens = [(m.lastgroup, m.group(m.lastgroup)) for m in _TOKENS.finditer(q) if m.lastgroup]
    return _list(tokens, 0, None, default)[0]


def _list(tokens, at: int, field: str | None, default: str):
    """The clauses from ``at`` to the closing parenthesis, and where they end."""
    found: list[list] = []  # [clause, kind]
    both, either, mark, own = False, False, None, field
    while at < len(tokens):
        kind, text = tokens[at]
        at += 1
        if kind == "field":
            own = text
            continue
        if (kind, text) == ("sign", ")"):
            break
        if (kind, text) in (("word", "AND"), ("sign", "&&")):
            both = True
            continue
        if (kind, text) in (("word", "OR"), ("sign", "||")):
            either = True
            continue
        if (kind, text) in (("word", "NOT"), ("sign", "!"), ("sign", "-")):
            mark = "must_not"
            continue
        if (kind, text) == ("sign", "+"):
            mark = "must"
            continue
        if kind == "sign":  # an opening parenthesis
            clause, at = _list(tokens, at, own, default)
        else:
            terms = analysed(text)
            clause = (Words(tuple(terms), own) if kind == "phrase" or len(terms) == 1 else Clauses(should=tuple(Words((t,), own) for t in terms))) if terms else Clauses()
        if not (isinstance(clause, Clauses) and clause.empty):
            if both and found and found[-1][1] != "must_not":
                found[-1][1] = "must"
            if either and default == "and" and found and found[-1][1] == "must" and not both:
                found[-1][1] = "should"
            found.append([clause, mark or ("must" if both or default == "and" and not either else "should")])
        both, either, mark, own = False, False, None, field
    parts = {k: tuple(c for c, kind in found if kind == k) for k in ("must", "should", "must_not")}
    return Clauses(**parts), at


def leaves(node, positive: bool = False) -> Iterator[Words]:
    """The words and phrases of a query; ``positive``: without forbidden ones."""
    if isinstance(node, Words):
        yield node
        return
    for c in node.must + node.should + (() if positive else node.must_not):
        yield from leaves(c, positive)


def terms_of(node, positive: bool = False) -> list[str]:
    return list(dict.fromkeys(t for w in leaves(node, positive) for t in w.terms))


def condition(node, leaf: Callable[[Words], Column]) -> Column:
    """The query as one Column, ``leaf`` tells where a word or phrase occurs."""
    if isinstance(node, Words):
        return leaf(node)
    every = [condition(c, leaf) for c in node.must] + [~condition(c, leaf) for c in node.must_not]
    if node.should and not node.must:
        every.append(reduce(Column.__or__, [condition(c, leaf) for c in node.should]))
    return reduce(Column.__and__, every) if every else F.lit(True)


def matches_nothing_found(node) -> bool:
    """Whether a document without any of the query's words matches."""
    if isinstance(node, Words):
        return False
    return (all(matches_nothing_found(c) for c in node.must) and not any(matches_nothing_found(c) for c in node.must_not)
            and (bool(node.must) or not node.should or any(matches_nothing_found(c) for c in node.should)))

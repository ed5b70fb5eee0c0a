"""The query language: words, "phrases" and !exclusions, all of which must hold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """Terms that a line's text must and must not contain, in any case."""

    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()

    def to_column(self, text: Column | str = "search_text", legacy: bool = False) -> Column:
        """The condition on a lower-cased text. ``legacy`` gives an older reading, in which
        exclusions count only where there is no other term."""
        col = F.col(text) if isinstance(text, str) else text
        terms = [F.contains(col, F.lit(t.lower())) for t in self.must]
        if not (legacy and self.must):
            terms += [~F.contains(col, F.lit(t.lower())) for t in self.must_not]
        return reduce(Column.__and__, terms, F.lit(True))


def parse(raw: str) -> Query:
    """The query that a text stands for.

    Terms are parted by spaces. Outside a phrase, ``!`` before a term excludes it. A term
    that begins with a quote opens a phrase, which the next term that ends with one
    closes; within, any number of spaces counts as one, and ``!`` means itself. A phrase
    that isn't closed, or holds nothing, is left out. Quotes inside a term mean themselves.
    """
    must: list[str] = []
    must_not: list[str] = []
    phrase: list[str] | None = None
    for term in filter(None, (t.strip() for t in raw.split(" "))):
        opens = phrase is None and term[0] == '"'
        if phrase is None and not opens:
            if term[0] == "!" and len(term) > 1:
                must_not.append(term[1:])
            else:
                must.append(term)
            continue
        phrase = [term[1:]] if opens else [*phrase, term]
        if term[-1] == '"' and (len(term) > 1 or not opens):
            must.append(" ".join(phrase).removesuffix('"'))
            phrase = None
    return Query(tuple(t for t in must if t.strip()), tuple(t for t in must_not if t.strip()))

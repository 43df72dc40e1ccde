"""Splitting of fields that pack several values, by a parsing expression grammar.

The grammar, in its ordered alternatives (the first that matches wins; a quote that isn't closed
before a separator or the end fails its alternative, and parsing backtracks to the next one)::

    field  <- bracketed / quoted_field / list          (the first two only for identifier fields)
    list   <- item (separator item)*
    item   <- blank* (quoted / key ':' blank* quoted / bare)? blank*
    quoted <- '"' ('""' / !'"' .)* '"' &end  /  "'" ("''" / !"'" .)* "'" &end
    end    <- blank* (separator / end of field)
    bare   <- (!separator .)*                             (up to the next sign of one, white space off)

Regular expressions with ordered alternation are such grammars where no rule nests, so each rule is
one compiled pattern applied at a position; nothing is scanned twice but what a failed quote covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    """separator: pattern of a separator with the white space around it; sign: what of it can't be missing, to find the next one
    in one pass; keyed: values may be ``key: value``; listed: the whole field may be bracketed or quoted, and quotes are always
    taken off."""

    separator: str
    sign: str
    keyed: bool
    listed: bool


#: ``key: value`` lists. A comma, a single slash between non-blanks and a blank belong to the value.
CHARACTERISTICS = Dialect(r"\s*(?:[;|]|//)\s*|\s*\s/\s\s*|\s*[\t\n\r\f\v\x85\u2028\u2029]\s*", r"[;|\t\n\r\f\v\x85\u2028\u2029]|//|(?<=\s)/(?=\s)", True, False)
#: Lists of identifiers, which hold no blanks or punctuation but the hyphen and the underscore.
IDENTIFIERS = Dialect(r"\s*[;,|/+&]\s*|\s+", r"[;,|/+&\s]", False, True)
#: Brackets that may enclose a whole field.
BRACKETS = {"[": "]", "(": ")", "{": "}"}


class Grammar:
    def __init__(self, dialect: Dialect):
        self.dialect = dialect
        self.separator, self.sign = re.compile(dialect.separator), re.compile(dialect.sign)
        end = rf"(?=(?:{dialect.separator})|\s*\Z)"
        self.quoted = re.compile(rf"""\s*(?:"(?P<double>(?:""|[^"])*)"|'(?P<single>(?:''|[^'])*)'){end}""", re.DOTALL)
        self.key = re.compile(r"""\s*(?P<key>[^:"'\r\n\t;|]+:[^\S\r\n\t]*)""")

    def items(self, text: str) -> Iterator[tuple[int, str, str | None]]:
        """(place from 1, value, error) of each value that isn't empty; error ``unclosed_quote`` if a value starts with a quote that doesn't enclose it."""
        text = self._field(text) if self.dialect.listed else text.strip()
        at, pos = 0, 1
        while at <= len(text):
            value, at, error = self._item(text, at)
            if value:
                yield pos, value, error
            sep = self.separator.match(text, at)
            if not sep or sep.end() == at:
                break
            at, pos = sep.end(), pos + 1

    def _field(self, text: str) -> str:
        """The list inside ``bracketed / quoted_field / list``, each alternative holding a field again."""
        first, last = 0, len(text)
        while True:
            while first < last and text[first].isspace():
                first += 1
            while first < last and text[last - 1].isspace():
                last -= 1
            if last - first < 2:
                break
            a, b = text[first], text[last - 1]
            if BRACKETS.get(a) != b and not (a == b and a in "\"'" and text.find(a, first + 1, last - 1) < 0):
                break
            first, last = first + 1, last - 1
        return text[first:last]

    def _item(self, text: str, at: int) -> tuple[str, int, str | None]:
        if m := self.quoted.match(text, at):
            return self._inside(m).strip(), m.end(), None
        if self.dialect.keyed and (k := self.key.match(text, at)) and (m := self.quoted.match(text, k.end())):
            return (k["key"] + self._inside(m)).strip(), m.end(), None
        m = self.sign.search(text, at)
        value = text[at : m.start() if m else len(text)].rstrip()
        end, value = at + len(value), value.lstrip()
        return value, end, "unclosed_quote" if value[:1] in ('"', "'") else None

    @staticmethod
    def _inside(m: re.Match) -> str:
        return m["double"].replace('""', '"') if m["double"] is not None else m["single"].replace("''", "'")


def split_packed(df: DataFrame, value: Column | str, keep: list[str], dialect: Dialect) -> DataFrame:
    """One row (``keep`` columns, n_values, pos, val, error) for each value of the field ``value``.

    pos counts places from 1, an empty place before or between values counts but gives no row. n_values is the number
    of the field's values. Null, empty and blank fields give no rows; repeated rows give repeated rows; texts of any
    length are parsed whole. Columns outside ``keep`` don't matter; the ``keep`` columns may bear any name but pos, val,
    error and n_values. One pass over the rows, without a shuffle.
    """
    col = F.col(value) if isinstance(value, str) else value
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], col.cast("string").alias("packed")).filter("packed is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(dialect)
        for pdf in batches:
            got = [list(grammar.items(t)) for t in pdf["packed"]]
            n = [len(g) for g in got]
            out = pdf.drop(columns="packed").loc[pdf.index.repeat(n)].reset_index(drop=True)
            flat = [x for g in got for x in g]
            yield out.assign(n_values=[len(g) for g in got for _ in g], pos=[x[0] for x in flat], val=[x[1] for x in flat], error=[x[2] for x in flat])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in src.drop("packed").schema] + ["n_values int", "pos long", "val string", "error string"])
    out = src.mapInPandas(parse, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_values", "pos", "val", "error")

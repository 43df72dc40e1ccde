"""Definitions of abbreviations in running text, as Schwartz and Hearst (2003) define them: the short form's letters stand in
the words beside it in their order, the first one beginning a word, and the expansion is the shortest such stretch. A text is
read once, in time by its length. Plain functions for one text, and frame operators that call them for each text; they hold no
cached functions, which Python workers would look up in the package instead of getting them by value.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[A-Za-z0-9][A-Za-z0-9'/-]*"
BRACKET = re.compile(r"\(([^()]{1,120})\)")
#: Little words that may lead to an expansion without being part of it.
LEADING = {"the", "a", "an", "of", "in", "with", "from", "and", "for", "to"}


def shaped(token: str) -> bool:
    """A short form: a letter and up to nine more characters without a blank, capitals but for one letter at most, two capitals at least."""
    token = token.strip()
    if not re.fullmatch(r"[^\W\d_]\S{1,9}", token):
        return False
    small = sum(c.isalpha() and not c.isupper() for c in token)
    return small <= 1 and sum(c.isupper() for c in token) >= 2


def _letters(short: str) -> list[str]:
    return [c for c in short.lower() if c.isalnum()]


def _most(letters: int) -> int:
    """How many words an expansion of so many letters may have by the paper."""
    return min(letters + 5, 2 * letters + 2)


def spelled(short: str, words: list[str]) -> str | None:
    """The last of ``words`` that spell ``short``, joined; null if none do, or too many. The letters are looked up from the end on, each
    at its last place, so the expansion begins as late as can be."""
    if not (letters := _letters(short)):
        return None
    text = " ".join(words[-_most(len(letters)) :])
    low = text.lower()
    at = len(low)
    for c in reversed(letters[1:]):
        if (at := low.rfind(c, 0, at)) < 0:
            return None
    while (at := low.rfind(letters[0], 0, at)) > 0 and low[at - 1] not in " -/":
        pass
    return text[at:].strip(" -/,;:") or None if at >= 0 else None


def _pairs(text: str) -> Iterator[tuple[str, list[str], str | None]]:
    """(possible short form, words that may spell it, the whole expansion if those do) around every pair of brackets: its head with
    the words before it, and the word before it with those inside. Of the words before it, as many as a short form may have."""
    before, at = deque(maxlen=_most(10)), 0
    for m in BRACKET.finditer(text):
        before.extend(w[0] for w in re.finditer(WORD, text[at : m.start()]))  # no word holds a bracket, so none is cut in two
        at, inner = m.start(), m[1].strip()
        if not before:
            continue
        if head := re.match(rf"({WORD})\s*(?:[;,:–—-]|$)", inner):
            yield head[1], list(before), None
        inside = re.findall(WORD, inner)
        if 0 < len(inside) <= _most(len(_letters(before[-1]))):
            yield before[-1], inside, inner


def _key(short: str) -> str:
    return short.lower().rstrip("s")


def _first(short: str, pairs: list[tuple[list[str], str | None]]) -> str | None:
    """The expansion by the first of a short form's ``pairs`` that spells it."""
    return next((_plain(whole or span) for words, whole in pairs if (span := spelled(short, words))), None)


def _plain(span: str) -> str:
    """Without doubled blanks, marks around it and a leading little word."""
    words = span.strip(" -/,;:.").split()
    return " ".join(words[1:] if len(words) > 1 and words[0].lower() in LEADING else words)


def find_definition(short: str | None, text: str | None) -> str | None:
    """The expansion of ``short`` that ``text`` defines, as ``long form (SHORT)`` or ``SHORT (long form)``; the first one. A plural s doesn't count."""
    if not short or not text or not shaped(short):
        return None
    short = short.strip()
    return _first(short, [(words, whole) for name, words, whole in _pairs(text) if _key(name) == _key(short)])


def harvest_definitions(text: str | None) -> list[tuple[str, str]]:
    """All (short form, expansion) pairs that a text defines, each short form once."""
    names, pairs = {}, defaultdict(list)
    for name, words, whole in _pairs(text or ""):
        if name not in names:
            names[name] = shaped(name)
        pairs[_key(name)].append((words, whole))
    return [(name, span) for name, fits in names.items() if fits and (span := _first(name, pairs[_key(name)]))]


@F.pandas_udf(StringType())
def definition(short: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([find_definition(a, b) for a, b in zip(short, text)], dtype="object")


def definitions(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, short, expansion: a row for each definition in each text."""
    src = df.select(*keep, F.col(text).alias("_text")).filter("_text is not null and _text like '%(%'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, short, expansion = [], [], []
            for i, t in enumerate(batch.column("_text")):
                for name, span in harvest_definitions(t.as_py()):
                    rows.append(i)
                    short.append(name)
                    expansion.append(span)
            kept = batch.drop_columns("_text").take(pa.array(rows, pa.int64()))
            yield kept.append_column("short", pa.array(short, pa.string())).append_column("expansion", pa.array(expansion, pa.string()))

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in src.drop("_text").schema] + ["short string", "expansion string"])
    return src.mapInArrow(run, schema)


def disambiguate(words_of: dict[str, list[str]], text: Column) -> Column:
    """The sense with strictly most distinctive words in ``text``; null on a tie or without any."""
    low = F.lower(text)
    hits = F.array(*[F.struct(sum([F.when(low.contains(w), 1).otherwise(0) for w in ws], F.lit(0)).alias("n"), F.lit(s).alias("s")) for s, ws in words_of.items()])
    ranked = F.reverse(F.array_sort(hits))
    second = F.coalesce(F.try_element_at(ranked, F.lit(2))["n"], F.lit(0))
    return F.when((ranked[0]["n"] > 0) & (ranked[0]["n"] > second), ranked[0]["s"])


def study_summary(title: Column, summary: Column, design: Column, limit: int = 512) -> Column:
    """``Title: ...`` and the summary's sentences, in their order, as long as whole ones fit into ``limit`` characters, then as much of
    the design as there is room for. Null parts count as empty."""
    t, s, d = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, summary, design))
    head = F.when(t != "", F.concat(F.lit("Title: "), t)).otherwise("")
    sentences = F.filter(F.transform(F.split(s, r"(?<=[.!?])\s+"), F.trim), lambda x: x != "")
    # each sentence with the length up to its end; the first that doesn't fit ends the list
    ends = F.aggregate(sentences, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.length(head) + 2) + F.length(x) + 1))
    fit = F.size(F.filter(ends, lambda e: e <= limit))
    used = F.coalesce(F.get(ends, fit - 1), F.length(head) + 2)
    body = F.array_join(F.slice(sentences, 1, fit), " ")
    room = F.lit(limit) - used - 10
    body = F.when((d != "") & (used + 16 < limit), F.concat(body, F.lit(" Design: "), F.substr(d, F.lit(1), room))).otherwise(body)
    out = F.trim(F.concat_ws(". ", F.when(head != "", head), F.when(body != "", body)))
    return F.when(F.length(out) > limit, F.concat(F.rtrim(F.substring(out, 1, limit - 1)), F.lit("…"))).otherwise(out)

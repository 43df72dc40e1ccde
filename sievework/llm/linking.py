"""Mapping of free-typed labels to a reference list by a symmetric-delete dictionary.

Every reference name is reduced to a key (letters and digits only, without accents and case) and filed under all the
strings that deleting up to ``max_edits`` of its characters leaves. A label is reduced the same way, in a few readings
(as typed, without the wording around the name, abbreviations spelled out, inverted names turned); a reading that is a
key is a match, otherwise the keys that share a deletion with it are compared by a weighted Damerau-Levenshtein distance.
The nearest wins, then the one met more often in the reference's own use, then the smaller id. Digits have to agree, and
keys with digits and little else (codes, cell lines) or short ones (acronyms) match exactly or not at all.

What counts as wording, and which abbreviations stand for which class words, is learned from labels that are resolved
already (:func:`learn_wording`): no list is built in. Only amounts with their units, and signs after a marker, are told by
their form.

Lossless: every edit weighs at least 0.8, so a distance of up to 3 means up to 3 edits, and two strings within so many edits
share what up to so many deletions from the first ``PREFIX`` letters of each leave.

Defined results: a null or blank label, one without a group, and one that nothing is near to, is ``unmatched``; repeated
labels get equal answers (each distinct label is looked up once); an empty reference leaves all labels unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.skew import hot_join
from sievework.runtime import cut

UNMATCHED = "unmatched"
#: The least that an edit weighs.
SWAP = 0.8
#: Signs and words that tell a marker's level, after its name of letters and a number.
MARKER = re.compile(r"\b[a-z]{1,4}\d+[a-z]?\s*[+-](?![a-z0-9])|\b[a-z]{1,4}\d+[a-z]?(?:high|low|pos|neg)\b")
#: Amounts and times: number and unit.
AMOUNT = re.compile(r"(?<![a-z0-9])\d+(?:[.,]\d+)?[\s./_-]*(?:mg/kg|ug/kg|mg/ml|ug/ml|ng/ml|mg|ug|ng|kg|ml|ul|um|nm|mm|m|gy|%|h|hr|hrs|hours?|min|d|days?|weeks?|wk)s?\b(?:/(?:kg|ml|day|d))?|\b(?:passage|day|week|p)[\s_-]*\d+\b")


@dataclass
class Wording:
    """words: what may stand around a name without changing it; short: abbreviations with the class words they stand for."""

    words: frozenset[str] = frozenset()
    short: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        long = sorted((w for w in self.words if len(w) > 3), key=lambda w: (-len(w), w))
        some = "|".join(map(re.escape, long))
        small = "|".join(map(re.escape, sorted(w for w in self.words if 1 < len(w) <= 3)))
        # glued to either end of a name; a short word only together with a longer one
        unit = rf"(?:(?:{small})(?=(?:{some})))?(?:{some})" if small else f"(?:{some})"
        self.glued = re.compile(rf"^(?:{unit})+(?=.{{4}}|$)|(?<=.{{4}})(?:{unit})+$") if long else None
        ends = sorted((s for s in self.short if len(s) > 2), key=lambda w: (-len(w), w))
        self.ended = re.compile(rf"(.{{4,}}?)({'|'.join(map(re.escape, ends))})") if ends else None
        by_first: dict[str, list[str]] = {}
        for w in long:
            if len(w) > 4:
                by_first.setdefault(w[0], []).append(w)
        self.near = lru_cache(100_000)(lambda w: len(w) > 4 and any(abs(len(w) - len(x)) < 2 and weighted_distance(w, x, 1) <= 1 for x in by_first.get(w[0], ())))


def fold(text: str) -> str:
    """Lower case, without accents, dashes as hyphens, other marks and white space as they are."""
    text = unicodedata.normalize("NFKD", text.lower().replace("–", "-").replace("—", "-").replace("µ", "u"))
    return "".join(c for c in text if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text)


def key(tokens: Iterable[str]) -> str:
    return "".join(tokens)


def readings(label: str, wording: Wording) -> list[list[str]]:
    """Token lists that the label may stand for, the most literal first."""
    text = fold(label)
    bare = words(AMOUNT.sub(" ", MARKER.sub(" ", re.sub(r"[_\s]+", " ", text))))
    out: list[list[str]] = []

    def add(tokens: list[str]) -> None:
        if tokens and tokens not in out:
            out.append(tokens)

    add(words(text))
    add(bare)
    # an abbreviation with several meanings is read each way, all its places alike
    for n in range(max([1, *(len(wording.short.get(w, ())) for w in bare)])):
        spelled = [m[min(n, len(m) - 1)] if (m := wording.short.get(w)) else w for w in bare]
        add(spelled)
        inner = [w for w in spelled if w not in wording.words]
        add(inner)
        add([w for w in inner if not wording.near(w)])
        if wording.glued:
            inner = [g for w in inner if (g := wording.glued.sub("", w))]
            add(inner)
        if wording.ended:
            for k in range(max([1, *(len(wording.short[m[2]]) for w in inner if (m := wording.ended.fullmatch(w)))])):
                add([m[1] + wording.short[m[2]][min(k, len(wording.short[m[2]]) - 1)] if (m := wording.ended.fullmatch(w)) else w for w in inner])
    return out


def turns(tokens: list[str]) -> list[list[str]]:
    """The tokens, and with the first or the last moved to the other end (inverted names), a type's number staying last."""
    tail = tokens[-2:] if len(tokens) > 2 and tokens[-2] == "type" else []
    head = tokens[: len(tokens) - len(tail)]
    if len(head) < 2:
        return [tokens]
    return [head + tail, head[1:] + head[:1] + tail, head[-1:] + head[:-1] + tail]


#: Deletions are made in the first letters only: two strings within k edits still share a string left by up to k deletions from each prefix.
PREFIX = 8


def deletions(word: str, edits: int) -> set[str]:
    head = word[:PREFIX]
    return {"".join(c for i, c in enumerate(head) if i not in gone) for n in range(min(edits, len(head) - 1) + 1) for gone in combinations(range(len(head)), n)}


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein, where swapping, doubling or undoubling a letter costs 0.8, any other edit 1, a changed first letter 0.5 more. Above ``most``: inf."""
    n, m = len(a), len(b)
    if abs(n - m) > most / SWAP:
        return float("inf")
    far = float(n + m + 1)
    d = [[far] * (m + 2) for _ in range(n + 2)]
    d[1][1] = 0.0
    for i in range(1, n + 1):
        d[i + 1][1] = d[i][1] + (SWAP if i > 1 and a[i - 1] == a[i - 2] else 1.0)
    for j in range(1, m + 1):
        d[1][j + 1] = d[1][j] + (SWAP if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    last_row: dict[str, int] = {}
    for i in range(1, n + 1):
        x, last_col, least = a[i - 1], 0, d[i + 1][1]
        drop = SWAP if i > 1 and x == a[i - 2] else 1.0
        row, above = d[i + 1], d[i]
        for j in range(1, m + 1):
            y = b[j - 1]
            i1, j1 = last_row.get(y, 0), last_col
            cost = 0.0 if x == y else 1.0 + 0.5 * (i == 1 and j == 1)
            if x == y:
                last_col = j
            row[j + 1] = min(above[j] + cost, row[j] + (SWAP if j > 1 and y == b[j - 2] else 1.0), above[j + 1] + drop, d[i1][j1] + (i - i1 - 1) + SWAP + (j - j1 - 1))
            least = min(least, row[j + 1])
        last_row[x] = i
        if least > most + 1:
            return float("inf")
    return d[n + 1][m + 1] if d[n + 1][m + 1] <= most else float("inf")


def allowed(word: str, max_edits: int) -> int:
    """Edits allowed for a key: none for codes and short keys, one up to nine letters, two up to thirteen, then three."""
    letters = sum(c.isalpha() for c in word)
    if letters < 6 or re.search(r"\d{2}", word):
        return 0
    return min(max_edits, 1 if letters < 10 else 2 if letters < 14 else 3)


def _letters(word: str) -> int:
    """A bit for each letter that the word holds."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 31)
    return bits


class Dictionary:
    """The index of some entries (name, group, id, weight), and lookups in it.

    exact: (group, key) -> (-weight, turned, id), the best of all entries with that key. The deletions are a sorted array of
    hashes (a wrong hit only costs a comparison), each with the place of a key in ``near``: 12 bytes a deletion.
    """

    def __init__(self, entries: Iterable[tuple[str, str, str, int]], max_edits: int = 3, wording: Wording | None = None):
        self.max_edits, self.wording = max_edits, wording or Wording()
        self.exact: dict = {}
        told = [(group, words(fold(name)), ref, weight) for name, group, ref, weight in entries if name and group and ref]
        often = Counter(w for _, tokens, _, _ in told for w in set(tokens))
        near: dict[tuple[str, str], None] = {}
        for group, tokens, ref, weight in told:
            for turn in turns(tokens):
                k, rank = (group, key(turn)), (-weight, turn != tokens, ref)
                if k not in self.exact or rank < self.exact[k]:
                    self.exact[k] = rank
            # filed with their class word (a word that ends many names) last
            last = key(min(turns(tokens), key=lambda t: (often[t[0]] if t else 0)) if tokens else tokens)
            if allowed(last, max_edits):
                near[group, last] = None
        self.near = list(near)
        self.letters = [_letters(w) for _, w in self.near]
        pairs = [(_hash(g, d), i) for i, (g, w) in enumerate(self.near) for d in deletions(w, allowed(w, max_edits))]
        hashes = np.fromiter((h for h, _ in pairs), np.uint64, len(pairs))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], np.fromiter((i for _, i in pairs), np.int32, len(pairs))[order]

    def parts(self) -> tuple:
        """What the index is made of, plain values only: a broadcast is read where this package isn't."""
        return self.max_edits, self.wording.words, self.wording.short, self.exact, self.near, self.letters, self.hashes, self.places

    @classmethod
    def of(cls, parts: tuple) -> Dictionary:
        out = cls.__new__(cls)
        out.max_edits, around, short, out.exact, out.near, out.letters, out.hashes, out.places = parts
        out.wording = Wording(around, short)
        return out

    def candidates(self, word: str, group: str, most: int) -> set[int]:
        """Places of the keys of ``group`` that share a deletion with ``word``."""
        at = np.fromiter((_hash(group, d) for d in deletions(word, most)), np.uint64)
        first, end = np.searchsorted(self.hashes, at, "left"), np.searchsorted(self.hashes, at, "right")
        return {int(x) for a, b in zip(first, end) if b > a for x in self.places[a:b]}

    def best(self, label: str | None, group: str | None) -> tuple[float, int, str] | None:
        """(distance, -weight, id) of the nearest entry."""
        if not label or not label.strip() or not group:
            return None
        forms = [f for tokens in readings(label, self.wording) for f in (tokens, *([[*tokens[:-1], tokens[-1][:-1]]] if tokens[-1].endswith("s") and len(tokens[-1]) > 2 else []))]
        keys = list(dict.fromkeys(key(turn) for form in forms for turn in turns(form)))
        keys += [k[:-1] for k in keys if k.endswith("s") and len(k) > 3 and k[:-1] not in keys]
        for word in keys:
            if hit := self.exact.get((group, word)):
                return 0.0, hit[0], hit[2]
        found = None
        for word in keys:
            most = allowed(word, self.max_edits)
            if not most:
                continue
            digits, letters = re.findall(r"\d+", word), _letters(word)
            for i in self.candidates(word, group, most):
                g, near = self.near[i]
                if g != group or abs(len(near) - len(word)) > most or (letters ^ self.letters[i]).bit_count() > 2 * most or re.findall(r"\d+", near) != digits:
                    continue
                dist = weighted_distance(word, near, min(most, allowed(near, self.max_edits)))
                hit = self.exact[group, near]
                if dist != float("inf") and (found is None or (dist, hit[0], hit[2]) < found):
                    found = (dist, hit[0], hit[2])
        return found


def _hash(group: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{group}\x00{text}")


def _apart(label: str, names: Iterable[str]) -> tuple[list[str], list[str]] | None:
    """(tokens of the label that the nearest name hasn't, tokens of that name that the label hasn't)."""
    tokens, best = words(fold(label)), None
    for name in names:
        n = Counter(words(fold(name)))
        over, miss = list((Counter(tokens) - n).elements()), list((n - Counter(tokens)).elements())
        if n and (best is None or (len(miss), len(over)) < (len(best[1]), len(best[0]))):
            best = (over, miss)
    return best


def learn_wording(resolved: DataFrame, reference: DataFrame, *, least: int = 3, one_in: int = 50_000, class_names: int = 10) -> Wording:
    """Wording and abbreviations that the labels of ``resolved`` (label, grp, ref_id) show against their entries of ``reference``.

    Wording is a word of letters that no reference name holds and that stands beside a whole name in ``least`` distinct labels at
    least (and in one of ``one_in``, so the list is bounded however many labels there are). An abbreviation stands for a word
    of ``class_names`` names at least, as the only word that differs, in as many labels and in more than there are names that
    hold it. All resolved labels count.
    """
    names = reference.filter("name is not null").groupBy("grp", F.upper("ref_id").alias("ref")).agg(F.collect_set("name").alias("names"))
    labels = resolved.filter("label is not null").select("label", "grp", F.upper("ref_id").alias("ref")).distinct().join(names, ["grp", "ref"])

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [x for lab, of in zip(pdf["label"], pdf["names"]) if (x := _apart(lab, of))]
            yield pd.DataFrame({"over": [sorted(set(o)) for o, _ in got], "miss": [m for _, m in got]})

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([w for n in pdf["name"] for w in set(words(fold(n)))], columns=["word"])

    apart = cut(labels.mapInPandas(differ, "over array<string>, miss array<string>"))
    known = cut(reference.filter("name is not null").select("name").distinct().mapInPandas(tokens, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("names")))
    least = max(least, apart.count() // one_in)
    extra = apart.filter("size(miss) = 0").select(F.explode("over").alias("word")).filter(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    around = frozenset(r[0] for r in extra.join(known, "word", "left_anti").select("word").collect())
    over = F.filter("over", lambda w: ~w.isin(list(around))) if around else F.col("over")
    pairs = apart.filter("size(miss) = 1").select(over.alias("over"), F.col("miss")[0].alias("word")).filter("size(over) = 1").select(F.col("over")[0].alias("short"), "word")
    pairs = pairs.filter(F.col("short").rlike("^[a-z]+$")).groupBy("short", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    pairs = pairs.join(known.filter(F.col("names") >= class_names).select("word"), "word").join(known.select(F.col("word").alias("short"), "names"), "short", "left")
    pairs = pairs.filter(F.col("n") > F.coalesce("names", F.lit(0)))
    short: dict[str, list] = {}
    for r in pairs.collect():
        short.setdefault(r["short"], []).append((-r["n"], r["word"]))
    return Wording(around, {k: tuple(w for _, w in sorted(v)) for k, v in short.items()})


def link_labels(df: DataFrame, reference: DataFrame, *, label: str, group: str, keep: list[str], wording: Wording | None = None, max_edits: int = 3, max_entries: int = 50_000) -> DataFrame:
    """``keep`` columns, ref_id and distance for each row of ``df``: the reference entry that ``label`` means within ``group``, or ``unmatched`` (distance null).

    reference: (name, grp, ref_id, weight). Each distinct label is looked up once. The reference is worked through in blocks of
    about ``max_entries`` names: a block's index is broadcast, all labels are looked up in it, and it is given up before the next
    one comes, so the driver and each worker hold one block; the best of the blocks' answers stands.
    """
    spark = df.sparkSession
    names = reference.select(F.col("name").cast("string"), F.col("grp").cast("string"), F.col("ref_id").cast("string"), F.col("weight").cast("long")).filter("name is not null and grp is not null and ref_id is not null").distinct()
    blocks = max(1, -(-names.count() // max_entries))
    names = cut(names.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks))))
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(label).cast("string").alias("label"), F.col(group).cast("string").alias("grp"))
    whole = F.col("label").isNotNull() & F.col("grp").isNotNull()
    each = rows.filter(whole).groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n"))
    each = cut(each.withColumns({"ref_id": F.lit(None).cast("string"), "distance": F.lit(None).cast("double"), "rank": F.lit(None).cast("long")}))
    sizes = each.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).first()
    total, parts = sizes["rows"] or 0, max(spark.sparkContext.defaultParallelism, -(-sizes["labels"] // 20_000))  # small rows, dear to look up
    for b in range(blocks):
        index = spark.sparkContext.broadcast(Dictionary((tuple(r) for r in names.filter(F.col("block") == b).drop("block").toLocalIterator()), max_edits, wording).parts())
        each = cut(_look_up(each.repartition(parts, "label"), index))
        index.destroy()
    out = hot_join(rows.filter(whole), each.select("label", "grp", "n", "ref_id", "distance"), ["label", "grp"], "n", total)
    out = out.unionByName(rows.filter(~whole).withColumns({"ref_id": F.lit(None).cast("string"), "distance": F.lit(None).cast("double")}))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.coalesce("ref_id", F.lit(UNMATCHED)).alias("ref_id"), "distance")


def _look_up(each: DataFrame, index) -> DataFrame:
    """Answers of one block, merged with those of the blocks before."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = Dictionary.of(index.value)
        for pdf in batches:
            out = []
            for lab, grp, ref, dist, rank in zip(pdf["label"], pdf["grp"], pdf["ref_id"], pdf["distance"], pdf["rank"]):
                new, old = dictionary.best(lab, grp), (dist, rank, ref) if isinstance(ref, str) else None
                out.append(min((x for x in (new, old) if x), default=(None, None, None)))
            yield pdf.assign(ref_id=[x[2] for x in out], distance=pd.Series([x[0] for x in out], index=pdf.index, dtype="float64"), rank=pd.Series([x[1] for x in out], index=pdf.index, dtype="Int64"))

    return each.mapInPandas(look, each.schema)

"""Pages of keywords, links or product tags instead of sentences.

Texts are cut into blocks. Each block is compressed after its page's other blocks (the ``around`` before and after it, as a
preset dictionary), so that a page which says the same few words over and over shows as redundant however its blocks look
alone. The ratio of compressed to raw bytes is set against the usual one (medians over all pages of the corpus) of blocks of the
same length, of pages of about as many blocks, and of the same language. A redundant block is confirmed by the density of
sentence punctuation: a mark counts if it closes words that begin with a capital, and for extremely redundant blocks, which
may be strewn with marks, only if it closes as many words as sentences have. Nothing else is asked of the words: there are no
word lists. A page is spam if most of its text lies in confirmed blocks.

Cited sources (an address in brackets) and addresses are no words of a sentence. Lines that lead by dots to a page number
are a printed table of contents, which has no sentences either, and don't count.

Defined results: null, empty and blank texts and those without any word are never spam; repeated rows are judged alike; texts
of any length are read whole; an unknown language, or one with fewer than ``least`` such blocks, is measured against all
languages' blocks, and rare lengths and pages against all of that length, or against all blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.runtime import cut

WORD = re.compile(r"[^\W\d_]+")
#: A mark ends a sentence only before a blank, a closing bracket or quote, or the end; not within numbers and addresses.
END = re.compile(r"[.!?…]+[\"'”»)\]]*(?=\s|$)")
ADDRESS = re.compile(r"\([^()]*//[^()]*\)|(?:https?:)?//\S+|www\.\S+")
CONTENTS = re.compile(r"(?m)^[^\n]*?([.… ])\1{3,} ?\d+[ \t]*$")
LEADERS = re.compile(r"([^\w\s])\1{2,}")
GAP = re.compile(r"\s")
#: Words that a mark closes: few do for any sentence, more for one of an extremely redundant block.
SHORT_SENTENCE, SENTENCE = 3, 7


def blocks(text: str, size: int) -> Iterator[str]:
    """Pieces of about ``size`` characters: lines gathered up to it, where a line of over a third of it stands for itself; a longer line is cut at white space, within a word only if that is longer than a block. A short end joins the piece before."""
    held = ""
    for line in text.splitlines(keepends=True):
        if held and (len(held) >= size or len(line) > size // 3):
            yield held
            held = ""
        held += line
        while len(held) > size * 3 // 2:
            m = GAP.search(held, size, size * 2)
            end = m.end() if m else size
            yield held[:end]
            held = held[end:]
    if held.strip():
        yield held


def sentences(block: str) -> tuple[int, int, int]:
    """(words, marks that close a short sentence at least, marks that close a sentence)."""
    block = ADDRESS.sub(" ", block)
    short = full = at = 0
    for m in END.finditer(block):
        w = WORD.findall(block[at : m.start()])
        at = m.end()
        if w and w[0][0].isupper():
            short, full = short + (len(w) >= SHORT_SENTENCE), full + (len(w) >= SENTENCE)
    return len(WORD.findall(block)), short, full


def measure(text: str, size: int, around: int) -> Iterator[tuple]:
    """(blocks of the page, characters, bytes, compressed bytes, share in contents lines, words, short sentences, sentences) of each block."""
    parts = list(blocks(text, size))
    raw = [LEADERS.sub(r"\1", b).encode("utf-8", "replace") for b in parts]
    for i, (block, r) in enumerate(zip(parts, raw)):
        near = b"".join(raw[max(0, i - around) : i] + raw[i + 1 : i + 1 + around])[-32_000:]
        c = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, near) if near else zlib.compressobj(9, zlib.DEFLATED, -15, 9)
        packed = len(c.compress(r)) + len(c.flush())
        yield len(parts), len(block), len(r), packed, sum(len(m[0]) for m in CONTENTS.finditer(block)) / len(block), *sentences(block)


def language(col: Column) -> Column:
    """Two-letter code of a language in the usual spellings; null if none."""
    code = F.substring(F.lower(F.trim(col)), 1, 2)
    return F.when(code == "ge", "de").when(code != "", code)


def block_features(df: DataFrame, *, id_col: str, text: str, lang: str, size: int = 400, around: int = 20) -> DataFrame:
    """(doc, lang, blocks, chars, n_bytes, packed, contents, words, short_ends, ends) of every block of every text that isn't blank."""
    rows = df.select(F.col(id_col).alias("doc"), F.col(text).alias("text"), language(F.col(lang)).alias("lang")).filter("text is not null and text rlike '\\\\S'")
    names = ["doc", "lang", "blocks", "chars", "n_bytes", "packed", "contents", "words", "short_ends", "ends"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(d, g, *m) for d, t, g in zip(pdf["doc"], pdf["text"], pdf["lang"]) for m in measure(t.strip(), size, around)], columns=names)

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"doc {kind}, lang string, blocks int, chars int, n_bytes int, packed int, contents double, words int, short_ends int, ends int")


def spam_pages(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", size: int = 400, redundant: float = 0.93, sentence_words: float = 80.0, extreme: float = 0.56, sentence_words_extreme: float = 40.0, most: float = 0.5, least: int = 30) -> DataFrame:
    """(id_col, spam_share, redundancy, sentence_density, is_spam) of every text that isn't blank.

    A block is redundant below ``redundant`` of the usual ratio, and confirmed if it has fewer than one mark that closes a short
    sentence in ``sentence_words`` words; below ``extreme`` of it, if it has fewer than one that closes a whole sentence in
    ``sentence_words_extreme`` words.
    """
    feats = block_features(df, id_col=id_col, text=text, lang=lang, size=size)
    # lengths in steps of a fifth; numbers of blocks in powers of two, single blocks apart
    step = F.round(4 * F.log2(F.greatest("n_bytes", F.lit(1)).cast("double"))).cast("int")
    page = F.when(F.col("blocks") == 1, -1).otherwise(F.least(F.round(F.log2(F.col("blocks").cast("double"))), F.lit(5.0)).cast("int"))
    feats = cut(feats.withColumns({"step": step, "page": page, "ratio": F.col("packed") / F.greatest("n_bytes", F.lit(1))}))
    # the nearest level that has enough blocks; each is a small table of languages (two letters) and steps
    each = feats.groupBy("doc", "lang", "step", "page").agg(F.avg("ratio").alias("ratio"))  # a page has one vote, however long
    rows, levels = feats, [["lang", "step", "page"], ["step", "page"], ["step"]]
    for i, keys in enumerate(levels):
        usual = each.filter("lang is not null" if i == 0 else "true").groupBy(*keys).agg(F.percentile_approx("ratio", 0.5, 1000).alias(f"usual{i}"), F.count(F.lit(1)).alias("n"))
        rows = rows.join(F.broadcast(usual.filter(F.col("n") >= least).drop("n")), keys, "left")
    rows = rows.crossJoin(F.broadcast(each.agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual3"))))
    z = F.col("ratio") / F.coalesce(*[f"usual{i}" for i in range(4)])
    words = F.col("words") + 1
    hit = (((z < redundant) & (F.col("short_ends") * sentence_words < words)) | ((z < extreme) & (F.col("ends") * sentence_words_extreme < words))) & (F.col("contents") < 0.5)
    per = rows.groupBy("doc").agg(
        (F.sum(F.when(hit, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("spam_share"),
        (F.sum(z * F.col("chars")) / F.sum("chars")).alias("redundancy"),
        (F.sum("short_ends") / F.greatest(F.sum("words"), F.lit(1))).alias("sentence_density"),
    )
    return per.select(F.col("doc").alias(id_col), "spam_share", "redundancy", "sentence_density", (F.col("spam_share") > most).alias("is_spam"))

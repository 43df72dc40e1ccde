"""Missing-value vocabularies. They differ by stage and must not be merged; each is a predicate on lower(trim(x))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = "Not Specified"

# The members of each vocabulary.
NS_EXTRACT = ["", "not specified", "none", "null", "n/a", "na"]
NS_DRIVER = ["", "not specified", "n/a", "na", "none", "null", "unknown"]
NS_CONTEXT = ["", "not specified", "n/a", "none", "unknown", "na", "not available", "not applicable", "unclear", "unspecified", "missing", "undetermined", "insufficient", "insufficient information", "no information", "no data"]
NS_CACHE = ["", "not specified", "none", "n/a", "na"]
NULLISH_KV = ["", "na", "n/a", "none", "null", "unknown", "not collected", "not reported", "not available", "-", "--", "."]
JUNK_EXACT = ["", "-", "--", "na", "n a", "nan", "none", "null", "unknown", "unk", "tbd", "not applicable", "not specified", "not available", "not determined", "missing", "blank", "other", "others", "misc", "undetermined", "?", "."]
NS_FOLD = ["", "not specified", "na", "n/a", "none", "unknown", "not applicable", "unspecified"]
MISSING_FINAL = [
    "", "not specified", "na", "n/a", "n.a.", "none", "null", "unknown", "unspecified", "not applicable", "missing", "nd", "n.d.", "--", "-", "---", "?", "??", "not available", "not collected", "not reported",
    "not determined", "not known", "not given", "unkown", "no", "-.-", ".",
]
NS_SEX = ["", "not specified", "unknown", "na", "n/a", "none", "-", "?"]

SETS = {
    "extract": NS_EXTRACT, "driver": NS_DRIVER, "context": NS_CONTEXT, "cache": NS_CACHE, "nullish_kv": NULLISH_KV, "junk_exact": JUNK_EXACT, "fold": NS_FOLD, "final": MISSING_FINAL, "sex": NS_SEX,
}


def is_missing(col: Column, vocabulary: str) -> Column:
    """Whether a value is missing by the named vocabulary; null always is."""
    return F.coalesce(F.lower(F.trim(col)), F.lit("")).isin(SETS[vocabulary])


def is_present(col: Column, age: bool = False) -> Column:
    """Present in a final table; for ages a leading ``age:`` doesn't count."""
    text = F.trim(col)
    if age:
        text = F.regexp_replace(text, r"(?i)^\s*age\s*:\s*", "")
    return ~is_missing(text, "final")


def normalize_ns(col: Column) -> Column:
    """Without enclosing quotes; missing ones as the sentinel."""
    v = F.regexp_replace(F.regexp_replace(F.trim(col), r'^"+|"+$', ""), r"^'+|'+$", "")
    return F.when(is_missing(v, "extract"), NS).otherwise(v)

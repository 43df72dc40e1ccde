"""White space and identifier clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any white space, with the no-break, thin and zero-width-free Unicode separators and the ASCII information separators.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def strip(col: Column | str) -> Column:
    """Without surrounding white space of any kind; null stays null."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, f"^{SPACE}+|{SPACE}+$", "")


def plain_space(col: Column | str) -> Column:
    """Without surrounding white space, inner white space other than blanks as tabs, so that an ASCII ``\\s`` finds it."""
    return F.regexp_replace(strip(col), f"[{SPACE}&&[^ ]]", "\t")


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def squash(col: Column) -> Column:
    """Stripped, with runs of white space as one blank."""
    return F.regexp_replace(strip(col), f"{SPACE}+", " ")

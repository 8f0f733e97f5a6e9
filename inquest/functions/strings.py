"""String helpers with the exact white-space and case rules the results need."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from inquest.constants import WHITESPACE

SMALL = 2048              # products of two labels' lengths up to which arrays cost more than they save


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def collapsed(col: Column) -> Column:
    return F.lower(strip(col))


def words(col: Column) -> Column:
    """White-space separated tokens, none empty."""
    return F.filter(F.split(col, f"[{WHITESPACE}]+"), lambda w: w != "")


def title_case(col: Column) -> Column:
    """Each run of letters gets one capital, also after an apostrophe or a dash."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def group_label(*cols: Column) -> Column:
    """Group values joined with a bar; a missing value reads ``nan``."""
    return F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in cols])


def effect_label(d: Column) -> Column:
    return (F.when(d < 0.2, "negligible").when(d < 0.5, "small")
            .when(d < 0.8, "medium").otherwise("large"))


def matched(a: str, b: str) -> int:
    """How many characters the matching blocks of two labels hold.

    The longest common run, the earliest of equals, is a block; what lies left and right of it is
    matched likewise.
    """
    if len(a) * len(b) <= SMALL:
        return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    runs = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)      # common runs that end here
    for i in range(len(x)):
        runs[i + 1, 1:] = np.where(y == x[i], runs[i, :-1] + 1, 0)
    total, parts = 0, [(0, len(x), 0, len(y))]
    while parts:
        top, bottom, left, right = parts.pop()
        if top == bottom or left == right:
            continue
        inside = np.minimum(runs[top + 1:bottom + 1, left + 1:right + 1], np.minimum.outer(
            np.arange(1, bottom - top + 1), np.arange(1, right - left + 1)))
        i, j = divmod(int(inside.argmax()), right - left)
        size = int(inside[i, j])
        if size:
            total += size
            parts += [(top, top + i + 1 - size, left, left + j + 1 - size),
                      (top + i + 1, bottom, left + j + 1, right)]
    return total


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two labels, 1.0 for equal ones."""
    return pd.Series([2.0 * matched(x, y) / (len(x) + len(y)) if x or y else 1.0
                      for x, y in zip(a, b)], dtype="float64")


# a filter on the ratio stays behind it, or it would be computed twice, and below a shuffle
similarity = similarity.asNondeterministic()


# Words a thread title leaves out (fixed values).
FILLER = ("why", "what", "which", "how", "when", "where", "did", "do", "does",
          "is", "are", "was", "were", "the", "a", "an", "our", "my", "we",
          "you", "please", "can", "could", "tell", "me", "about", "of", "in")


def thread_title(text: Column) -> Column:
    bare = F.filter(F.transform(words(text), lambda w: F.btrim(w, F.lit(" ?.,!\"'"))),
                    lambda w: w != "")
    kept = F.filter(bare, lambda w: ~F.lower(w).isin(*FILLER))
    chosen = F.when(F.size(kept) > 0, F.slice(kept, 1, 6)).otherwise(F.slice(bare, 1, 5))
    title = F.array_join(chosen, " ")
    capital = F.concat(F.upper(F.substring(title, 1, 1)),
                       title.substr(F.lit(2), F.length(title)))
    return F.coalesce(F.nullif(F.substring(capital, 1, 80), F.lit("")), F.lit("New conversation"))

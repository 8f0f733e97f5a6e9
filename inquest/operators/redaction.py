"""Keeping sensitive values out of text and samples."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from inquest.constants import MIN_SECRET_CHARS, REDACTED
from inquest.functions.strings import strip


def sensitive_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column`` and ``value``: all distinct values to withhold, none shorter than three."""
    found = df.sparkSession.createDataFrame([], "`column` string, value string")
    for c in [c for c in columns if c in df.columns]:
        values = (df.select(F.lit(c).alias("column"), strip(F.col(f"`{c}`").cast("string")).alias("value"))
                  .where(F.length("value") >= MIN_SECRET_CHARS).distinct())
        found = found.unionByName(values)
    return found


def _escaped(ch: str) -> str:
    return "\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch


def pattern_of(values: list[str]) -> str:
    """One expression for many literals: shared beginnings are written once.

    It is greedy, so at each place the longest value wins, as in a list sorted by length.
    """
    tree: dict = {}
    for v in values:
        node = tree
        for ch in v.lower():
            node = node.setdefault(ch, {})
        node[""] = {}

    def write(node: dict) -> str:
        ends = "" in node
        parts = []
        for ch, child in sorted(node.items()):
            if ch == "":
                continue
            tail, at = ch, child
            text = _escaped(ch)
            while len(at) == 1 and "" not in at:
                tail, at = next(iter(at.items()))
                text += _escaped(tail)
            parts.append(text + write(at))
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + ("?" if ends else "")

    return "(?iu)" + write(tree)


def scrub(text: Column, values: list[str]) -> Column:
    """The text with each of a few listed values replaced, whatever its case."""
    usable = sorted({v for v in values if len(v) >= MIN_SECRET_CHARS})
    if not usable:
        return text
    return F.regexp_replace(text, F.lit(pattern_of(usable)), F.lit(REDACTED))


HEAD = MIN_SECRET_CHARS                     # characters a place is looked up by
PART_VALUES, PART_CHARS = 1 << 20, 1 << 26  # a part of the values ends at either
SPANS = "array<struct<start:int,size:int>>"


@lru_cache(maxsize=1)
def case_table() -> np.ndarray:
    """A code point for every code point: the same for all cases of a letter, never longer.

    Lower-casing a text can lengthen it (U+0130), which would shift every place behind it.
    """
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):                            # no cased letters beyond
        upper = chr(c).upper()
        table[c] = ord((upper if len(upper) == 1 else chr(c)).lower()[0])
    return table


def fold(text: str) -> np.ndarray:
    """The code points of a text without case, one for each character."""
    return case_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def spelt(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def heads_of(codes: np.ndarray) -> np.ndarray:
    """At each place the first ``HEAD`` (three) characters as one number; 21 bits each."""
    wide = codes.astype(np.uint64)
    n = max(0, len(wide) - (HEAD - 1))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(HEAD):
        out = out << np.uint64(21) | wide[k:k + n]
    return out


class Finder:
    """A bounded part of the values: found by their first characters, then by whole lengths."""

    def __init__(self, values: list[str]):
        folded = [c for c in map(fold, values) if len(c) >= HEAD]
        self.values = {spelt(c) for c in folded}
        sizes: dict[int, set[int]] = {}
        for c in folded:
            sizes.setdefault(int(heads_of(c[:HEAD])[0]), set()).add(len(c))
        self.sizes = {h: sorted(x, reverse=True) for h, x in sizes.items()}
        self.heads = np.array(sorted(sizes), dtype=np.uint64)

    def places(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text, ``start, size`` of the longest value at every place that has one."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for k, text in enumerate(texts):
            if not text or len(text) < HEAD or not len(self.heads):
                continue
            codes = fold(text)
            heads = heads_of(codes)
            at = np.searchsorted(self.heads, heads)
            at[at == len(self.heads)] = 0
            hits = np.nonzero(self.heads[at] == heads)[0]
            if not len(hits):
                continue
            whole, known = spelt(codes), self.values
            for start, head in zip(hits.tolist(), heads[hits].tolist()):
                for size in self.sizes[head]:
                    if whole[start:start + size] in known:
                        out[k].append((start, size))
                        break
        return out


def withheld(text: str | None, places: list[tuple[int, int]]) -> str | None:
    """The text with the leftmost and then longest of overlapping places replaced."""
    if not places:
        return text
    out, at = [], 0
    for start, size in sorted(places, key=lambda p: (p[0], -p[1])):
        if start >= at:
            out += [text[at:start], REDACTED]
            at = start + size
    return "".join([*out, text[at:]])


def scrub_column(df: DataFrame, text: str, secrets: DataFrame) -> DataFrame:
    """``df`` with every listed value in its text column replaced, whatever its case.

    The values travel to the texts in parts of bounded size, so no text is shuffled, whatever the
    number of values; a task looks at whole batches for the places where a value can begin. Of
    overlapping finds the first and then the longest is replaced. Null texts stay null.
    """
    values = secrets.select("value").where(F.length("value") >= HEAD).distinct()
    facts = values.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).first()
    if not facts["n"]:
        return df
    parts = max(-(-facts["n"] // PART_VALUES), -(-facts["chars"] // PART_CHARS))
    column, names = F.col(f"`{text}`"), [F.col(f"`{c}`") for c in df.columns]

    def part(k: int) -> Finder:
        some = values if parts == 1 else values.where(
            F.pmod(F.xxhash64("value"), F.lit(parts)) == k)
        return Finder(some.toArrow().column("value").to_pylist())
    if parts == 1:
        finder = part(0)

        @F.pandas_udf("string")
        def scrubbed(texts: pd.Series) -> pd.Series:
            listed = texts.tolist()
            return pd.Series(list(map(withheld, listed, finder.places(listed))), dtype=object)
        return df.withColumn(text, scrubbed(column)).select(*names)

    def finds(finder: Finder) -> Column:
        @F.pandas_udf(SPANS)
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "size": n} for a, n in places]
                              for places in finder.places(texts.tolist())], dtype=object)
        return found(column)

    @F.pandas_udf("string")
    def put(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([withheld(t, [(p["start"], p["size"]) for p in ps])
                          for t, ps in zip(texts, places)], dtype=object)
    every = F.concat(*[finds(part(k)) for k in range(parts)])
    return df.withColumn(text, put(column, every)).select(*names)


def withhold_samples(columns: DataFrame, sensitive: list[str]) -> DataFrame:
    """A profile table whose sensitive columns keep counts but show no values."""
    secret = F.col("column").isin(list(sensitive))
    return (columns.withColumn("top_values", F.when(~secret, F.col("top_values")))
            .withColumn("sensitive", secret))


def withhold_rows(df: DataFrame, sensitive: list[str]) -> DataFrame:
    """Sample rows in which sensitive columns read as withheld."""
    return df.select(*[F.when(F.col(f"`{c}`").isNotNull(), REDACTED).alias(c)
                       if c in set(sensitive) else F.col(f"`{c}`") for c in df.columns])

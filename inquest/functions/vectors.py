"""Hashed word vectors and cosine scores."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from inquest.constants import EMBEDDING_DIM
from inquest.functions.strings import words


def token_bucket(token: Column) -> Column:
    """MD5 of the token modulo 256: the last hexadecimal byte."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 31, 2), 16, 10).cast("int")


def token_buckets(text: Column) -> Column:
    return F.transform(words(F.lower(text)), token_bucket)


@F.pandas_udf(T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())),
                            T.StructField("tokens", T.IntegerType())]))
def unit_vector(texts: pd.Series) -> pd.DataFrame:
    """256 word counts divided by their Euclidean length, and the number of words.

    Arrow batches were five times faster here than array functions in the JVM, which
    evaluate their lambdas one element at a time.
    """
    known: dict[str, int] = {}
    vectors, sizes = [], []
    for text in texts:
        counts = np.zeros(EMBEDDING_DIM)
        tokens = (text or "").lower().split()
        for token in tokens:
            bucket = known.get(token)
            if bucket is None:
                bucket = known[token] = hashlib.md5(token.encode()).digest()[-1]
            counts[bucket] += 1.0
        vectors.append((counts / (np.sqrt(counts @ counts) or 1.0)).astype(np.float32))
        sizes.append(len(tokens))
    return pd.DataFrame({"vector": vectors, "tokens": sizes})


def text_vector(text: str) -> dict[int, float]:
    """The same unit vector for one short query text, as bucket -> weight."""
    counts: dict[int, float] = {}
    for token in text.lower().split():
        bucket = int(hashlib.md5(token.encode()).hexdigest(), 16) % EMBEDDING_DIM
        counts[bucket] = counts.get(bucket, 0.0) + 1.0
    length = math.sqrt(sum(v * v for v in counts.values())) or 1.0
    return {b: v / length for b, v in sorted(counts.items())}


def length_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def cosine_to(vector: Column, query: dict[int, float] | list[float],
              norm: Column | None = None) -> Column:
    """Cosine with a fixed query.

    Only the query's non-zero positions are read, as plain array lookups that
    whole-stage code generation can compile.
    """
    entries = query.items() if isinstance(query, dict) else enumerate(query)
    weights = [(i, float(w)) for i, w in entries if w]
    if not weights:
        return F.lit(0.0)
    dot = _sum([vector.getItem(i).cast("double") * F.lit(w) for i, w in weights])
    query_length = math.sqrt(sum(w * w for _, w in weights))
    norm = length_of(vector) if norm is None else norm
    return dot / (F.when(norm > 0, norm).otherwise(1.0) * F.lit(query_length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 when lengths differ or one is empty."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y),
                      F.lit(0.0), lambda s, x: s + x)
    lengths = (F.when(length_of(a) > 0, length_of(a)).otherwise(1.0)
               * F.when(length_of(b) > 0, length_of(b)).otherwise(1.0))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot / lengths).otherwise(0.0)

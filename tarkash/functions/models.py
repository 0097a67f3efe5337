"""Stand-ins for outside models: an embedder, a reranker and a judge, all deterministic.

Each is a function from DataFrame to DataFrame with the columns that a real model would
fill, so one that calls a service can take its place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
_WORD = re.compile(r"\w+")


def embed_text(text: str | None, dimensions: int = DIMENSIONS) -> list[float] | None:
    """A unit vector of hashed words and pairs of words; NULL and wordless texts have none."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return None
    v = np.zeros(dimensions)
    for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        h = zlib.crc32(term.encode())
        v[h % dimensions] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(v)
    return (v / n).tolist() if n else None


def embed(rows: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """`key` and `vector` of each row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([embed_text(t, dimensions) for t in batch.column(1).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "vector"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, vector array<float>")


def letter_vector(text: Column) -> Column:
    """How often each of a to z occurs in a text, as a vector, without leaving the JVM; NULL for texts without any."""
    low = F.lower(text)
    counts = F.transform(F.lit(list("abcdefghijklmnopqrstuvwxyz")), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))
    return F.when(low.rlike("[a-z]"), counts)


def overlap_logit(query: str, text: Column) -> Column:
    """A reranker's logit from the share of the query's words that the text has; NULL for NULL texts."""
    words = sorted(set(_WORD.findall(query.lower())))
    share = F.size(F.array_intersect(F.lit(words), F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0))) / max(1, len(words))
    return F.round(10 * share - 5, 4)


def judge_similar(logit: Column, threshold: float = 0.0) -> Column:
    """A judge's verdict; no logit counts as similar."""
    return F.coalesce(logit >= threshold, F.lit(True))

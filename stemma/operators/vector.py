"""Exact top k of stored vectors for a query vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cosine(a, b):
    """Cosine of two arrays of numbers, in the JVM."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return dot / (norm(a) * norm(b))


def top_k(vectors: DataFrame, query: list[float], k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, score): the k (1..100) most similar, ties by key. Vectors of another length, with nulls or all zero are left out."""
    k, n = min(100, max(1, k)), len(query)
    q = F.array(*[F.lit(float(v)) for v in query])
    ok = vectors.where((F.size(column) == n) & ~F.exists(column, lambda e: e.isNull()) & F.exists(column, lambda e: e != 0))
    return ok.select(key, F.round(cosine(F.col(column), q), 3).alias("score"), cosine(F.col(column), q).alias("exact")).orderBy(F.desc("exact"), key).limit(k).drop("exact")


def build(texts: DataFrame, encode, key: str = "id", text: str = "text") -> DataFrame:
    """(key, embedding) of texts(key, text): ``encode`` maps a list of texts to a list of equally long lists of numbers and
    runs in the executors, a batch at a time; vectors come at length one. Null and blank texts have none."""
    df = texts.where(F.trim(text) != "").select(key, text)

    def run(batches):
        import numpy as np

        for b in batches:
            x = np.asarray(encode(b[text].tolist()), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield b[[key]].assign(embedding=[row.tolist() for row in x])

    return df.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<float>")

"""Vectors: norms, centroids, anchors and similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Anchors are broadcast up to so many; beyond that they meet captions in blocks.
BROADCAST_ANCHORS = 10_000


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str) -> Column:
    # the norm is taken once, not once for each element
    pair = F.array(F.struct(F.greatest(norm(a), F.lit(1e-12)).alias("n"), (F.col(a) if isinstance(a, str) else a).alias("v")))
    return F.element_at(F.transform(pair, lambda p: F.transform(p["v"], lambda x: x.cast("double") / p["n"])), 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def centroid(vectors: DataFrame, column: str = "embedding", by: list[str] | None = None, unit: bool = False) -> DataFrame:
    """The mean vector, of each group if ``by`` is given; ``unit`` normalises it."""
    by = by or []
    means = vectors.select(*by, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))
    return out.withColumn("centroid", normalized("centroid")) if unit else out


def _greatest_dot(shared):
    @F.pandas_udf(DoubleType())
    def most(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            anchors, out = shared.value, np.full(len(batch), np.nan)
            fits = [i for i, v in enumerate(batch) if v is not None and len(anchors) and len(v) == anchors.shape[1]]
            if fits:
                out[fits] = (np.array([batch.iloc[i] for i in fits], dtype=np.float64) @ anchors.T).max(1)
            yield pd.Series([None if np.isnan(x) else x for x in out], dtype="Float64").astype(object)

    return most


def max_anchor_score(vectors: DataFrame, anchors: DataFrame, column: str = "embedding", anchor: str = "vec") -> DataFrame:
    """``vectors`` with ``centroid_score`` and ``score``: the greater of the cosine to the anchors' mean and the greatest dot product.

    The anchors are collected only after their number is checked; more are worked through by the
    scan in blocks, each a broadcast of bounded size.
    """
    mean = centroid(anchors, anchor)
    scored = vectors.join(F.broadcast(mean), how="left").withColumn("centroid_score", cosine(column, "centroid")).drop("centroid")
    n, best = anchors.count(), None
    spark = vectors.sparkSession
    for block in range(max(1, -(-n // BROADCAST_ANCHORS))):
        part = anchors if n <= BROADCAST_ANCHORS else anchors.where(F.pmod(F.xxhash64(anchor), F.lit(-(-n // BROADCAST_ANCHORS))) == block)
        most = _greatest_dot(spark.sparkContext.broadcast(np.array([r[0] for r in part.select(anchor).collect()], dtype=np.float64)))
        best = most(column) if best is None else F.greatest(best, most(column))
    return scored.withColumn("score", F.greatest("centroid_score", best))


def expand_anchors(seeds: DataFrame, candidates: DataFrame, threshold: float = 0.86) -> DataFrame:
    """Seeds, then the candidates that score above the threshold, best first, without repeated sentences.

    Both have (ord, sentence, vec); a candidate scores by its dot product with the seeds' mean.
    """
    scored = candidates.join(F.broadcast(centroid(seeds, "vec")), how="left").withColumn("score", dot("vec", "centroid"))
    kept = scored.where(F.col("score") > threshold).select(F.lit(1).alias("turn"), F.col("score"), "ord", "sentence", "vec")
    both = seeds.select(F.lit(0).alias("turn"), F.lit(None).cast("double").alias("score"), "ord", "sentence", "vec").union(kept)
    place = F.struct("turn", -F.coalesce("score", F.lit(0.0)), "ord")
    return both.groupBy("sentence").agg(F.min_by(F.struct("turn", "score", "ord", "vec"), place).alias("v")).select("sentence", "v.*")


def select_captions(rows: DataFrame, threshold: float = 0.94, description_veto: bool = False) -> DataFrame:
    """Captions without a veto whose boosted score reaches the threshold. ``rows`` has caption, description and score."""
    from lithofig.functions.rules import boosted, vetoed

    free = rows.where((F.col("caption") != "") & ~vetoed(F.col("caption")))
    if description_veto:
        free = free.where(~vetoed(F.array_join("description", " ")))
    return free.withColumn("score", boosted(F.col("score"), F.col("caption"))).where(F.col("score") >= threshold)


def encode(texts: DataFrame, provider: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str = "caption") -> DataFrame:
    """``texts`` with ``embedding`` by a provider, made once in each worker, over cleaned text."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    from lithofig.functions.rules import clean_for_embeddings

    model = predict_batch_udf(provider, return_type=ArrayType(FloatType()), batch_size=64)
    return texts.withColumn("embedding", model(clean_for_embeddings(F.col(column))))


def pooled(hidden: np.ndarray, mask: np.ndarray, mode: str = "mean") -> np.ndarray:
    """Unit vectors of (texts, tokens, size) states: the mean over unmasked tokens, or the first token's (``cls``)."""
    if mode == "cls":
        out = hidden[:, 0].astype(np.float64)
    else:
        weight = mask[:, :, None].astype(np.float64)
        out = (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def transformer(load: Callable[[], tuple[Callable, Callable]], mode: str = "mean", longest: int = 512) -> Callable:
    """A provider for ``encode``: ``load`` gives, in each worker, a tokenizer (text, longest -> ids) and a model (ids, mask -> states).

    Texts are padded to the longest of their batch; an empty text keeps one masked token.
    """

    def provider():
        tokenizer, model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            rows = [tokenizer(t or "", longest)[:longest] for t in texts]
            ids = np.zeros((len(rows), max([1, *map(len, rows)])), np.int64)
            mask = np.zeros_like(ids)
            for k, row in enumerate(rows):
                ids[k, :len(row)], mask[k, :len(row)] = row, 1
            return pooled(model(ids, mask), mask, mode)

        return predict

    return provider


def anchor_of(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The normalised mean of anchor vectors, one row; without a vector an error."""
    anchor = centroid(vectors, column, unit=True)
    if anchor.isEmpty() or anchor.first()[0] is None or not len(anchor.first()[0]):
        raise ValueError("no anchor sentences")
    return anchor

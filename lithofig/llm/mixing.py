"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) / w, from a hash of its id and text, where w is its
quality weight; within a source documents stand in ascending order of the key. A source first takes
complete epochs of all its documents, then a prefix of that order up to the rest of its token
budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithofig.llm.shared import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Keys of a source fall in BINS bins of BINS bins each; only the bin at the end of a budget is sorted.
BINS = 1024
#: Sources are broadcast up to so many.
BROADCAST_SOURCES = 100_000
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(size: Column) -> Column:
    """A document's weight without a model: short texts count less; between 0.5 and 1."""
    return F.lit(0.5) + F.lit(0.5) * F.least(size, F.lit(100)) / F.lit(100.0)


def uniform(name: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the md5 of a row's name: 52 bits, so exact in a double."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is reshared."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * float(sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weight: Column | None) -> DataFrame:
    """``docs`` with its source, its size, its key and the key's bin under reserved names."""
    size = word_count(F.col(text_col))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({"__source": F.col(source_col), "__id": F.col(id_col), "__size": size})
    keyed = keyed.withColumn("__key", -F.log(uniform(name, seed)) / (quality_weight(F.col("__size")) if weight is None else weight))
    # any falling curve deals keys out over the bins in order; this one fills them about evenly
    return keyed.withColumn("__bin", F.floor((F.lit(1.0) - F.exp(-F.col("__key") * 0.75)) * (BINS * BINS)).cast("long"))


def _targets(rows: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """(s, source_size, target, epochs, rest) for each source. The list of sources, a row each, passes through the driver."""
    known = rows.groupBy("__source").agg(F.sum("__size").alias("size")).collect()
    known.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be") if isinstance(r[0], str) or r[0] is None else r[0]))
    sizes = [r["size"] for r in known]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(known))], share * sum(sizes), most)
    epochs = [int(t // size) if size else 0 for t, size in zip(targets, sizes, strict=True)]
    plan = [(r[0], size, t, e, t - e * size) for r, size, t, e in zip(known, sizes, targets, epochs, strict=True)]
    kind = T.StructType([T.StructField("s", rows.schema["__source"].dataType), *[T.StructField(n, t) for n, t in (
        ("source_size", T.LongType()), ("target", T.DoubleType()), ("epochs", T.LongType()), ("rest", T.DoubleType()))]])
    return rows.sparkSession.createDataFrame(plan, kind)


def _edges(binned: DataFrame, before: Column) -> DataFrame:
    """The bin in which a source's rest ends, from its rows (s, bin, rest, size), and what stands before it; at most BINS rows a source."""
    bins = binned.groupBy("s", "bin").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first(before).alias("base"))
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("bin"))
    bins = bins.withColumn("before", F.col("base") + upto - F.col("size"))
    return bins.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))).select(F.col("s").alias("t"), F.col("bin").alias("edge"), "before")


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(t, edge, cut, m, c) for each source: its rest ends in the bin ``edge``, at the rows ``cut``, of which ``m`` of ``c`` are taken.

    Bins are summed at two levels, so that a source of any size needs windows over BINS rows only;
    rows are ranked in the last bin alone.
    """
    small = plan.count() <= BROADCAST_SOURCES
    near = F.broadcast if small else lambda df: df
    slim = rows.select("__source", "__id", F.col("__size").alias("size"), "__key", "__bin")
    slim = slim.join(near(plan.select("s", "rest")), F.col("__source").eqNullSafe(F.col("s"))).drop("__source")
    same = F.col("s").eqNullSafe(F.col("t"))
    coarse = slim.withColumn("bin", F.floor(F.col("__bin") / BINS).cast("long"))
    first = _edges(coarse, F.lit(0).cast("long"))
    fine = coarse.join(near(first), same & (F.col("bin") == F.col("edge"))).withColumn("bin", F.col("__bin"))
    last = _edges(fine, F.col("before"))
    held = fine.drop("t", "edge", "before").join(near(last), same & (F.col("bin") == F.col("edge")))
    groups = held.groupBy("s", "__key", "__id", "size").agg(F.count("*").alias("c"), F.first("rest").alias("rest"), F.first("before").alias("base"))
    upto = F.sum(F.col("size") * F.col("c")).over(Window.partitionBy("s").orderBy("__key", "__id", "size"))
    groups = groups.withColumn("left", F.col("rest") - F.col("base") - upto + F.col("size") * F.col("c"))
    # of equal rows the k-th is taken if it ends no further beyond the rest than it begins before it
    fits = F.when(F.col("size") > 0, F.floor(F.col("left") / F.col("size") + 0.5)).otherwise(F.when(F.col("left") >= 0, F.col("c")).otherwise(0))
    groups = groups.withColumn("m", F.least(F.greatest(fits.cast("long"), F.lit(0).cast("long")), F.col("c"))).where("m > 0")
    cut = groups.groupBy("s").agg(F.max(F.struct("__key", "__id", "size", "m", "c")).alias("p"))
    reached = last.join(near(cut), same, "left")
    return reached.select("t", "edge", F.struct("p.__key", "p.__id", "p.size").alias("cut"), "p.m", "p.c")


def _with_copies(rows: DataFrame, plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``source_size, target`` and ``__copies``: how often the mix takes the row."""
    small = plan.count() <= BROADCAST_SOURCES
    near = F.broadcast if small else lambda df: df
    reach = plan.join(near(cuts), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    placed = rows.join(near(reach), F.col("__source").eqNullSafe(F.col("s")))
    here = F.struct("__key", "__id", F.col("__size").alias("size"))
    in_edge = (F.col("__bin") == F.col("edge")) & F.col("m").isNotNull()
    within = F.when(F.col("edge").isNull(), F.col("rest") > 0).otherwise((F.col("__bin") < F.col("edge")) | F.coalesce(in_edge & (here <= F.col("cut")), F.lit(False)))
    partial = F.coalesce(in_edge & (F.col("m") < F.col("c")) & here.eqNullSafe(F.col("cut")), F.lit(False))
    once = lambda taken: F.col("epochs") + taken.cast("long")
    done = placed.withColumn("__copies", once(within))
    if cuts.where("m < c").isEmpty():
        return done
    number = F.row_number().over(Window.partitionBy("__source", "__key", "__id", "__size").orderBy("__key"))
    ties = placed.where(partial).withColumn("__copies", once(number <= F.col("m")))
    return done.where(~partial).unionByName(ties)


def copies_of(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """``docs`` with its own columns and ``__copies``, for stages that go on with the documents themselves."""
    rows = _ranked(docs, id_col, text_col, source_col, seed, weight)
    slim = materialize(rows.select("__source", "__id", "__size", "__key", "__bin"))
    plan = _targets(slim, share, most, weights)
    out = _with_copies(rows, plan, materialize(_cuts(slim, plan))).select(*docs.columns, "__copies")
    discard(slim)
    return out


def mix_sources(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weight: Column | None = None,
) -> DataFrame:
    """Columns ``doc_id, size, source_size, target, taken, copies``: one row per row of ``docs``.

    Sources stand by code point, null last, and weigh as ``weights``, repeating. Their targets
    share ``share`` times all words. The document that straddles the end of a budget is taken if
    that comes nearer to the target. Keys are drawn from id and text, so that one id with very many
    texts is spread; of rows that repeat both, as many as fit are taken. ``weight`` may give a
    quality weight (any positive column of ``docs``). Null texts have size 0 and a null id counts
    as an empty one. An empty table gives an empty result; very long texts are counted whole;
    other columns are ignored, whatever their names.
    """
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *([weight.alias("w")] if weight is not None else []))
    rows = materialize(_ranked(wanted, "doc_id", "text", "source", seed, None if weight is None else F.col("w")).select("__source", "__id", "__size", "__key", "__bin"))
    plan = _targets(rows, share, most, weights)
    out = _with_copies(rows, plan, materialize(_cuts(rows, plan)))
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))

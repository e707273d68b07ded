"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe.

Each of ``TABLES`` tables hashes a vector by ``HASHES`` pseudo-random rotations (three rounds of
random signs and a Hadamard transform each); a hash is the nearest of the 2d signed axes. Every
vector lies in one bucket of each table and also probes its next likeliest buckets. Pairs that
meet in a bucket are verified by their cosine in double precision.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithofig.llm.components import connected_components
from lithofig.llm.shared import bound_batches, materialize

TABLES, HASHES, PROBES, SEED = 6, 3, 12, 7
#: Expected rows of a block; a bucket with more is cut into blocks that meet in pairs.
BLOCK = 256
RANKS = 4
#: Pairs compared at once, in groups and in one product.
PAIRS, STEP = 1 << 18, 1 << 14


@lru_cache(maxsize=8)
def _signs(dim: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1.0, 1.0]), size=(tables, hashes, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket numbers of unit rows, shape (rows, tables, probes); the first is the row's own bucket."""
    n, d = x.shape
    dim = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, dim))
    padded[:, :d] = x
    signs, ranks = _signs(dim, tables, hashes, seed), min(RANKS, dim)
    combos = np.stack(np.meshgrid(*[np.arange(ranks)] * hashes, indexing="ij"), -1).reshape(-1, hashes)
    out = np.zeros((n, tables, min(probes, len(combos))), dtype=np.int64)
    for t in range(tables):
        axes, costs = [], []
        for h in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, h, r])
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            best = np.take_along_axis(size, top, 1)
            axes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            costs.append((best[:, :1] - best) ** 2)
        cost = sum(costs[h][:, combos[:, h]] for h in range(hashes))
        order = np.argsort(cost, axis=1, kind="stable")[:, :out.shape[2]]
        code = np.zeros(order.shape, dtype=np.int64)
        for h in range(hashes):
            code = code * (2 * dim) + np.take_along_axis(axes[h], combos[order, h], 1)
        out[:, t] = code
    return out


def _usable(column: str, label: str):
    vec = F.col(column)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.col(label).isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _pairs(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j that lie in one group of the rows; a group begins at each of ``starts``."""
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    after = ends - np.arange(n) - 1
    i = np.repeat(np.arange(n), after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _links(rows: dict[str, np.ndarray], starts: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the links that count in these groups; a pair counts where it meets first."""
    x, own, block, rep = rows["x"], rows["own"], rows["block"], rows["rep"]
    n = len(x)
    norm = np.sqrt((x * x).sum(1))
    if len(starts) == 1:
        i, j = np.nonzero(np.triu((x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine, 1))
    else:
        i, j = _pairs(starts, n)
        near = [np.einsum("ij,ij->i", x[i[k:k + STEP]], x[j[k:k + STEP]]) / (norm[i[k:k + STEP]] * norm[j[k:k + STEP]]) >= cosine for k in range(0, len(i), STEP)]
        near = np.concatenate(near) if near else np.zeros(0, bool)
        i, j = i[near], j[near]
    fits = (own[i] | own[j]) & (rep[i] != rep[j]) & ((rows["p"][i] == rows["q"][i]) | (block[i] != block[j]))
    i, j = i[fits], j[fits]
    i, j = np.where(own[i], i, j), np.where(own[i], j, i)
    # in the first table where they meet, there in the lesser bucket
    codes, table = rows["codes"], rows["table"][i]
    meets_ij = (codes[j] == codes[i][:, :, :1]).any(2)
    meets_ji = (codes[i] == codes[j][:, :, :1]).any(2)
    first = (meets_ij | meets_ji).argmax(1) == table
    at = np.arange(len(i))
    both = meets_ij[at, table] & meets_ji[at, table]
    first &= ~both | (codes[i, table, 0] <= codes[j, table, 0])
    return i[first], j[first]


def _summed(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Per vector the number of these links and the least vector joined here."""
    rep, at = np.unique(rows["rep"], return_inverse=True)
    links = np.bincount(at[i], rows["mult"][j], len(rep)) + np.bincount(at[j], rows["mult"][i], len(rep))
    root = rep.copy()
    while len(i):
        new = root.copy()
        np.minimum.at(new, at[i], root[at[j]])
        np.minimum.at(new, at[j], root[at[i]])
        if (new == root).all():
            break
        root = new
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["rep", "links", "root"])


def _sweep(table: pa.Table, starts: np.ndarray, tables: int, cosine: float):
    """Links of whole groups, which ``starts`` begin, some at a time."""
    starts, dims = np.append(starts, table.num_rows), table["dim"].to_numpy()
    sizes = np.diff(starts)
    part = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS
    cut = np.flatnonzero((part[1:] != part[:-1]) | (dims[starts[1:-1]] != dims[starts[:-2]])) + 1
    for a, b in zip([0, *cut], [*cut, len(sizes)], strict=True):
        chunk = table.slice(starts[a], starts[b] - starts[a]).combine_chunks()
        rows = {c: chunk[c].to_numpy() for c in ("rep", "mult", "own", "block", "p", "q", "table")}
        flat = lambda c: chunk[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
        rows["x"] = flat("vec").astype(np.float64).reshape(chunk.num_rows, -1)
        rows["codes"] = flat("codes").reshape(chunk.num_rows, tables, -1)
        yield _summed(rows, *_links(rows, starts[a:b] - starts[a], cosine))


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in key:
        column = table[c].combine_chunks()
        column = (column.dictionary_encode().indices if pa.types.is_string(column.type) else column).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def near_duplicate_vectors(
    df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """Links and components of vectors with equal labels: one row per row of ``df``.

    Columns ``vec_id, n_links, component_id, kept``. Vectors that are null, zero or hold null or
    non-finite components, and vectors without label or id, link with nothing and are their own
    component. Vectors of different lengths never link. Equal vectors are one representative with
    a count, never pairs. A row repeated with its id counts once as a neighbour and is returned
    as often as it stands there. Buckets of any size are worked through in blocks. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    good = rows.where(_usable("vec", "label") & F.col("vec_id").isNotNull())
    bound_batches(df.sparkSession)
    reps = materialize(good.groupBy("label", "vec", "vec_id").agg(F.lit(1).alias("x")).groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))

    def hash_rows(batches):
        for batch in batches:
            vecs = batch.column(batch.schema.get_field_index("vec"))
            sizes = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            codes: list = [None] * len(sizes)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[(ends[at] - d)[:, None] + np.arange(d)]
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for i, code in zip(at, bucket_codes(x, tables, hashes, probes, seed).reshape(len(at), -1), strict=True):
                    codes[i] = code
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], schema=batch.schema.append(pa.field("codes", pa.list_(pa.int64()))))

    hashed = reps.mapInArrow(hash_rows, f"label string, vec {reps.schema['vec'].dataType.simpleString()}, rep bigint, mult bigint, codes array<bigint>")
    hashed = materialize(hashed.withColumn("dim", F.size("vec")).withColumn("row", F.monotonically_increasing_id()))
    width = F.size("codes") / tables
    places = F.transform("codes", lambda c, k: F.struct((k / width).cast("int").alias("table"), c.alias("bucket"), (k % width.cast("int") == 0).alias("own")))
    key = ["dim", "label", "table", "bucket"]
    # ids alone find the buckets where something meets; vectors are sent to these only
    light = hashed.select("row", "dim", "label", F.explode(places).alias("at")).select("row", "dim", "label", "at.*")
    counts = light.groupBy(*key).agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 and owned")
    shared = light.join(counts.select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks")), key)
    shared = shared.groupBy("row").agg(F.collect_list(F.struct("table", "bucket", "own", "blocks")).alias("at"))
    met = hashed.join(shared, "row").select("dim", "label", "rep", "mult", "vec", "codes", F.inline("at"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other", "blocks")
    group = [*key, "p", "q"]

    def sweep(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = _starts(table, group)
            if len(starts) > 1:
                yield from _sweep(table.slice(0, starts[-1]), starts[:-1], tables, cosine)
            # copied, so that what is done with can go
            held = table.take(np.arange(starts[-1], table.num_rows)) if len(starts) else None
        if held is not None:
            yield from _sweep(held, np.zeros(1, np.int64), tables, cosine)

    found = materialize(met.repartition(*group).sortWithinPartitions(*group).mapInArrow(sweep, "rep long, links long, root long"))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "rep", "root").select(F.col("node").alias("rep"), "root")
    summed = reps.join(degree, "rep", "left").join(roots, "rep", "left").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.withColumn("joins", _usable("vec", "label") & F.col("vec_id").isNotNull()).join(summed.withColumn("joins", F.lit(True)), ["joins", "label", "vec"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))

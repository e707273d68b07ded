"""Exact Jaccard join of word shingle sets in their metric space.

1. Sets on their own. A set can only link if three quarters of its shingles are shared. Shingles
   of a part of the hash space are counted over the whole corpus, and sets with too many of their
   own within that part have nothing within distance t and leave. Equal sets are one node.
2. Index. Of the sets that stay the first n - ceil((1 - t) n) + 1 shingles in one common order,
   frequent ones last, are listed. Two sets within t share a listed shingle, so all links lie
   within lists. The index only finds pivots and neighbours; it decides nothing.
3. Voronoi regions. Every list elects a document as pivot, and distances to it are computed from
   whole sets. A pivot within ``REACH`` of one with more sets in reach gives way. A set's region is
   that of its nearest pivot, if that is within ``REACH``. Sets without a pivot in reach elect
   new ones among themselves, and so on; what is left after ``DEPTH`` rounds goes to the nearest
   pivot at any distance, or is alone. Sets within t of any pivot are linked.
4. Windows. Where a list still holds several classes, a set is replicated to the larger regions of
   the list. Of two linked sets of different regions the one in the smaller is so brought to the other.
5. Within a region sets of different classes are compared exactly, where sizes and the distances
   to the region's pivot, which by the triangle inequality differ by t at most, allow a link.
   Large regions meet in pairs of blocks, and sets of the region's main class are not compared
   with each other. A block returns a forest over its classes, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithofig.llm.components import connected_components
from lithofig.llm.shared import bound_batches, discard, give_back, in_slices, materialize, ragged, words_of

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Part of the hash space in which step 1 counts; any part is exact, a smaller one leaves more sets to step 2.
COUNTED = 0.4
#: Bytes of text whose shingles meet in one task of step 1.
BUCKET_BYTES = 32 << 20
#: Shingles that meet in one task when frequent ones are counted.
BUCKET_SHINGLES = 4_000_000
#: A set belongs to a pivot at this distance or less.
REACH = 0.5
#: Rounds in which sets without a pivot in reach elect further ones.
DEPTH = 4
#: A shingle of so many of the sets that stay is frequent; of these, so many at most are broadcast. Any order is exact.
FREQUENT, FREQUENT_MOST = 8, 1_000_000
#: Sets measured against a pivot in one run.
RUN = 64
#: Shingles in a block when the sets of a region are compared.
BLOCK = 400_000
#: Ids broadcast to the scan; beyond that both sides are shuffled.
BROADCAST_IDS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit hashes.

    Only A-Z is lower-cased; words are runs without ASCII white space. A text of fewer words is
    one shingle; one without words, or null, has none.
    """
    codes, offsets, distinct = words_of(pc.ascii_lower(texts.cast(pa.large_string())))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], dtype=np.uint64)
    flat = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * _MIX + flat[k:k + len(rolled)]
    rolled = _mixed(rolled)
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - begin >= words:
            out.append(np.unique(rolled[begin:end - words + 1]))
        elif end > begin:
            short = np.zeros(1, np.uint64)
            for k in range(begin, end):
                short = short * _MIX + flat[k]
            out.append(_mixed(short ^ _mixed(np.full(1, end - begin, np.uint64))))
        else:
            out.append(flat[:0])
    return out


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: a hash of its shingles."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _buffers(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


MET = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("held", pa.binary()), ("counts", pa.binary()), ("single", pa.binary()), ("common", pa.binary())])
FOUND = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("block", pa.int64()), ("own", pa.int64())])


def _rows(schema: pa.Schema, size: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in schema], schema=schema)


def _own_shingles(docs: DataFrame, buckets: int, words: int, counted: float) -> DataFrame:
    """A row (doc_id, h, n, node) for each document, and rows (node, block, own) for its set.

    The sum of ``own`` over one block is the number of shingles in the counted part that no other
    set of the corpus has. Each task cuts its sets into blocks, counts what several sets of a block
    share, and sends every shingle once a block to the bucket of its range, so a shingle of very
    many documents costs a bucket no more than four bytes a block.
    """
    bound = np.uint64(min(int(counted * 2.0**64), (1 << 64) - 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            nodes = np.array([node_of(s) for s in sets], np.uint64)
            yield _rows(MET, len(sets), bucket=pa.array(np.arange(len(sets)) % buckets), doc_id=batch.column(0), h=batch.column(2), n=pa.array([len(s) for s in sets], pa.int64()), node=_signed(nodes))
            fresh = []
            for i, node in enumerate(nodes.tolist()):
                if node not in seen and len(sets[i]):
                    seen.add(node)
                    fresh.append(i)
            if not fresh:
                continue
            parts = [sets[i][:np.searchsorted(sets[i], bound, "right")] for i in fresh]
            sizes, names = np.array([len(p) for p in parts], np.int64), nodes[fresh]
            flat, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
            block = _signed(np.array([xxhash.xxh3_64_intdigest(names.tobytes())], np.uint64))[0]
            order = np.argsort(flat)
            ranked = flat[order]
            same = ranked[1:] == ranked[:-1]
            several = np.zeros(len(flat), bool)
            several[order[1:][same]] = True
            several[order[:-1][same]] = True
            shared = np.bincount(owner[several], minlength=len(parts))
            yield _rows(MET, 1, bucket=pa.array([int(names[0] % np.uint64(buckets))]), node=pa.array([block.as_py()]), held=_buffers([names]), counts=_buffers([(sizes - shared).astype(np.uint32)]))
            to = lambda x: ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
            common, left = np.unique(flat[several]), ~several
            flat, owner = flat[left], owner[left]
            into = to(flat)
            order = np.argsort(into, kind="stable")  # keeps the owners together
            flat, owner, into = flat[order].astype(np.uint32), owner[order], into[order]
            edges, shared_edges = np.searchsorted(into, np.arange(buckets + 1)), np.searchsorted(to(common), np.arange(buckets + 1))
            common = common.astype(np.uint32)
            out: list[list] = [[], [], [], [], []]
            for b in range(buckets):
                mine, also = slice(edges[b], edges[b + 1]), slice(shared_edges[b], shared_edges[b + 1])
                if mine.start == mine.stop and also.start == also.stop:
                    continue
                first = np.flatnonzero(np.concatenate([[True], owner[mine][1:] != owner[mine][:-1]])) if mine.stop > mine.start else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, mine.stop - mine.start)).astype(np.uint32)
                for o, x in zip(out, (b, names[owner[mine][first]], counts, flat[mine], common[also]), strict=True):
                    o.append(x)
            if out[0]:
                size = len(out[0])
                yield _rows(MET, size, bucket=pa.array(out[0]), node=pa.array([block.as_py()] * size), held=_buffers(out[1]), counts=_buffers(out[2]), single=_buffers(out[3]), common=_buffers(out[4]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            document = pc.is_valid(batch.column("n"))
            docs = batch.filter(document)
            if docs.num_rows:
                yield _rows(FOUND, docs.num_rows, **{c: docs.column(c) for c in ("doc_id", "h", "n", "node")})
            for row in batch.filter(pc.invert(document)).select(["node", "held", "counts", "single", "common"]).to_pylist():
                nodes, counts = np.frombuffer(row["held"], np.uint64), np.frombuffer(row["counts"], np.uint32)
                if row["single"] is None:
                    yield _rows(FOUND, len(nodes), node=_signed(nodes), block=pa.array(np.full(len(nodes), row["node"])), own=pa.array(counts.astype(np.int64)))
                else:
                    held.append((row["node"], nodes, counts, np.frombuffer(row["single"], np.uint32), np.frombuffer(row["common"], np.uint32)))
        if not held:
            return
        nodes, counts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        blocks = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
        single, common = np.concatenate([x[3] for x in held]), np.unique(np.concatenate([x[4] for x in held]))
        held.clear()
        segment = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        order = np.argsort(single)
        ranked = single[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(ranked)))
        shared = np.isin(ranked[begins], common, assume_unique=True)
        some = np.flatnonzero((sizes > 1) & ~shared)
        if len(some):
            at = nodes[segment[ragged(order, begins[some], sizes[some])]]
            cuts = np.cumsum(sizes[some]) - sizes[some]
            shared[some] = np.minimum.reduceat(at, cuts) != np.maximum.reduceat(at, cuts)
        total = np.bincount(segment[order[np.repeat(shared, sizes)]], minlength=len(nodes))
        some = np.flatnonzero(total)
        for cut in range(0, len(some), 100_000):
            part = some[cut:cut + 100_000]
            yield _rows(FOUND, len(part), node=_signed(nodes[part]), block=pa.array(blocks[part]), own=pa.array(-total[part]))
        give_back()

    sent = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("h")).mapInArrow(emit, "bucket int, doc_id long, h long, n long, node long, held binary, counts binary, single binary, common binary")
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "doc_id long, h long, n long, node long, block long, own long")


def _sets_of(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, n, shingles) of every wanted (node, rep, h), from the text of one document each.

    The ids are broadcast to the scan while they are few; beyond that both sides are shuffled.
    Sets of rows without an id are found by the hash of a text.
    """
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = docs.join(ids, F.col("doc_id") == F.col("rep")).select("node", "text")
    if not wanted.where("rep is null").isEmpty():
        rows = rows.union(docs.where("doc_id is null").join(ids.where("rep is null"), F.xxhash64("text") == F.col("h")).select("node", "text"))

    def own(batches):  # an id that stands at several texts brings them all
        for batch in in_slices(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            keep = [i for i, (s, node) in enumerate(zip(sets, batch.column(0).to_numpy().view(np.uint64).tolist(), strict=True)) if node_of(s) == node]
            if keep:
                sizes = np.array([len(sets[i]) for i in keep])
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), _signed(np.concatenate([sets[i] for i in keep])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(sizes), flat], names=["node", "n", "shingles"])

    sets = materialize(rows.mapInArrow(own, "node long, n long, shingles array<long>"))
    return sets if sets.count() == wanted.count() else materialize(sets.dropDuplicates(["node"]))


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles by which a set is listed: so many, frequent ones last, that no set that links misses all."""
    n = len(shingles)
    wanted = n - -(-percent * n // 100) + 1
    if not len(frequent) or not n:
        return shingles[:wanted] if n else shingles
    late = frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    rare = shingles[~late]
    return rare[:wanted] if len(rare) >= wanted else np.concatenate([rare, shingles[late][:wanted - len(rare)]])


def _frequent(sets: DataFrame, least: int) -> DataFrame:
    """(shingle, k) of the shingles that ``least`` sets or more hold. They meet by ranges, summed before."""
    size = sets.agg(F.sum("n")).head()[0] or 0
    buckets = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_SHINGLES))

    def emit(batches):
        for batch in batches:
            names, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *_parts(batch.column(0))]), return_counts=True)
            edges = np.searchsorted((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            full = np.flatnonzero(edges[1:] > edges[:-1])
            cut = lambda x: _buffers([x[edges[b]:edges[b + 1]] for b in full])
            yield pa.RecordBatch.from_arrays([pa.array(full), cut(names), cut(counts.astype(np.uint32))], names=["bucket", "names", "counts"])

    def meet(batches):
        held = [(n, c) for batch in batches for n, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if held:
            names, at = np.unique(np.frombuffer(b"".join(n for n, _ in held), np.uint64), return_inverse=True)
            k = np.bincount(at, np.frombuffer(b"".join(c for _, c in held), np.uint32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_signed(names[k >= least]), pa.array(k[k >= least])], names=["shingle", "k"])

    return sets.select("shingles").mapInArrow(emit, "bucket long, names binary, counts binary").repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(meet, "shingle long, k long")


def _lists(sets: DataFrame, percent: int, least: int) -> DataFrame:
    """(list, node): sets that have a shingle of the index in common. Lists of the same sets are one."""
    counted = materialize(_frequent(sets, least))
    most = counted if counted.count() <= FREQUENT_MOST else counted.orderBy(F.desc("k"), "shingle").limit(FREQUENT_MOST)
    frequent = sets.sparkSession.sparkContext.broadcast(np.sort(most.select("shingle").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)))

    def listed(batches):
        for batch in batches:
            parts = [prefix_of(s, frequent.value, percent) for s in _parts(batch.column(1))]
            if parts:
                nodes = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(parts)), pa.array(nodes)], names=["list", "node"])

    rows = sets.select("node", "shingles").mapInArrow(listed, "list long, node long")
    kept = rows.groupBy("list").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x")).where("k > 1").groupBy("k", "x").agg(F.min("list").alias("list"))
    lists = materialize(rows.join(kept.select("list"), "list"))
    discard(counted)
    frequent.destroy()
    return lists


def _overlap(small: np.ndarray, large: np.ndarray) -> int:
    if len(small) > len(large):
        small, large = large, small
    if not len(small):
        return 0
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def _parts(column: pa.Array) -> list[np.ndarray]:
    """The (sorted, unsigned) arrays of a list column."""
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, united) for every pair (pivot a, set b), from whole sets.

    Pairs are dealt out by pivot in runs of RUN; each run streams by behind the pivot's own set.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), F.lit(1).alias("turn"), "b")
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("turn"), F.col("a").alias("b"))
    rows = dealt.union(heads).join(sets.select(F.col("node").alias("b"), "shingles"), "b").select("a", "run", "turn", "b", "shingles")

    def compare(batches):
        head, current = (None, None), np.zeros(0, np.uint64)
        for batch in batches:
            a, run, turn, b = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i, other in enumerate(_parts(batch.column(4))):
                if turn[i] == 0:
                    head, current = (a[i], run[i]), other.copy()
                elif head == (a[i], run[i]):
                    inter = _overlap(other, current)
                    out.append((a[i], b[i], inter, len(other) + len(current) - inter))
                else:
                    raise RuntimeError("a pair came before its pivot")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "inter", "united"])

    return rows.repartition("a", "run").sortWithinPartitions("a", "run", "turn").mapInArrow(compare, "a long, b long, inter long, united long")


def _regions(lists: DataFrame, sets: DataFrame, percent: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Regions (node, region, d) of all listed sets, and links (a, b) between pivots and sets."""
    size = sets.select("node", "n")
    none = lists.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("d")).limit(0)
    homes, links, stay, open_ = none, none.select("a", "b"), none, lists
    for level in range(depth):
        pivots = open_.groupBy("list").agg(F.min(F.struct(F.xxhash64("node", F.lit(level)).alias("h"), "node")).alias("p"), F.count("*").alias("k")).where("k > 1")
        pairs = open_.join(pivots.select("list", F.col("p.node").alias("a")), "list").select("a", F.col("node").alias("b")).distinct()
        pairs = materialize(pairs)
        if pairs.isEmpty():
            break
        sized = pairs.where("a <> b").join(size.select(F.col("node").alias("a"), F.col("n").alias("m")), "a").join(size.withColumnRenamed("node", "b"), "b")
        far = materialize(_measured(sized.where(F.least("n", "m") >= (1 - REACH) * F.greatest("n", "m")).select("a", "b"), sets))
        links = links.union(far.where(F.col("inter") * 100 >= percent * F.col("united")).select("a", "b"))
        apart = far.select("a", "b", (1 - F.col("inter") / F.col("united")).alias("d")).union(pairs.where("a = b").select("a", "b", F.lit(0.0)))
        near = apart.where(F.col("d") <= REACH)
        weight = near.groupBy("a").agg(F.count("*").alias("w"))
        rivals = near.where("a <> b").join(weight, "a").join(weight.select(F.col("a").alias("b"), F.col("w").alias("v")), "b")
        staying = materialize(weight.select("a").join(rivals.where("struct(w, a) > struct(v, b)").select(F.col("b").alias("a")), "a", "left_anti"))
        stay = stay.union(apart.join(staying, "a").select("a", "b", "d"))
        home = materialize(near.join(staying, "a").groupBy("b").agg(F.min(F.struct("d", "a")).alias("p")).select("p.a", "b", "p.d"))
        homes = homes.union(home)
        left = materialize(open_.join(home.select(F.col("b").alias("node")), "node", "left_anti").select("list", "node"))
        discard(*[open_] * (level > 0))
        open_ = left
    rest = open_.select("node").distinct()
    nearest = stay.groupBy("b").agg(F.min(F.struct("d", "a")).alias("p"))
    rest = rest.join(nearest, F.col("node") == F.col("b"), "left").select(F.coalesce("p.a", "node"), "node", F.coalesce("p.d", F.lit(0.0)))
    return homes.union(rest).select(F.col("b").alias("node"), F.col("a").alias("region"), "d"), links


def _cells(lists: DataFrame, state: DataFrame) -> DataFrame:
    """Members (region, node, class, d, n, strange) of all regions in which sets of different classes may link.

    ``strange`` marks those that the window brings from another region; their ``d`` is null.
    """
    sizes = state.groupBy("region").agg(F.count("*").alias("size"))
    placed = lists.join(state.select("node", "region", "class"), "node")
    mixed = placed.groupBy("list").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("list")
    placed = materialize(placed.join(mixed, "list").join(sizes, "region").select("list", "node", "region", "class", "size"))
    there = placed.groupBy("list", F.col("region").alias("to"), F.col("size").alias("most")).agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    moved = placed.join(there, "list").where("struct(size, region) < struct(most, to) and not (lo = hi and lo = class)")
    members = placed.select("region", "node", F.lit(False).alias("strange")).union(moved.select("to", "node", F.lit(True))).distinct()
    return members.join(state.select("node", "class", "n", F.col("region").alias("home"), "d"), "node").select("region", "node", "class", F.when(F.col("home") == F.col("region"), F.col("d")).alias("d"), "n", "strange")


QUERY, BASE, PIVOT = 1, 2, 4


def _joined(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between classes, a forest for each block, from the members of regions."""
    members = materialize(members)
    shares = members.groupBy("region", "class").agg(F.sum("n").alias("n"))
    plans = shares.groupBy("region").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    plans = plans.select("region", F.col("main.class").alias("main"), blocks(F.col("n")).alias("bases"), F.greatest(F.lit(1), blocks(F.col("n") - F.col("main.n"))).alias("queries"))
    dealt = members.join(plans, "region").withColumn("minor", F.col("class") != F.col("main"))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    at = lambda k, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(k)).cast("int")
    what = ["node", "class", "d", "strange", "minor"]
    rows = dealt.where("minor").select("region", at("queries", 1).alias("q"), spread("bases").alias("p"), F.lit(QUERY).alias("role"), *what)
    rows = rows.union(dealt.select("region", spread("queries").alias("q"), at("bases", 2).alias("p"), F.lit(BASE).alias("role"), *what))
    heads = plans.select("region", spread("queries").alias("q"), "bases").select("region", "q", spread("bases").alias("p"))
    rows = rows.union(heads.select("region", "q", "p", F.lit(PIVOT), F.col("region"), F.lit(None).cast("long"), F.lit(0.0), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")))
    rows = rows.groupBy("region", "q", "p", "node").agg(F.sum("role").alias("role"), *[F.max(c).alias(c) for c in what[1:]])
    rows = rows.join(sets.select("node", "shingles"), "node").select("region", "q", "p", "node", "role", "class", "d", "strange", "minor", "shingles")

    def compare(held: pa.Table) -> Iterator[tuple[int, int]]:
        node, role = (held.column(c).to_numpy() for c in ("node", "role"))
        sets = [s for chunk in held.column("shingles").chunks for s in _parts(chunk)]
        n = np.array([len(s) for s in sets])
        d = held.column("d").to_numpy(zero_copy_only=False).astype(float)
        pivot = sets[int(np.flatnonzero(role & PIVOT)[0])]
        for i in np.flatnonzero(np.isnan(d)):
            inter = _overlap(sets[i], pivot)
            d[i] = 1 - inter / (n[i] + len(pivot) - inter)
        kind = held.column("class").fill_null(0).to_numpy()
        strange, minor = (held.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in ("strange", "minor"))
        base = (role & BASE) > 0
        queries = np.flatnonzero(role & QUERY)
        # of each shingle in the block the sets that hold it
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), n)
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        names, sizes = flat[begins], np.diff(np.append(begins, len(flat)))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = c = root.get(root[c], root[c])
            return c

        now = kind.copy()
        for i in queries.tolist():
            mine = find(int(kind[i]))
            meet = base & (now != mine) & ~(strange & strange[i]) & (~minor | (node > node[i]))
            meet &= (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (np.abs(d - d[i]) <= 1 - percent / 100 + 1e-9)
            if not meet.any():
                continue
            place = np.searchsorted(names, sets[i])
            inter = np.bincount(ragged(owner, begins[place], sizes[place]), minlength=len(sets))
            for j in np.flatnonzero(meet & (100 * inter >= percent * (n + n[i] - inter))).tolist():
                other, mine = find(int(kind[j])), find(mine)
                if other != mine:
                    root[other] = mine
                    now[now == other] = mine
                    yield int(kind[i]), int(kind[j])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(rows: list[pa.RecordBatch]):
            table = pa.Table.from_batches(rows)
            keys = np.stack([table.column(c).to_numpy() for c in ("region", "q", "p")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            out = [e for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True) for e in compare(table.slice(a, b - a).combine_chunks())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cut = int(np.argmax((keys == keys[:, -1:]).all(0)))
            if cut or held and any(held[-1].column(c)[-1].as_py() != keys[c, -1] for c in range(3)):
                yield from closed([*held, batch.slice(0, cut)] if cut else held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from closed(held)

    return rows.repartition("region", "q", "p").sortWithinPartitions("region", "q", "p").mapInArrow(sweep, "a long, b long")


def jaccard_join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", counted: float = COUNTED, frequent: int = FREQUENT, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the least id reachable over links, the document's own included. Texts
    without words, and null ones, link with nothing. Rows with a null id link as others do; they
    have the least id reachable, and null where only such rows are. Repeated rows are each
    returned, ties (equal sets) are one node, and long texts are sets like others. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    found = materialize(_own_shingles(plain, buckets, words, counted))
    table = found.where("block is null").select("doc_id", F.col("n").alias("n_shingles"), "node", "h")
    nodes = table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("h").alias("h"), F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    own = found.where("block is not null").groupBy("node", "block").agg(F.sum("own").alias("own")).groupBy("node").agg(F.min("own").alias("own"))
    wanted = materialize(nodes.join(own, "node").where(F.col("own") * 100 <= (100 - percent) * F.col("n")).select("node", "rep", "h"))
    sets = _sets_of(wanted, plain, words)
    lists = _lists(sets, percent, frequent)
    regions, links = _regions(lists, sets, percent, depth)
    labels = materialize(connected_components(links))
    state = regions.join(labels, "node", "left").join(sets.select("node", "n"), "node").select("node", "region", "d", "n", F.coalesce("root", "node").alias("class"))
    between = connected_components(_joined(_cells(lists, materialize(state)), sets, percent, block)).select(F.col("node").alias("class"), F.col("root").alias("top"))

    classes = nodes.join(labels, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root").join(between, "class", "left").withColumn("root", F.coalesce("top", "class"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1")
    grouped = materialize(classes.join(least.drop("rows"), "root").select("node", "component_id"))
    discard(sets, lists, wanted)
    out = table.select("doc_id", "n_shingles", "node").join(grouped, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

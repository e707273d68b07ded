"""Benchmark decontamination by latent semantic retrieval.

Passages of TF-IDF weighted words are projected on the leading right singular vectors of all
corpus passages and all benchmark items, found by a randomised SVD whose products are taken over
the cluster with the matrix of word pairs that passages hold. Passages near an item by cosine are candidates. A
candidate is a leak if the longest common subsequence of the item and the text around the passage
covers most of the item, and most of the item's end, its answer, as well: so a paraphrase that
changes, drops or adds words is still found. Words of many documents weigh nothing in that
search, so all items are also searched exactly, by their rarest words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithofig.llm.shared import bound_batches, by_text, discard, give_back, in_slices, materialize, ragged, sums_between

MARKS = ".,;:!?\"'()[]{}*#$%&|"
#: Words in a passage, and from one passage to the next.
PASSAGE, STRIDE = 24, 12
RANK, OVERSAMPLE, POWER_ROUNDS, SEED = 192, 16, 2, 11
#: Rows of the matrix of word pairs that are dense at once, and distinct pairs that a task sums before it passes them on.
BLOCK, PAIRS_HELD = 64, 1 << 19
COSINE = 0.25
#: Share of a passage's squared TF-IDF norm that item words must make up.
KNOWN_MASS = 0.15
#: Shares of an item, and of its last words, that the common subsequence must cover.
COVERED, ANSWER_COVERED, ANSWER_WORDS = 0.6, 0.5, 8
#: Words in more than this share of documents weigh nothing in the latent search.
COMMON = 0.05
#: The exact search takes passages by this share of the words that a leak must cover; any share loses none.
RARE_SHARE = 0.2
#: Items of the exact search taken at a time, which bounds the places held at once.
EXACT_BLOCK = 500
#: Items searched in one pass over the corpus; more are searched in blocks of so many.
ITEM_BLOCK = 20_000
#: Passages projected at once, and cosines of passages and items held at once.
AT_ONCE, CELLS = 1000, 1 << 21
#: Features of the basis at most; with more benchmark words several share a feature by hash.
FEATURES = 1 << 16


def plain_words(texts: pa.Array, vocabulary: pa.Array | None = None) -> tuple[np.ndarray | pa.Array, np.ndarray]:
    """Words in lower case without marks at their ends (as numbers in a vocabulary, else -1), and offsets."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(texts)
    flat = pc.utf8_trim(parts.flatten(), MARKS)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.not_equal(flat, "")
    mask = keep.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(mask)])
    flat = flat.filter(keep)
    if vocabulary is None:
        return flat, before[offsets]
    return pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64), before[offsets]


@dataclass
class Keys:
    """Rare words of some items: of word ``w`` the items are ``owners[first[w]:first[w + 1]]``.

    Whoever covers enough of an item holds ``need`` or more of the item's rare words.
    """

    first: np.ndarray
    owners: np.ndarray
    need: np.ndarray


@dataclass
class Items:
    """Benchmark items of one block: their words as numbers, and what the search needs of them."""

    ids: list[int]
    vocabulary: pa.Array
    words: list[list[int]]
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    unknown: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    exact: list[Keys] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        flat, offsets = plain_words(pa.array([t for _, t in rows], pa.large_string()))
        coded = flat.dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        size = len(coded.dictionary)
        words = [numbers[offsets[i]:offsets[i + 1]].tolist() for i in range(len(rows))]
        made = cls([r[0] for r in rows], coded.dictionary, words)
        made.feature = np.arange(size) if size <= FEATURES else np.array([hash_of(w) % FEATURES for w in coded.dictionary.to_pylist()])
        return made

    @property
    def features(self) -> int:
        return min(FEATURES, max(1, len(self.vocabulary)))


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def passages(numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all passages in the words of a batch, and the text of each.

    A passage is PASSAGE words, or fewer at a text's end; the next one begins STRIDE words on.
    """
    sizes = np.diff(offsets)
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - (PASSAGE - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[text] + place * STRIDE
    return starts, np.minimum(starts + PASSAGE, offsets[text + 1]), text


def latent_rows(items: Items, matrix: np.ndarray, numbers: np.ndarray, starts: np.ndarray, stops: np.ndarray, at_once: int, least: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which passages hold weighted item words, and their products with ``matrix`` (features x columns), so many at once.

    Of a passage's squared TF-IDF norm, where words outside the benchmark count with the greatest
    weight, such words make up the share ``least`` or more.
    """
    square = np.append(items.weight, items.unknown)[numbers] ** 2
    held = numbers >= 0
    held[held] = items.weight[numbers[held]] > 0
    known = np.flatnonzero(held)
    mass = np.concatenate([[0.0], np.cumsum(square)])
    ours = np.concatenate([[0.0], np.cumsum(square[known])])
    first, last = np.searchsorted(known, starts), np.searchsorted(known, stops)
    some = np.flatnonzero((last > first) & (ours[last] - ours[first] >= least * (mass[stops] - mass[starts])))
    for begin in range(0, len(some), at_once):
        part = some[begin:begin + at_once]
        counts = last[part] - first[part]
        words = numbers[ragged(known, first[part], counts)]
        yield part, sums_between(matrix[items.feature[words]] * items.weight[words][:, None], np.concatenate([[0], np.cumsum(counts)]))


def common_subsequence(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bits of whole integers."""
    full = (1 << len(pattern)) - 1
    places: dict[int, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | (1 << i)
    v = full
    for w in text:
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def _document_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Documents that hold each benchmark word, over the whole corpus, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches):
        size = len(shared.value)
        total, n = np.zeros(size, dtype=np.int64), 0
        for batch in in_slices(batches, 0):
            numbers, offsets = plain_words(batch.column(0), shared.value)
            n += batch.num_rows
            at = np.flatnonzero(numbers >= 0)
            text = np.searchsorted(offsets, at, side="right") - 1
            total += np.bincount(np.unique(text * size + numbers[at]) % size, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    counts, n_docs = np.zeros(len(items.vocabulary)), 0
    for r in rows:
        if r.word < 0:
            n_docs = r.n
        else:
            counts[r.word] = r.n
    return counts, n_docs


def word_pairs(items: Items, numbers: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Pairs of weighted item words in the same passage, as ``lesser * words + greater``.

    Each comes as often as C'C counts it, where row i of C counts the weighted words of passage i.
    """
    held = numbers >= 0
    held[held] = items.weight[numbers[held]] > 0
    known = np.flatnonzero(held)
    first, last = np.searchsorted(known, starts), np.searchsorted(known, stops)
    places = np.arange(len(known))
    left = ragged(places, first, last - first)
    room = np.repeat(last, last - first) - left
    right, left = ragged(places, left, room), np.repeat(left, room)
    one, other = numbers[known[left]], numbers[known[right]]
    pairs = np.minimum(one, other) * len(items.vocabulary) + np.maximum(one, other)
    return np.concatenate([pairs, pairs[(one == other) & (left != right)]])


def pair_sums(items: Items, slices: Iterator[pa.Array], most: int = PAIRS_HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word pairs of all passages of all texts and their counts; a pair may come again, as ``most`` are held at once."""
    held, n = [], 0

    def merged():
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    for texts in slices:
        numbers, offsets = plain_words(texts, items.vocabulary)
        starts, stops, _ = passages(numbers, offsets)
        for begin in range(0, len(starts), AT_ONCE):
            part = slice(begin, begin + AT_ONCE)
            low, high = starts[part][0], stops[part][-1]
            held.append(np.unique(word_pairs(items, numbers[low:high], starts[part] - low, stops[part] - low), return_counts=True))
            n += len(held[-1][0])
            if n > most:
                held = [merged()]
                n = len(held[0][0])
                if n > most // 2:
                    yield held[0]
                    held, n = [], 0
    if n:
        yield merged()


def _pair_matrix(docs: DataFrame, items: Items) -> DataFrame:
    """A'A for the passages of all of ``docs``, written by blocks of rows: block, cell in the block and value."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        for pairs, counts in pair_sums(shared.value, (b.column(0) for b in in_slices(batches, 0))):
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(counts)], names=["pair", "n"])

    def spread(batches):
        items = shared.value
        for batch in batches:
            one, other = np.divmod(batch.column(0).to_numpy(), len(items.vocabulary))
            value = batch.column(1).to_numpy() * items.weight[one] * items.weight[other]
            apart = one != other
            rows = items.feature[np.concatenate([one, other[apart]])]
            cells = rows % BLOCK * items.features + items.feature[np.concatenate([other, one[apart]])]
            yield pa.RecordBatch.from_arrays([pa.array(rows // BLOCK), pa.array(cells), pa.array(np.concatenate([value, value[apart]]))], names=["at", "cell", "value"])

    pairs = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    made = materialize(pairs.mapInArrow(spread, "at long, cell long, value double").repartition("at").sortWithinPartitions("at"))
    shared.destroy()
    return made


def _summed_products(pairs: DataFrame, items: Items, matrix: np.ndarray) -> np.ndarray:
    """A'(A matrix), a block of rows of A'A at a time."""
    shared = pairs.sparkSession.sparkContext.broadcast(matrix)

    def multiply(batches):
        matrix = shared.value
        at, dense = -1, np.zeros((BLOCK, len(matrix)))

        def product():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([(dense @ matrix).tobytes()], pa.binary())], names=["at", "part"])

        for batch in batches:
            blocks, cells, values = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if begin < end and blocks[begin] != at:
                    if at >= 0:
                        yield product()
                    at, dense[:] = int(blocks[begin]), 0.0
                np.add.at(dense.reshape(-1), cells[begin:end], values[begin:end])
        if at >= 0:
            yield product()

    parts = pairs.mapInArrow(multiply, "at long, part binary").collect()
    shared.destroy()
    out = np.zeros((-(-items.features // BLOCK) * BLOCK, matrix.shape[1]))
    # a block that lies in several files or splits comes in parts
    for r in sorted(parts):
        out[r["at"] * BLOCK:(r["at"] + 1) * BLOCK] += np.frombuffer(r.part).reshape(BLOCK, -1)
    return out[:items.features]


def _add_back(items: Items, total: np.ndarray, numbers: np.ndarray, starts: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> None:
    """Add A'rows, where row i of A is the passage [starts[i], stops[i])."""
    sizes = stops - starts
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    owner, words = np.repeat(np.arange(len(starts)), sizes), numbers[at]
    keep = words >= 0
    keep[keep] = items.weight[words[keep]] > 0
    words, owner = words[keep], owner[keep]
    np.add.at(total, items.feature[words], rows[owner] * items.weight[words][:, None])


def exact_keys(items: Items, counts: np.ndarray) -> list[Keys]:
    """Keys of all items, in blocks.

    Of an item's words at most ``spare`` need not be covered, so of any ``spare + need`` of them
    ``need`` are: the rarest are taken, as fewer texts hold these.
    """
    blocks = []
    for begin in range(0, len(items.words), EXACT_BLOCK):
        words, owners, need = [], [], np.zeros(len(items.words), np.int64)
        for j, pattern in enumerate(items.words[begin:begin + EXACT_BLOCK], begin):
            least = math.ceil(COVERED * len(pattern) - 1e-9)
            need[j] = math.ceil(RARE_SHARE * least)
            rare = set(sorted(pattern, key=lambda w: (counts[w], w))[:len(pattern) - least + need[j]])
            words += rare
            owners += [j] * len(rare)
        order = np.argsort(words, kind="stable")
        first = np.searchsorted(np.array(words)[order], np.arange(len(items.vocabulary) + 1))
        blocks.append(Keys(first, np.array(owners)[order], need))
    return blocks


def fit_items(docs: DataFrame, rows: list[tuple[int, str]]) -> Items:
    """Weights from counts over all of ``docs``; the basis from items and all passages of ``docs``."""
    items = Items.of(rows)
    counts, n = _document_counts(docs, items)
    idf = np.log((1 + n) / (1 + counts)) + 1
    items.weight = np.where(counts > COMMON * max(n, 1), 0.0, idf)
    if not items.weight.any():
        items.weight = idf
    items.unknown = math.log(1 + n) + 1
    items.exact = exact_keys(items, counts)
    rng = np.random.default_rng(SEED)
    width = min(RANK + OVERSAMPLE, items.features)
    pairs = _pair_matrix(docs, items)
    flat = np.array([w for words in items.words for w in words], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in items.words])]).astype(np.int64)
    step = rng.standard_normal((items.features, width))
    for _ in range(POWER_ROUNDS):
        step = np.linalg.qr(step)[0]
        total = _summed_products(pairs, items, step)
        for some, own in latent_rows(items, step, flat, bounds[:-1], bounds[1:], AT_ONCE):
            _add_back(items, total, flat, bounds[:-1][some], bounds[1:][some], own)
        step = total
    discard(pairs)
    give_back()
    q, r = np.linalg.qr(step)
    left, _, _ = np.linalg.svd(r)
    items.basis = (q @ left)[:, :RANK]
    items.latent = np.zeros((len(items.ids), items.basis.shape[1]))
    for some, own in latent_rows(items, items.basis, flat, bounds[:-1], bounds[1:], AT_ONCE):
        items.latent[some] = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    return items


def covered_share(pattern: list[int], around: list[int]) -> float:
    """Share of an item that a text covers, or 0 if it is no leak."""
    share = common_subsequence(pattern, around) / len(pattern)
    answer = pattern[-ANSWER_WORDS:]
    return share if share >= COVERED and common_subsequence(answer, around) >= ANSWER_COVERED * len(answer) else 0.0


def rare_places(keys: Keys, numbers: np.ndarray, offsets: np.ndarray):
    """Texts that hold enough rare words of an item: text, item and the places of these words."""
    places = np.flatnonzero(numbers >= 0)
    counts = np.diff(keys.first)[numbers[places]]
    places, counts = places[counts > 0], counts[counts > 0]
    at = np.arange(counts.sum()) + np.repeat(keys.first[numbers[places]] - (np.cumsum(counts) - counts), counts)
    places = np.repeat(places, counts)
    pairs = (np.searchsorted(offsets, places, side="right") - 1) * len(keys.need) + keys.owners[at]
    order = np.argsort(pairs, kind="stable")
    places = places[order]
    found, first, sizes = np.unique(pairs[order], return_index=True, return_counts=True)
    for k in np.flatnonzero(sizes >= keys.need[found % len(keys.need)]):
        doc, j = divmod(int(found[k]), len(keys.need))
        yield doc, j, places[first[k]:first[k] + sizes[k]]


def leaks_in(items: Items, texts: pa.Array) -> tuple[list[list[int]], np.ndarray]:
    """Items that each text leaks (ids, sorted) and the greatest share of an item that it covers."""
    numbers, offsets = plain_words(texts, items.vocabulary)
    found: list[dict[int, float]] = [{} for _ in range(len(texts))]
    starts, stops, text = passages(numbers, offsets)

    def bounds(doc, j, p):
        reach = len(items.words[j]) + len(items.words[j]) // 4
        return np.maximum(offsets[doc], starts[p] - reach), np.minimum(offsets[doc + 1], stops[p] + reach)

    def judge(doc, j, begin, end):
        if found[doc].get(j, 0) < 1.0:
            share = covered_share(items.words[j], numbers[begin:end].tolist())
            if share:
                found[doc][j] = max(found[doc].get(j, 0), share)

    for some, rows in latent_rows(items, items.basis, numbers, starts, stops, max(16, min(AT_ONCE, CELLS // len(items.ids))), KNOWN_MASS):
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        near = rows @ items.latent.T
        for i, j in zip(*np.nonzero(near >= COSINE), strict=True):
            p = some[i]
            judge(int(text[p]), j, *bounds(text[p], j, p))
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    for keys in items.exact:
        for doc, j, places in rare_places(keys, numbers, offsets):
            begins, ends = bounds(doc, j, np.arange(first[doc], first[doc + 1]))
            enough = np.searchsorted(places, ends) - np.searchsorted(places, begins) >= keys.need[j]
            for begin, end in zip(begins[enough].tolist(), ends[enough].tolist(), strict=True):
                judge(doc, j, begin, end)
    return [sorted(items.ids[j] for j in f) for f in found], np.array([max(f.values(), default=0.0) for f in found])


def leak_verdict(text: Column, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_block: int = ITEM_BLOCK) -> Column:
    """The items that each text leaks and the share it covers, as a column ``struct<items, overlap>``; fitted on ``docs``."""
    spark = bound_batches(docs.sparkSession)
    usable = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(item_col, item_text)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks, rows = [], []
    for r in usable.orderBy(item_col, item_text).toLocalIterator():
        if len(plain_words(pa.array([r[1]], pa.large_string()))[0]):
            rows.append((r[0], r[1]))
        if len(rows) == item_block:
            blocks.append(spark.sparkContext.broadcast(fit_items(plain, rows)))
            rows = []
    if rows:
        blocks.append(spark.sparkContext.broadcast(fit_items(plain, rows)))

    def search(texts: pa.Array) -> pa.Array:
        ids: list[list[int]] = [[] for _ in range(len(texts))]
        overlap = np.zeros(len(texts))
        for block in blocks:
            more, share = leaks_in(block.value, texts)
            ids = [sorted({*a, *b}) for a, b in zip(ids, more, strict=True)]
            overlap = np.maximum(overlap, share)
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(overlap)], names=["items", "overlap"])

    return by_text(search, "items array<bigint>, overlap double")(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """(id, ``items`` (ids of leaked items, sorted), ``overlap``, ``contaminated``), a row for each row of ``docs``.

    Whole texts are searched, however long. Items that are null or without a word, and items
    without an id, can't leak; null and empty texts leak nothing. Repeated documents are each
    returned, items that tie are all named; an empty corpus or benchmark is no error. Other
    columns are ignored, whatever their names.
    """
    verdict = leak_verdict(F.col(text_col), docs, benchmark, id_col, text_col, item_col, item_text, item_block)
    found = docs.select(id_col, verdict.alias("found"))
    return found.select(id_col, "found.items", "found.overlap", (F.size("found.items") > 0).alias("contaminated"))

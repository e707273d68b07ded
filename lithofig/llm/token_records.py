"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A shard is a header (``MAGIC``, one byte with the width of an id) and one record per document:

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload

in little-endian order. The payload is a flag byte (1: the document has an id), the document id
as int64 and the token ids as unsigned integers of the shard's width. The index beside it
(``.idx``) holds one ``int64 id, uint64 offset`` pair per record, so that a shuffled reader can
fetch single records. Checksums are CRC-32, rotated by 15 bits and shifted by a constant, so that
a checksum over data that holds checksums does not degenerate.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithofig.llm.shared import bound_batches, in_slices, open_store, ragged, shared_folder, words_of

MAGIC = b"LITHOREC"
MASK_DELTA = 0xA282EAD8
#: Bytes of text encoded at once, and pieces that an encoder remembers.
AT_ONCE, CACHED_PIECES = 4 << 20, 250_000
HEAD, FOOT = "<QI", "<I"
HEAD_SIZE, FOOT_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOT)

#: In words of printable ASCII and Latin-1 letters the vocabulary's own splitting rule reads so.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Texts on which an encoder compares its shortcuts with the whole tokenizer.
PROBES = [
    "The quick brown fox's dog can't jump, they've said; I'm sure you'll agree we're done.",
    "CamelCase snake_case 12345 3.14 a1b2 x=y+z (foo)[bar]{baz} <tag/> #tag @me 50% a&b ~!^* `q`",
    "  two  spaces\tand\na line\r\nend ",
    "Ärger über Größe naïve façade ÀÖØÝÞ ßæçèéêëìíîïðñòóôõöøùúûüýþÿ don't DON'T it'S 'd'll",
    " ".join(chr(c) for c in range(33, 127)) + " " + " ".join(f"a{chr(c)}B{chr(c)}{chr(c)}1" for c in range(33, 127)),
]
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


class WordEncoder:
    """Encodes batches of whole texts with a vocabulary that never joins text across white space.

    Each distinct word of a batch is encoded once. Words of plain letters and signs go through the
    tokenizer's model piece by piece (pieces are remembered up to a bound); all others go through
    the whole tokenizer. Both shortcuts are tried on PROBES at the start, and a vocabulary that
    splits or joins in another way is used without them: word by word, or on whole texts.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        accents = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.bytewise = {ord(c): level.pre_tokenize_str(c)[0][0] for c in accents}
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.pieces: dict[str, list[int]] = {}
        self.cached = cached
        alone = {w: self._whole(w) for text in PROBES for w in text.split()}
        self.by_word = all(self._whole(text) == [i for w in text.split() for i in alone[w]] for text in PROBES)
        self.by_piece = True
        try:
            self.by_piece = all(self.word(w) == ids for w, ids in alone.items())
        except Exception:  # noqa: BLE001  the model may know no such piece
            self.by_piece = False
        self.pieces.clear()

    def _whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        if not self.by_piece:
            return self._whole(word)
        if word.isascii() and word.isalpha():
            found = (word.lower(),)
        elif SIMPLE.fullmatch(word):
            found = PIECES.findall(word.lower())
        else:
            return self._whole(word)
        if self.special.search(word):
            return self._whole(word)
        out: list[int] = []
        for piece in found:
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= self.cached:
                    self.pieces.clear()
                text = piece if piece.isascii() else piece.translate(self.bytewise)
                ids = self.pieces[piece] = [t.id for t in self.model.tokenize(text)]
            out += ids
        return out

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the offsets of the texts in them."""
        if not self.by_word:
            each = [[*self._whole(t or ""), end_id] for t in texts.to_pylist()]
            return np.array([i for ids in each for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in each])]).astype(np.int64)
        codes, offsets, words = words_of(texts)
        flat: list[int] = []
        sizes = np.zeros(len(words) + 1, dtype=np.int64)
        for i, word in enumerate(words.to_pylist()):
            ids = self.pieces.get(word) or self.word(word)  # a word that is a piece splits no further
            flat += ids
            sizes[i] = len(ids)
        flat.append(end_id)
        sizes[-1] = 1
        ends = np.insert(codes.astype(np.int64), offsets[1:], len(words))
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[ends]
        ids = ragged(np.asarray(flat, dtype=np.uint32), starts[ends], lengths)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[offsets + np.arange(len(offsets))]


@lru_cache(maxsize=1)
def encoder(path: str, cached: int = CACHED_PIECES) -> WordEncoder:
    return WordEncoder(path, cached)


MANIFEST = T.StructType([
    T.StructField("shard", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("n_records", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
])
RECORDS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("shard", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def write_token_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", at_once: int = AT_ONCE, cached: int = CACHED_PIECES) -> DataFrame:
    """Encode whole texts and write shards to ``folder`` in ascending id order.

    Rows are dealt out by ranges of the id and each task writes one shard and its index under a
    name of its own first, then renames it: a task that runs twice leaves one whole shard. A null
    text counts as empty, a null id sorts first, rows with equal ids stand in the order of a hash
    of their texts, so that one id with very many texts is spread over shards as well. Very long
    texts make long records; other columns are ignored. Returns the manifest, one row per shard.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = chosen.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        shard, enc = TaskContext.get().partitionId(), encoder(vocabulary, cached)
        name, own = f"{base}/shard-{shard:07d}", f"{base}/.{uuid.uuid4().hex}"
        kind, records, tokens, at, index = f"<u{enc.width}", 0, 0, 0, []
        sink = None
        for batch in in_slices(batches, 1, at_once):
            if sink is None:
                sink = store.open_output_stream(own)
                sink.write(MAGIC + bytes([enc.width]))
                at = len(MAGIC) + 1
            ids, offsets = enc.batch(batch.column(1), end_id)
            raw, cut = ids.astype(kind).tobytes(), (offsets * enc.width).tolist()
            out = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                payload = struct.pack("<Bq", doc is not None, doc or 0) + raw[cut[i]:cut[i + 1]]
                length = struct.pack("<Q", len(payload))
                out += [length, struct.pack(FOOT, masked_crc(length)), payload, struct.pack(FOOT, masked_crc(payload))]
                index.append(struct.pack("<qQ", doc or 0, at))
                at += HEAD_SIZE + len(payload) + FOOT_SIZE
            sink.write(b"".join(out))
            records, tokens = records + batch.num_rows, tokens + len(ids)
        if sink is None:
            return
        sink.close()
        with store.open_output_stream(own + ".idx") as side:
            side.write(b"".join(index))
        store.move(own + ".idx", name + ".idx")
        store.move(own, name + ".rec")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_records": [records], "n_tokens": [tokens]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))

    return ordered.mapInArrow(write, MANIFEST)


def records_in(stream, width: int) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Offset, document id and token ids of every record from the header's end on; checks both checksums."""
    at = len(MAGIC) + 1
    while head := stream.read(HEAD_SIZE):
        length, check = struct.unpack(HEAD, head)
        if masked_crc(head[:8]) != check:
            raise ValueError(f"damaged length at {at}")
        payload, foot = stream.read(length), stream.read(FOOT_SIZE)
        if len(payload) != length or struct.unpack(FOOT, foot)[0] != masked_crc(payload):
            raise ValueError(f"damaged record at {at}")
        known, doc = struct.unpack_from("<Bq", payload)
        yield at, doc if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=9)
        at += HEAD_SIZE + length + FOOT_SIZE


def _opened(store, path: str):
    stream = store.open_input_stream(path, buffer_size=1 << 20)
    head = stream.read(len(MAGIC) + 1)
    if head[:-1] != MAGIC:
        raise ValueError(f"{path} holds no token records")
    return stream, head[-1]


def read_record(folder: str, shard: int, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in a shard, found through the index: for shuffled reads."""
    store, base = open_store(folder)
    name = f"{base}/shard-{shard:07d}"
    with store.open_input_file(name + ".idx") as side:
        offset = struct.unpack("<qQ", side.read_at(16, 16 * number))[1]
    with store.open_input_file(name + ".rec") as file:
        width = file.read_at(1, len(MAGIC))[0]
        length, check = struct.unpack(HEAD, file.read_at(HEAD_SIZE, offset))
        payload = file.read_at(length, offset + HEAD_SIZE)
        crc = struct.unpack(FOOT, file.read_at(FOOT_SIZE, offset + HEAD_SIZE + length))[0]
    if masked_crc(struct.pack("<Q", length)) != check or masked_crc(payload) != crc:
        raise ValueError(f"damaged record at {offset}")
    known, doc = struct.unpack_from("<Bq", payload)
    return doc if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=9)


def read_token_records(spark: SparkSession, folder: str, shards: list[tuple[int, int]]) -> DataFrame:
    """Read shards back, one task each: ``shards`` holds (shard, ids in all shards before it).

    Returns per record its document id, the number of ids before it, its own number of ids, the
    CRC-32 of its ids as little-endian uint32, its shard and offset.
    """
    listed = spark.createDataFrame(shards, "shard long, base long").repartition(max(1, len(shards)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        kind = pa.schema([(f.name, pa.int64()) for f in RECORDS.fields])
        for batch in batches:
            for row in batch.to_pylist():
                shard, start, out = row["shard"], row["base"], []
                stream, width = _opened(store, f"{base}/shard-{shard:07d}.rec")
                with stream:
                    for at, doc, ids in records_in(stream, width):
                        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, at))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kind)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kind)

    return listed.mapInArrow(read, RECORDS)


def token_records(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, at_once: int = AT_ONCE, cached: int = CACHED_PIECES) -> DataFrame:
    """Write ``docs`` as token records and describe each record as it is read back.

    An empty table gives no shard and an empty result. ``at_once`` (bytes of text) and ``cached``
    (pieces remembered) trade a worker's memory for its time.
    """
    spark = bound_batches(docs.sparkSession)
    folder = folder or shared_folder(spark)
    manifest = sorted(write_token_records(docs, folder, vocabulary, end_id, at_once=at_once, cached=cached).collect())  # a row for each shard
    shards, before = [], 0
    for row in manifest:
        shards.append((row.shard, before))
        before += row.n_tokens
    return read_token_records(spark, folder, shards)

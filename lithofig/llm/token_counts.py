"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole, by a byte-level vocabulary. Tokens of such a vocabulary
tile the text, so running sums of their byte lengths give their character spans. The spans meet
the sections in an interval join of sorted bounds.

A token that crosses a section bound counts for the section that holds most of its characters,
and of equal ones for the earlier. A token of a part of a character counts for that character.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The encoding of a rank file, and the byte length of each token."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a text in characters."""
    enc, lengths = encoding(path, pattern)
    ids = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(lengths[ids])
    data = text.encode()
    if len(data) == len(text):
        return ends - lengths[ids], ends
    begun = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    starts, stops = begun[ends - lengths[ids]], begun[ends]
    return np.where(stops > starts, starts, starts - 1), np.maximum(stops, starts)


def allocate(starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens per section, where section i is [bounds[i], bounds[i + 1]) and sections tile the text."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, stops - 1, side="right") - 1
    for k in np.flatnonzero(first != last):
        i, j = int(first[k]), int(last[k])
        shares = [min(stops[k], bounds[s + 1]) - max(starts[k], bounds[s]) for s in range(i, j + 1)]
        first[k] = i + int(np.argmax(shares))
    return np.bincount(first, minlength=len(bounds) - 1)


def line_bounds(text: str) -> np.ndarray:
    """Sections are lines, each with its line end."""
    ends, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*ends, len(text)], dtype=np.int64)


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", bounds_of=line_bounds) -> DataFrame:
    """One row per section: ``doc_id, section, start, stop, n_tokens, doc_tokens``.

    Starts and stops are in characters; a document's sections tile it and their counts sum to the
    whole document's tokens. A null or empty text is one empty section without tokens. Repeated
    rows are each returned; an empty table gives an empty result; other columns are ignored.
    """

    def count(batches):
        names = ["doc_id", "section", "start", "stop", "n_tokens", "doc_tokens"]
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bounds = bounds_of(text or "")
                starts, stops = token_spans(text or "", ranks_path, pattern)
                found = allocate(starts, stops, bounds)
                n = len(found)
                parts.append((pa.array([doc] * n, pa.int64()), np.arange(n), bounds[:-1], bounds[1:], found, np.full(n, len(starts))))
                if len(parts) == 2000:
                    yield joined(names, parts)
                    parts = []
            if parts:
                yield joined(names, parts)

    def joined(names, parts):
        docs_of, *rest = zip(*parts, strict=True)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(docs_of), *[pa.array(np.concatenate(c).astype(np.int64)) for c in rest]], names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(count, "doc_id long, section long, start long, stop long, n_tokens long, doc_tokens long")

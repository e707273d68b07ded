"""Language identification by word-first backoff.

Known words score by their log frequency in each language; an unseen word falls back to the
longest character n-grams that the model knows, from ``LONGEST`` characters down to one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithofig.llm.shared import bound_batches, by_text, sums_between, words_of

LETTERS = re.compile(r"[^\W\d_]+")
#: The model is fitted on about so many labelled rows for each language, and so many in all.
SAMPLE_PER_LANGUAGE, SAMPLE = 600, 60_000
LONGEST = 4
#: An unseen word counts as this share of a known one.
BACKOFF_WEIGHT = 0.5


def gram_keys(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row of code points."""
    keys = np.zeros(len(codes), dtype=np.uint64)
    for column in codes.T:
        keys = keys * np.uint64(0x10FFFF * 3 + 2) + column
    return keys


class LanguageModel:
    """Word and n-gram scores; rows of ``scores`` are log shares of each language, centred."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        self.languages = sorted({lang for lang, _ in texts})
        words = {lang: Counter() for lang in self.languages}
        grams = {lang: Counter() for lang in self.languages}
        for lang, text in texts:
            words[lang].update(w.lower() for w in LETTERS.findall(text))
        for lang, counts in words.items():
            for word, n in counts.items():
                for gram in self.grams_of(word):
                    grams[lang][gram] += min(n, 20)
        total = Counter()
        for counts in words.values():
            total.update(counts)
        words_kept = sorted(w for w, n in total.items() if n > 1)
        grams_kept = sorted({g for counts in grams.values() for g, n in counts.items() if n > 1 or len(g) == 1})
        self.words = {w: i for i, w in enumerate(words_kept)}
        self.scores = self._scores(words, words_kept)
        table = self._scores(grams, grams_kept)
        self.grams = []
        for n in range(1, LONGEST + 1):
            at = [i for i, g in enumerate(grams_kept) if len(g) == n]
            keys = gram_keys(np.array([[ord(c) for c in grams_kept[i]] for i in at], dtype=np.uint64).reshape(len(at), n))
            order = np.argsort(keys)
            self.grams.append((keys[order], table[at][order]))

    def _scores(self, counts: dict[str, Counter], names: list[str]) -> np.ndarray:
        table = np.array([[counts[lang][x] for lang in self.languages] for x in names], dtype=np.float64).reshape(len(names), len(self.languages))
        logs = np.log(table + 0.5) - np.log(table.sum(0) + 0.5 * max(1, len(names)))
        return logs - logs.mean(1, keepdims=True)

    @staticmethod
    def grams_of(word: str):
        padded = f"<{word}>"
        for n in range(1, LONGEST + 1):
            for i in range(len(padded) - n + 1):
                yield padded[i:i + n]

    def backoff(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: at every position the longest known n-gram that begins there.

        These weigh ``BACKOFF_WEIGHT`` together, whatever their number.
        """
        width = len(self.languages)
        if not words:
            return np.zeros((0, width))
        codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        values, open_ = np.zeros((len(codes), width)), np.ones(len(codes), dtype=bool)
        for n in range(LONGEST, 0, -1):
            keys, table = self.grams[n - 1]
            at = np.flatnonzero(open_ & (left >= n))
            if not len(at) or not len(keys):
                continue
            wanted = gram_keys(codes[at[:, None] + np.arange(n)])
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[place] == wanted
            values[at[hit]] = table[place[hit]]
            open_[at[hit]] = False
        starts = np.concatenate([[0], ends])
        found = sums_between((~open_).astype(np.float64), starts)
        return BACKOFF_WEIGHT * sums_between(values, starts) / np.maximum(found, 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        codes, offsets, tokens = words_of(texts)
        known, seen_at, unseen, unseen_at = [], [], [], []
        letters = np.zeros(len(tokens))
        rows, split = self.words, LETTERS.findall
        for i, token in enumerate(pc.utf8_lower(tokens).to_pylist()):
            found = (token,) if token.isalpha() else split(token)
            letters[i] = len(found)
            for word in found:
                row = rows.get(word)
                if row is None:
                    unseen.append(word)
                    unseen_at.append(i)
                else:
                    known.append(row)
                    seen_at.append(i)
        parts = np.concatenate([self.scores[np.array(known, dtype=np.int64)], self.backoff(unseen)])
        at = np.array(seen_at + unseen_at, dtype=np.int64)
        matrix = np.stack([np.bincount(at, parts[:, k], len(tokens)) for k in range(len(self.languages))], 1)
        sums, counts = sums_between(matrix[codes], offsets), sums_between(letters[codes], offsets)
        mean = sums / np.maximum(counts, 1)[:, None] * np.minimum(counts, 25)[:, None]
        shares = np.exp(mean - mean.max(1, keepdims=True))
        shares /= shares.sum(1, keepdims=True)
        best = shares.argmax(1)
        names = [self.languages[b] if n else "und" for b, n in zip(best, counts, strict=True)]
        return names, np.where(counts > 0, shares.max(1), 0.0)


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> LanguageModel | None:
    """Fit on a bounded sample of the rows of ``labelled`` whose language is known; None without any.

    Every language that occurs is learned, from about ``per_language`` different rows, or from
    fewer where so many languages would pass ``most`` rows together. Rows are drawn by a hash of
    id and text, in one pass, and only those drawn go to the driver. Rows that repeat id, text and
    language count once.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return None
    wanted, span = max(1, min(per_language, most // len(counts))), float(1 << 62)
    plan = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, wanted / r["n"]) * span)) for r in counts], T.StructType([T.StructField("lang", known.schema["lang"].dataType), T.StructField("below", T.LongType())]))
    place = F.shiftrightunsigned("h", 2)
    drawn = known.join(F.broadcast(plan), "lang").where(place < F.col("below"))
    rows = drawn.dropDuplicates(["lang", "h"]).select("lang", "h", "text").collect()
    sample = {(str(r["lang"]), r["h"], r["text"]): (r["lang"], r["text"]) for r in rows}
    missed = {r["lang"] for r in counts} - {r["lang"] for r in rows}
    if missed:  # of so few draws that none fell on a row: the row with the least hash
        for r in known.where(F.col("lang").isin(list(missed))).groupBy("lang").agg(F.min(F.struct(place.alias("p"), "text")).alias("m")).collect():
            sample[str(r["lang"]), r["m"]["p"], r["m"]["text"]] = (r["lang"], r["m"]["text"])
    return LanguageModel([sample[k] for k in sorted(sample)])


def identify_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score`` (0 to 1) instead.

    ``und`` with score 0 stands for texts that are null or hold no letter, and for all texts if
    there is no model. Ties go to the first language by code point. Whole texts are read, however
    long; repeated rows are each returned, and an empty table gives an empty result. Other columns
    pass through, but ones that are named as a result are replaced by it.
    """
    shared = bound_batches(docs.sparkSession).sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def predict(texts: pa.Array) -> pa.Array:
        if shared.value is None or not len(texts):
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
        else:
            names, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    said = docs.select(*others, by_text(predict, "lang_pred string, score double")(F.col(text_col)).alias("__said"))
    return said.select(*others, "__said.lang_pred", "__said.score")

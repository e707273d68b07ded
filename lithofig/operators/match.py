"""Matching captions to figures, enrichment, counts and keywords."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lithofig.functions.rules import clean_for_embeddings, gate_tags, normalize_caption, once, qubit_count, rx, sentences, strip


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of two texts; 1 if both are empty."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def compare_captions(a: Column, b: Column, threshold: float = 0.8) -> Column:
    score = ratio(normalize_caption(a), normalize_caption(b))
    return F.struct((score >= threshold).alias("similar"), score.alias("score"))


def match_figures(captions: DataFrame, figures: DataFrame, threshold: float = 0.5, key: str = "paper_id") -> DataFrame:
    """For each caption the first figure of its paper, in figure order, that is similar enough.

    An empty caption on either side matches nothing; unmatched captions keep null figures.
    """
    first = lambda c: F.try_element_at(sentences(c), F.lit(1))
    left = captions.withColumn("a", first(F.col("caption")))
    right = figures.select(key, "fig_ord", "figure_number", "page_number", first(clean_for_embeddings(F.col("caption"))).alias("b"))
    pairs = left.select(key, "cap_idx", "a").join(right, key)
    pairs = pairs.withColumns({"a": normalize_caption(F.col("a")), "b": normalize_caption(F.col("b"))})
    # twice the shorter length over both bounds the ratio, which takes the figure's text first
    short, both = F.least(F.length("a"), F.length("b")), F.length("a") + F.length("b")
    pairs = pairs.where((both == 0) | (2 * short >= threshold * both)).withColumn("score", ratio(F.col("b"), F.col("a")))
    near = pairs.where(F.col("score") >= threshold).groupBy(key, "cap_idx").agg(F.min(F.struct("fig_ord", "figure_number", "page_number", "score")).alias("f"))
    return left.drop("a").join(near, [key, "cap_idx"], "left").select(*captions.columns, "f.figure_number", "f.page_number", F.col("f.score").alias("match_score"))


# The words that spoil an answer.
SPOILERS = ["gate", "qubit", "circuit", "wire", "line", "diagram"]


def best_answers(answers: DataFrame, key: str = "record_id") -> DataFrame:
    """Per record the best usable answer: (key, algorithm, score). ``answers`` has q_ord, answer and score.

    Answers of over five words are passed over before the best is taken.
    """
    low, short = F.lower("answer"), F.size(F.split(strip(F.col("answer")), rx(r"\s+"))) <= 5
    fine = F.col("score") > 0.1
    for word in SPOILERS:
        fine &= ~F.contains(low, F.lit(word))
    best = answers.where((F.col("score") > 0) & short).groupBy(key).agg(F.max_by(F.struct("answer", "score"), F.struct("score", -F.col("q_ord"))).alias("b")).select(key, "b.*")
    return best.select(key, F.when(fine, F.col("answer")).alias("algorithm"), "score")


# The questions that name an algorithm, in order, and the one that counts qubits.
QUESTIONS = ["What is the name of the protocol?", "What is the name of the quantum algorithm?", "Which quantum ansatz is used?", "What acronym is mentioned?"]
QUBIT_QUESTION = "How many qubits?"


def ask(records: DataFrame, provider, key: str = "image_key", context: str = "context") -> DataFrame:
    """(key, q_ord, answer, score) of all questions: ``provider`` maps Arrow arrays of questions and contexts to a struct array (answer, score).

    The last question, of ``q_ord`` len(QUESTIONS), counts qubits.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kind = StructType([StructField("answer", StringType()), StructField("score", DoubleType())])

    def answered(question: pa.Array, text: pa.Array) -> pa.Array:
        return provider(question, text)

    rows = records.select(key, context, F.posexplode(F.array(*[F.lit(q) for q in [*QUESTIONS, QUBIT_QUESTION]])).alias("q_ord", "question"))
    return rows.withColumn("a", F.arrow_udf(answered, kind)("question", context)).select(key, "q_ord", "a.answer", "a.score")


def counted_qubits(answers: DataFrame, key: str = "image_key") -> DataFrame:
    """(key, asked): answers to the qubit question that are trusted, short and hold a digit."""
    fine = (F.col("q_ord") == len(QUESTIONS)) & (F.col("score") > 0.1) & (F.length("answer") < 5) & F.col("answer").rlike(rx(r"\d"))
    return answers.where(fine).groupBy(key).agg(F.max_by("answer", "score").alias("asked"))


def enrich(records: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Records with gates, qubits and the algorithm of their joined description.

    ``answers``, as from ``ask``, also give the qubits where the text names no number.
    """
    text = F.array_join("description", " ")
    out = records.withColumns({"gates": gate_tags(text), "qubits": qubit_count(text)})
    if answers is None:
        return out.withColumn("algorithm", F.lit(None).cast("string"))
    out = out.join(best_answers(answers.where(F.col("q_ord") < len(QUESTIONS)), "image_key").select("image_key", "algorithm"), "image_key", "left")
    return out.join(counted_qubits(answers), "image_key", "left").withColumn("qubits", F.coalesce("qubits", "asked")).drop("asked")


def images_per_paper(records: DataFrame, papers: DataFrame, processed: DataFrame) -> DataFrame:
    """(paper_id, No_Img): processed papers with their number of images, all others null."""
    counts = records.groupBy(F.col("arxiv_id").alias("paper_id")).agg(F.count("*").alias("n"))
    done = processed.select("paper_id").distinct().withColumn("done", F.lit(True))
    return papers.join(done, "paper_id", "left").join(counts, "paper_id", "left").select("paper_id", F.when(F.col("done"), F.coalesce("n", F.lit(0))).alias("No_Img"))


def cap_batch(counts: DataFrame, cap: int = 250, mode: str = "equal", slices: int = 64) -> DataFrame:
    """Papers up to the first at which the running number of images is the cap (``gte``: reaches it).

    ``counts`` has ord and n. Running totals are taken in slices of the order, whose own totals
    are summed first, so that no task holds all papers.
    """
    low, high = counts.agg(F.min("ord"), F.max("ord")).first()
    if low is None:
        return counts.withColumn("running", F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // slices))
    cut = counts.withColumn("slice", F.floor((F.col("ord") - low) / width))
    totals = cut.groupBy("slice").agg(F.sum("n").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = cut.join(F.broadcast(before.select("slice", "before")), "slice").withColumn("running", F.col("before") + F.sum("n").over(Window.partitionBy("slice").orderBy("ord")))
    hit = F.col("running") == cap if mode == "equal" else F.col("running") >= cap
    end = running.where(hit).agg(F.min("ord").alias("end"))
    return running.join(F.broadcast(end)).where(F.col("end").isNull() | (F.col("ord") <= F.col("end"))).select(*counts.columns, "running")


# Single terms that weigh more, and words that mark a multi-word term.
STRONG_TERMS, TOPIC_WORDS = ["qiskit", "cirq", "ansatz", "unitary", "qubit"], ["quantum", "circuit"]


def term_boost(term: Column) -> Column:
    words = F.size(F.split(term, " "))
    topic = F.contains(term, F.lit(TOPIC_WORDS[0])) | F.contains(term, F.lit(TOPIC_WORDS[1]))
    return F.when(term.isin(*STRONG_TERMS), 0.15).when(words == 1, 0.05).when(topic, 0.10).otherwise(0.15)


#: Words that n-grams are sought from are named to the tasks up to so many; beyond, all n-grams are counted.
FEW_WORDS = 2000


def _counted(rows: DataFrame) -> DataFrame:
    """(term, cnt, lines) of the arrays ``w``. A line is one row: its terms are sorted and counted in place, and shuffled once, by term."""
    ends = lambda g, i: F.coalesce((F.get(g, i + 1) != F.get(g, i)).cast("long"), F.lit(1).cast("long"))
    ordered = once(F.sort_array("w"), lambda g: F.transform(g, lambda x, i: F.struct(x.alias("term"), ends(g, i).alias("last"))))
    return rows.select(F.inline(ordered)).groupBy("term").agg(F.count("*").alias("cnt"), F.sum("last").alias("lines"))


def _grams(n: int) -> Column:
    """n-grams of the array ``w``; those across a null are none."""
    starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
    parts = F.transform(starts, lambda i: F.slice("w", i, n))
    whole = F.filter(parts, lambda g: ~F.exists(g, lambda x: x.isNull()))
    return F.when(F.size("w") >= n, F.transform(whole, lambda g: F.array_join(g, " "))).otherwise(F.array().cast("array<string>"))


def top_keywords(lines: DataFrame, stop_words: list[str] | None = None, top: int = 50, longest: int = 3, least: int = 2, key: str = "line_id", text: str = "text") -> DataFrame:
    """The most frequent n-grams that ``least`` lines or more hold: (term, cnt, boost). Stop words go first.

    Without a list the English one that comes with Spark is taken.
    """
    if stop_words is None:
        from pyspark.ml.feature import StopWordsRemover

        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*stop_words) if stop_words else F.lit(True))
    rows = lines.select(F.col(key).alias("line"), words.alias("w"))
    # an n-gram is no more frequent than any of its words: those below the last of the top words are in none that counts
    counts = _counted(rows.select("w")).persist(StorageLevel.DISK_ONLY)
    best = counts.where(F.col("lines") >= least).orderBy(F.desc("cnt")).limit(top).agg(F.count("*").alias("n"), F.min("cnt").alias("cnt")).first()
    floor = best.cnt if best.n == top else least
    counted = counts.where((F.col("lines") >= least) & (F.col("cnt") >= floor))
    if longest > 1:
        frequent = counts.where(F.col("cnt") >= floor)
        few = [r.term for r in frequent.select("term").limit(FEW_WORDS + 1).collect()]
        if len(few) <= FEW_WORDS:
            # other words become null, and runs of them one
            marked = F.transform("w", lambda x: F.when(x.isin(*few), x))
            rows = rows.select(once(marked, lambda m: F.filter(m, lambda x, i: x.isNotNull() | F.get(m, i - 1).isNotNull())).alias("w"))
        grams = F.flatten(F.array(*[_grams(n) for n in range(2, longest + 1)]))
        counted = counted.unionByName(_counted(rows.select(grams.alias("w"))).where(F.col("lines") >= least))
    return counted.orderBy(F.desc("cnt"), F.desc("term")).limit(top).select("term", "cnt", term_boost(F.col("term")).alias("boost"))

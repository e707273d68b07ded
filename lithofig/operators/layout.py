"""Figures of page layouts and of page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithofig.functions.rules import figure_number, rx, spaced_sentences, strip, strip_figure_prefix

MENTION = rx(r"\b(Fig(?:ure)?\.?\s*(\d+(?:\.\d+)?))\b", "i")


def nearest_captions(items: DataFrame, threshold: float = 250, keys: tuple[str, ...] = ("paper_id", "page_no")) -> DataFrame:
    """Each picture's nearest caption on its page: (keys, item_ord, caption_ord, dist), strictly below the threshold."""
    pictures = items.where("kind = 'picture'").select(*keys, "item_ord", F.col("t").alias("pt"), F.col("b").alias("pb"))
    captions = items.where("kind = 'caption'").select(*keys, F.col("item_ord").alias("caption_ord"), "t", "b")
    pairs = pictures.join(captions, list(keys)).withColumn("dist", F.least(F.abs(F.col("pb") - F.col("t")), F.abs(F.col("pt") - F.col("b"))))
    best = F.min(F.struct("dist", "caption_ord")).alias("best")
    return pairs.where(F.col("dist") < threshold).groupBy(*keys, "item_ord").agg(best).select(*keys, "item_ord", "best.caption_ord", "best.dist")


def assemble_figures(items: DataFrame, threshold: float = 250) -> DataFrame:
    """Numbered figures with an image: a picture's own caption, else the nearest; of equal names the last at the first place.

    ``items`` has paper_id, item_ord, kind, text, page_no, t, b, captions and image.
    """
    own = F.nullif(strip(F.array_join("captions", " ")), F.lit(""))
    bare = items.where("kind = 'picture'").where(own.isNull()).select("paper_id", "page_no", "item_ord", "kind", "t", "b")
    near = nearest_captions(bare.union(items.where("kind = 'caption'").select("paper_id", "page_no", "item_ord", "kind", "t", "b")), threshold)
    texts = items.where("kind = 'caption'").select("paper_id", "page_no", F.col("item_ord").alias("caption_ord"), strip(F.col("text")).alias("spatial"))
    near = near.join(texts, ["paper_id", "page_no", "caption_ord"]).select("paper_id", "page_no", "item_ord", "spatial")
    found = items.where("kind = 'picture' and image is not null").join(near, ["paper_id", "page_no", "item_ord"], "left")
    found = found.withColumn("raw", F.coalesce(own, F.col("spatial"), F.lit(""))).withColumn("figure_number", figure_number(F.col("raw"))).where("figure_number is not null")
    named = found.select("paper_id", "item_ord", F.concat("paper_id", F.lit("_"), "figure_number", F.lit(".png")).alias("figure_name"), "figure_number", strip_figure_prefix(F.col("raw")).alias("caption"), F.col("page_no").alias("page_number"), "image")
    return last_wins(named, ["paper_id", "figure_name"], "item_ord").withColumnRenamed("item_ord", "fig_ord")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last one's values, at the first one's place."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v"), F.min(order).alias(order))
    return last.select(*keys, order, *[f"v.{c}" for c in rest])


def sentence_spans(pages: DataFrame, keys: tuple[str, ...] = ("paper_id", "page_number"), text: str = "text") -> DataFrame:
    """(keys, sent_ord, sent, start, stop): sentences with the white space after them, and their places in the text without it.

    Places are code points. A null or empty text has no sentence.
    """
    rows = pages.select(*keys, F.posexplode(spaced_sentences(F.col(text))).alias("sent_ord", "sent"))
    before = Window.partitionBy(*keys).orderBy("sent_ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("sent")).over(before), F.lit(0)).cast("int")
    return rows.withColumn("start", start).withColumn("stop", F.col("start") + F.length(F.regexp_replace("sent", rx(r"\s+\z"), "")))


def mention_frames(sentences: DataFrame, caption: int = 3, description: int = 10, joiner: str = "", keys: tuple[str, ...] = ("paper_id", "page_number")) -> DataFrame:
    """Sentences that mention a figure, each with the frames that begin at it.

    ``sentences`` has the keys, sent_ord and sent, and may have start and stop, as from
    ``sentence_spans``; else these are numbers of sentences. A frame ends with its page.
    """
    if not {"start", "stop"} <= set(sentences.columns):
        sentences = sentences.withColumns({"start": F.col("sent_ord"), "stop": F.col("sent_ord")})
    w = Window.partitionBy(*keys).orderBy("sent_ord")
    framed = sentences.withColumns({
        "caption": F.array_join(F.collect_list("sent").over(w.rowsBetween(0, caption - 1)), joiner),
        "description": F.array_join(F.collect_list("sent").over(w.rowsBetween(0, description - 1)), joiner),
        "stop": F.last("stop").over(w.rowsBetween(0, description - 1)),
        "figure": F.nullif(F.regexp_extract("sent", MENTION, 2), F.lit("")),
    })
    return framed.where("figure is not null").select(*keys, "sent_ord", "start", "stop", "figure", strip(F.col("caption")).alias("caption"), strip(F.col("description")).alias("description"))


def figure_mentions(frames: DataFrame, paper: str = "paper_id", page: str = "page_number") -> DataFrame:
    """Per figure label its first caption and page, and all descriptions and pages in order."""
    place = F.struct(page, "sent_ord")
    row = F.struct(F.col(page).alias("page"), "sent_ord", "description", F.struct("start", F.col("stop").alias("end")).alias("span"))
    grouped = frames.groupBy(paper, F.concat(F.lit("Figure_"), "figure").alias("figure_label")).agg(
        F.min_by("caption", place).alias("caption"), F.min_by(page, place).alias("caption_page"), F.array_sort(F.collect_list(row)).alias("m"))
    return grouped.select(paper, "figure_label", "caption", "caption_page", F.transform("m", lambda m: m["description"]).alias("descriptions"),
                          F.transform("m", lambda m: m["span"]).alias("start_end_positions"), F.array_distinct(F.transform("m", lambda m: m["page"])).alias("all_pages_mentioned"))


def mention_lists(mentions: DataFrame, paper: str = "paper_id") -> DataFrame:
    """A paper's figures of page text as five parallel lists, in the order of their first mention."""
    fields = ["caption", "descriptions", "start_end_positions", F.regexp_replace("figure_label", "^Figure_", "").alias("fig_no"), "caption_page"]
    first = F.transform("start_end_positions", lambda p: p["start"])
    rows = mentions.select(paper, F.struct(F.col("caption_page").alias("page"), F.get(first, F.lit(0)).alias("at"), "figure_label").alias("place"), F.struct(*fields).alias("f"))
    lists = rows.groupBy(paper).agg(F.array_sort(F.collect_list(F.struct("place", "f"))).alias("m"))
    names = {"captions": "caption", "descriptions": "descriptions", "start_end": "start_end_positions", "fig_nos": "fig_no", "page_numbers": "caption_page"}
    listed = lambda field: F.transform("m", lambda m: m["f"][field])
    return lists.select(paper, *[listed(field).alias(name) for name, field in names.items()])

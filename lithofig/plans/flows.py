"""The three flows end to end: LaTeX mining, anchor building and page-text mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithofig.functions.rules import latex_text, page_text
from lithofig.operators.latex import caption_mentions, joined_source, mention_lists
from lithofig.operators.layout import figure_mentions, last_wins, mention_frames, sentence_spans
from lithofig.operators.match import enrich, match_figures
from lithofig.operators.vectors import centroid, expand_anchors, max_anchor_score, select_captions


def mine_latex(files: DataFrame, figures: DataFrame, anchors: DataFrame, encoder, answers: DataFrame | None = None, threshold: float = 0.94, images: DataFrame | None = None) -> DataFrame:
    """Records of the figures whose captions are selected and matched.

    ``files`` has paper_id, path and content; ``figures`` paper_id, fig_ord, figure_number,
    page_number and caption; ``encoder`` turns a table with a caption into one with an embedding.
    """
    captions = mention_lists(caption_mentions(joined_source(files)))
    scored = max_anchor_score(encoder(captions.where("caption <> ''")), anchors)
    chosen = match_figures(select_captions(scored, threshold), figures).where("figure_number is not null")
    keyed = chosen.select(
        F.concat("paper_id", F.lit("_"), "figure_number", F.lit(".png")).alias("image_key"), F.struct("paper_id", "cap_idx").alias("place"),
        F.col("paper_id").alias("arxiv_id"), F.col("figure_number").alias("fig_number"), "page_number", "description", "start_end")
    if images is not None:
        keyed = keyed.join(images.select(F.col("figure_name").alias("image_key")), "image_key", "left_semi")
    return enrich(last_wins(keyed, ["image_key"], "place").drop("place"), answers)


def build_anchors(seeds: DataFrame, candidates: DataFrame, threshold: float = 0.86) -> tuple[DataFrame, DataFrame]:
    """The anchor set and its mean; vectors of kept sentences are not made again."""
    anchors = expand_anchors(seeds, candidates, threshold)
    return anchors, centroid(anchors, "vec")


def mine_pages(sentences: DataFrame, anchors: DataFrame, encoder, threshold: float = 0.94, images: DataFrame | None = None) -> DataFrame:
    """Figures of page text whose captions are selected, by the key of their image; of equal keys the last one stays.

    ``sentences`` are pages with their text, or sentences as from ``sentence_spans``.
    """
    spans = sentence_spans(sentences) if "text" in sentences.columns else sentences
    figures = figure_mentions(mention_frames(spans))
    scored = max_anchor_score(encoder(figures.withColumnRenamed("descriptions", "description")), anchors)
    number = F.regexp_replace("figure_label", "^Figure_", "")
    keyed = select_captions(scored, threshold).withColumns({"image_key": F.concat("paper_id", F.lit("_"), number, F.lit(".png")), "place": F.struct("caption_page", "figure_label")})
    if images is not None:
        keyed = keyed.join(images.select(F.col("figure_name").alias("image_key")), "image_key", "left_semi")
    return enrich(last_wins(keyed, ["image_key"], "place").drop("place"))


def route(pages: DataFrame | None, latex: DataFrame | None) -> DataFrame:
    """Captions of either route in one table; columns that one lacks are null."""
    if pages is None or latex is None:
        return pages if latex is None else latex
    return pages.unionByName(latex, allowMissingColumns=True)


def processed_contents(files: DataFrame) -> DataFrame:
    """(paper_id, path, processed): each LaTeX file's running text."""
    return files.select("paper_id", "path", latex_text(F.col("content")).alias("processed"))


def processed_pages(pages: DataFrame) -> DataFrame:
    """(paper_id, page_number, processed, caption_text): a page's running text, and its own text, in which captions are sought."""
    return pages.select("paper_id", "page_number", page_text(F.col("text"), F.col("page_number")).alias("processed"), F.col("text").alias("caption_text"))

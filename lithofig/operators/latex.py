"""Figures of LaTeX sources: blocks, captions, labels, and the paragraphs that refer to them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lithofig.functions.rules import clean_caption, strip

# Environments and commands.
BLOCK = r"(?s)\\begin\{(figure\*?|wrapfigure|subfigure)\}(.*?)\\end\{\1\}"
LABEL = r"\\label\{([^}]+)\}"
ANY_LABEL = r"(?s)\\begin\{(?:figure\*?|wrapfigure|subfigure).*?\}.*?\\label\{(.*?)\}.*?\\end\{(?:figure\*?|wrapfigure|subfigure).*?\}"
CAPTION_START = r"\\caption(?:\[[^\]]*\])?\s*\{"
REFERENCE = r"\\ref\{(.*?)\}"


@F.pandas_udf(StringType())
def balanced_caption(blocks: pd.Series) -> pd.Series:
    """The first caption of a block up to its closing brace; unclosed, all but the block's last character."""
    import re

    start = re.compile(CAPTION_START)

    def one(block):
        found = start.search(block) if block else None
        if not found:
            return None
        depth = 1
        for at in range(found.end(), len(block)):
            depth += (block[at] == "{") - (block[at] == "}")
            if not depth:
                return block[found.end():at].strip()
        return block[found.end():-1].strip()

    return blocks.map(one)


def native_caption(block: Column) -> Column:
    """The same for braces nested twice at most, without leaving the JVM."""
    body = CAPTION_START + r"((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
    return F.when(block.rlike(body), strip(F.regexp_extract(block, body, 1)))


def joined_source(files: DataFrame) -> DataFrame:
    """One text per paper: its files in order of their path, without a separator."""
    grouped = files.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("f"))
    return grouped.select("paper_id", F.array_join(F.transform("f", lambda f: f["content"]), "").alias("content"))


def figure_blocks(docs: DataFrame, exact: bool = True) -> DataFrame:
    """(paper_id, block_ord, caption, label) of every outermost figure environment."""
    blocks = docs.select("paper_id", F.posexplode(F.regexp_extract_all("content", F.lit(BLOCK), F.lit(2))).alias("block_ord", "block"))
    caption = balanced_caption("block") if exact else native_caption(F.col("block"))
    return blocks.select("paper_id", "block_ord", caption.alias("caption"), F.nullif(F.regexp_extract("block", LABEL, 1), F.lit("")).alias("label"))


def caption_labels(blocks: DataFrame) -> DataFrame:
    """(paper_id, label, caption, label_ord): the last caption of a label at its first place."""
    both = blocks.where("caption <> '' and label is not null")
    return both.groupBy("paper_id", "label").agg(F.max_by("caption", "block_ord").alias("caption"), F.min("block_ord").alias("label_ord"))


def all_labels(docs: DataFrame) -> DataFrame:
    """(paper_id, label_ord, label): one for each match, which may lie beyond an unlabelled figure."""
    return docs.select("paper_id", F.posexplode(F.regexp_extract_all("content", F.lit(ANY_LABEL), F.lit(1))).alias("label_ord", "label"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(paper_id, par_ord, start, stop, paragraph): offsets exclude leading line ends after the first paragraph."""
    parts = F.split("content", "\n\n")
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + F.length(p) + 2)))
    rows = docs.select("paper_id", F.posexplode(F.arrays_zip(parts.alias("p"), F.slice(ends, 1, F.size(parts)).alias("s"))).alias("par_ord", "x"))
    lead = F.when(F.col("par_ord") > 0, F.length(F.regexp_extract("x.p", r"^(\n*)", 1))).otherwise(0)
    return rows.select("paper_id", "par_ord", (F.col("x.s") + lead).alias("start"), (F.col("x.s") + F.length("x.p")).alias("stop"), F.col("x.p").alias("paragraph"))


def references(docs: DataFrame) -> DataFrame:
    """(paper_id, label, ref_ord, start, stop, description): a row for every literal reference."""
    rows = paragraphs(docs).select("*", F.posexplode(F.regexp_extract_all("paragraph", F.lit(REFERENCE), F.lit(1))).alias("at", "label"))
    return rows.select("paper_id", "label", F.struct("par_ord", "at").alias("ref_ord"), "start", "stop", strip(F.col("paragraph")).alias("description"))


def first_references(docs: DataFrame) -> DataFrame:
    w = Window.partitionBy("paper_id", "label").orderBy("ref_ord")
    return references(docs).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def caption_mentions(docs: DataFrame, exact: bool = True) -> DataFrame:
    """(paper_id, cap_idx, caption, mentions): captions, cleaned, with the paragraphs that refer to them.

    Labels without a reference, and those that no figure's label list holds, go; a label that the
    list repeats repeats its mentions. Of labels with equal captions the last one's mentions stay at
    the first one's place.
    """
    captions = caption_labels(figure_blocks(docs, exact))
    mention = F.struct("ref_ord", "start", "stop", clean_caption(F.col("description")).alias("description"))
    listed = all_labels(docs).groupBy("paper_id", "label").agg(F.count("*").cast("int").alias("k"))
    refs = references(docs).groupBy("paper_id", "label").agg(F.array_sort(F.collect_list(mention)).alias("m"))
    refs = refs.join(listed, ["paper_id", "label"]).select("paper_id", "label", F.flatten(F.array_repeat("m", F.col("k"))).alias("m"))
    both = captions.join(refs, ["paper_id", "label"]).withColumn("caption", clean_caption(F.col("caption")))
    last = both.groupBy("paper_id", "caption").agg(F.max_by("m", "label_ord").alias("m"), F.min("label_ord").alias("cap_idx"))
    return last.select("paper_id", "cap_idx", "caption", F.transform("m", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["description"].alias("description"))).alias("mentions"))


def mention_lists(mentions: DataFrame) -> DataFrame:
    """Parallel lists of a caption's descriptions and offsets."""
    return mentions.select("paper_id", "cap_idx", "caption", F.transform("mentions", lambda m: m["description"]).alias("description"), F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("end"))).alias("start_end"))

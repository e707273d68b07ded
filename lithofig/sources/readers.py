"""Readers: id lists, LaTeX folders and archives, pages, layout items, figure metadata, anchors and text."""

from __future__ import annotations

import io
import tarfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithofig.functions.rules import sentences, strip

LAYOUT = "paper_id string, item_ord int, kind string, label string, text string, page_no int, t double, b double, captions array<string>, image binary"
FIGURES = "figure_name string, figure_number string, caption string, page_number string"


def id_list(lines: DataFrame, text: str = "value", order: str | None = None) -> DataFrame:
    """Ids after the first colon of each line: (paper_id, ord). Blank lines go; a line without a colon has a null id."""
    line = strip(F.col(text))
    rows = lines.where(line != "").select(*([F.col(order).alias("ord")] if order else [F.monotonically_increasing_id().alias("ord")]), line.alias("line"))
    return rows.select("ord", F.when(F.contains("line", F.lit(":")), F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("paper_id"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return id_list(spark.read.text(path))


def read_latex(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, path, content) of the .tex files right below each paper's folder in ``folder``; broken UTF-8 is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tex").load(f"{folder.rstrip('/')}/*")
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("paper_id"), "path", F.regexp_replace(text, r"\r\n?", "\n").alias("content"))
    return rows.where("content is not null")


def member_text(archive: bytes, member: tarfile.TarInfo) -> str | None:
    """A member's text with line ends that are newlines only; None if it is no UTF-8."""
    with tarfile.open(fileobj=io.BytesIO(archive)) as whole:
        raw = whole.extractfile(member).read()
    try:
        return raw.decode().replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def with_both_sources(ids: DataFrame, latex: DataFrame, pdf: DataFrame) -> DataFrame:
    """Papers whose LaTeX folder and PDF are both there."""
    return ids.join(latex.select("paper_id").distinct(), "paper_id", "left_semi").join(pdf.select("paper_id").distinct(), "paper_id", "left_semi")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, path, content) of the .tex members of tar files, read in memory; nothing is unpacked to disk.

    Of an archive that breaks off, or is none, what stands before the fault is kept.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def expand(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                paper = path.rsplit("/", 1)[-1].split(".tar")[0].removesuffix(".gz").removesuffix(".tgz")
                try:
                    for member in tarfile.open(fileobj=io.BytesIO(content)):
                        if member.isfile() and member.name.endswith(".tex"):
                            text = member_text(content, member)
                            if text is not None:
                                out.append((paper, member.name, text))
                except (tarfile.TarError, EOFError, OSError, zlib.error):
                    pass
            yield pd.DataFrame(out, columns=["paper_id", "path", "content"])

    return files.mapInPandas(expand, "paper_id string, path string, content string")


def wanted_papers(ids: DataFrame, metadata: DataFrame, cached: DataFrame | None = None, prefix: str = "quant-ph") -> DataFrame:
    """Papers to fetch: of a wanted category, with a source, and not in the cache."""
    from lithofig.functions.rules import wanted_category

    fresh = ids if cached is None else ids.join(cached.select("paper_id"), "paper_id", "left_anti")
    return fresh.join(metadata, "paper_id").where(wanted_category(F.col("categories"), prefix) & F.col("source_url").isNotNull() & (F.col("source_url") != ""))


def fetch_status(ids: DataFrame, metadata: DataFrame, cached: DataFrame, prefix: str = "quant-ph") -> DataFrame:
    """(paper_id, source_url, status) of every id: cached, unknown, other category, no source, or wanted."""
    from lithofig.functions.rules import wanted_category

    known = metadata.select("paper_id", "categories", "source_url", F.lit(True).alias("known"))
    held = cached.select("paper_id").distinct().withColumn("held", F.lit(True))
    rows = ids.select("paper_id").distinct().join(held, "paper_id", "left").join(known, "paper_id", "left")
    status = F.when(F.col("held"), "cached").when(F.col("known").isNull(), "unknown")
    status = status.when(~F.coalesce(wanted_category(F.col("categories"), prefix), F.lit(False)), "other category")
    return rows.select("paper_id", "source_url", status.when(F.coalesce("source_url", F.lit("")) == "", "no source").otherwise("wanted").alias("status"))


def fetch(status: DataFrame, provider, folder: str) -> DataFrame:
    """Store the payloads of wanted papers; (paper_id, status), where wanted becomes fetched or failed.

    ``provider`` maps (paper_id, source_url) to (pdf, archive) as bytes; what it raises, or an
    archive that is none, fails its paper only. Files are pdf_source/<id>.pdf and
    latex_source/<id>.tar.gz below ``folder``, of any store; writing them again is harmless.
    """
    import pyarrow.fs as pafs

    def stored(store, base, paper, url):
        try:
            pdf, archive = provider(paper, url)
            tarfile.open(fileobj=io.BytesIO(archive)).close()
        except Exception:  # noqa: BLE001, a provider may raise anything
            return "failed"
        for kind, name, data in (("pdf_source", f"{paper}.pdf", pdf), ("latex_source", f"{paper}.tar.gz", archive)):
            store.create_dir(f"{base}/{kind}", recursive=True)
            with store.open_output_stream(f"{base}/{kind}/{name}") as out:
                out.write(data)
        return "fetched"

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for batch in batches:
            rows = [stored(store, base, p, u) if s == "wanted" else s for p, u, s in zip(batch["paper_id"], batch["source_url"], batch["status"], strict=True)]
            yield batch.assign(status=rows)[["paper_id", "status"]]

    return status.mapInPandas(run, "paper_id string, status string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted page texts: (paper_id, page_number from 1, text)."""
    return spark.read.schema("paper_id string, page_number int, text string").json(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).json(path)


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """Figure metadata, an array for each paper: (paper_id, fig_ord, figure_name, figure_number, caption, page_number).

    The ordinal is the place in the array; the paper is the partition or the file's name.
    """
    files = spark.read.text(path, wholetext=True)
    named = files.withColumn("paper_id", F.col("paper_id").cast("string")) if "paper_id" in files.columns else files.withColumn("paper_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1))
    rows = named.select("paper_id", F.posexplode(F.from_json("value", f"array<struct<{FIGURES.replace(' ', ':').replace(',:', ',')}>>")).alias("fig_ord", "f"))
    return rows.select("paper_id", "fig_ord", "f.figure_name", "f.figure_number", F.coalesce("f.caption", F.lit("")).alias("caption"), F.expr("try_cast(f.page_number as int)").alias("page_number"))


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ord int, sentence string, vec array<float>").parquet(path)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, sentence) of whole text files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(sentences(F.col("value"))).alias("ord", "sentence"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, text); a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("text"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line_id long, text string")

"""Writers: records, counts, figure metadata, images and anchors."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of records up to which an object is one row, and in a piece of a larger one, about.
WHOLE_BYTES, PIECE_BYTES = 32 << 20, 4 << 20


def keyed_json(records: DataFrame, key: str = "image_key") -> DataFrame:
    """Column ``value``: an object of all records by key, indented. For exports; engines write JSON lines.

    Up to ``WHOLE_BYTES`` it is one row. A larger one comes in rows, in the order of their keys,
    that are cut at line ends between records: joined by line ends, as a text sink writes them,
    they are the one object, and no task holds more than a few of them. Records are kept on the
    executors' disks from the first call on.
    """
    fields = [c for c in records.columns if c not in (key, "qubits")]
    entries = records.select(F.col(key).alias("key"), F.struct(*fields).alias("value")).persist(StorageLevel.DISK_ONLY)
    size, least = entries.agg(F.sum(F.octet_length(F.to_json("value"))), F.min("key")).first()
    pieces = -(-(size or 0) // PIECE_BYTES)
    if (size or 0) <= WHOLE_BYTES:
        return entries.agg(_object(F.collect_list(F.struct("key", "value"))).alias("value"))
    # keys drawn by hash, some for each piece, bound the pieces; each bound is a key of its own piece, so none is empty
    n = entries.count()
    drawn = entries.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (pieces * 64)))) == 0).where(F.col("key") > least).select("key").distinct()
    keys = sorted(r.key.encode() for r in drawn.collect())
    step = max(1, len(keys) // pieces)
    bounds = [k.decode() for k in keys[step::step]]
    at = F.lit(0) if not bounds else F.coalesce(_bounds_up_to(F.col("key"), bounds), F.lit(0))
    placed = entries.withColumn("piece", at).repartition(len(bounds) + 1, "piece")
    value = placed.groupBy("piece").agg(_object(F.collect_list(F.struct("key", "value"))).alias("value"))
    body = F.when(F.col("piece") > 0, F.substring("value", F.lit(3), F.length("value"))).otherwise(F.col("value"))
    whole = F.when(F.col("piece") < len(bounds), F.concat(F.substring(body, F.lit(1), F.length(body) - 2), F.lit(","))).otherwise(body)
    return value.select("piece", whole.alias("value")).orderBy("piece").select("value")


def _object(entries: Column) -> Column:
    return F.to_json(F.map_from_entries(F.sort_array(entries)), {"pretty": "true"})


def _bounds_up_to(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are not above a key, by halving."""
    table = F.array(*[F.lit(b) for b in bounds])
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
        F.get(table, half(s)) <= key, F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi"))))
    return found["lo"]


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """paper_id,No_Img in one CSV file, a row per paper; processed papers first, then by order."""
    ordered = counts.orderBy(F.col("No_Img").isNull(), "ord").select("paper_id", "No_Img")
    ordered.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_figures(figures: DataFrame, path: str) -> None:
    """One array of figures, in their order, for each paper, under the paper's own partition."""
    entry = F.struct("fig_ord", F.struct("figure_name", "figure_number", "caption", F.col("page_number").cast("string").alias("page_number")).alias("f"))
    arrays = figures.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["f"]).alias("all"))
    arrays.select("paper_id", F.to_json("all").alias("value")).write.mode("overwrite").partitionBy("paper_id").text(path)


def write_anchors(anchors: DataFrame, path: str) -> None:
    anchors.write.mode("overwrite").parquet(f"{path}/vectors")
    anchors.orderBy("ord").select("sentence").coalesce(1).write.mode("overwrite").text(f"{path}/sentences")


def write_images(figures: DataFrame, folder: str) -> DataFrame:
    """Write each image to ``folder`` (any store) under its figure's name; returns (figure_name, size)."""
    import pyarrow.fs as pafs

    def save(batches):
        store, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, image in zip(batch["figure_name"], batch["image"], strict=True):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(image)
            yield batch.assign(size=batch["image"].map(len))[["figure_name", "size"]]

    return figures.select("figure_name", "image").where("image is not null").mapInPandas(save, "figure_name string, size long")


def archived(records: DataFrame, images: DataFrame) -> DataFrame:
    """Records whose image exists; the others go with their metadata."""
    return records.join(images.select(F.col("figure_name").alias("image_key")), "image_key", "left_semi")


def copy_images(records: DataFrame, source: str, target: str, key: str = "image_key") -> DataFrame:
    """(key, copied): copies each record's image from folder to folder, of any stores; one that is not there is passed over."""
    import pyarrow.fs as pafs

    def copy(batches):
        at = [pafs.FileSystem.from_uri(u) if "://" in u else (pafs.LocalFileSystem(), u) for u in (source, target)]
        (store, base), (other, to) = at
        other.create_dir(to, recursive=True)
        for batch in batches:
            there = []
            for name in batch[key]:
                found = name is not None and store.get_file_info(f"{base}/{name}").type == pafs.FileType.File
                if found:
                    pafs.copy_files(f"{base}/{name}", f"{to}/{name}", source_filesystem=store, destination_filesystem=other)
                there.append(found)
            yield batch.assign(copied=there)

    return records.select(key).mapInPandas(copy, f"{key} string, copied boolean")

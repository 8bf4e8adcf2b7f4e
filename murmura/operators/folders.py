"""The steps of an analysis as work on folders of recordings and images.

Each step reads a folder, works in narrow tasks and has the tasks write their files;
names follow from the recordings' names, so that a step that runs again writes the
same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import captions, image
from murmura.operators import audio
from murmura.operators.bags import compact_ids
from murmura.operators.forest import Forest
from murmura.sources import bmp, files, text, wav

RED = (1.0, 0.0, 0.0)
#: Boxes and captions, in bytes.
BOX = (255, 0, 0)
#: The folders of an analysis.
FOLDERS = ("src_wavs", "chunks", "spectrograms", "filtered_spectrograms", "segmentation_examples", "segmentation_mask", "segmentation_outlines", "segmentation_probabilities", "segments", "segment_masks", "segment_box_visualization", "clustered_segments", "segmentation_examples_support", "unambiguous")


def stem(path: str) -> F.Column:
    """A file's name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def grey_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, w, h, data) of a folder's images, with one byte to a pixel: their first channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "w": b["w"], "h": b["h"], "data": [bmp.as_array(w, h, c, bytes(d))[:, :, 0].tobytes() for w, h, c, d in zip(b["w"], b["h"], b["channels"], b["data"], strict=True)]})

    return bmp.read(spark, folder).mapInPandas(run, audio.IMAGES).withColumn("path", stem("path"))


def write_images(images: DataFrame, folder: str, channels: int = 1) -> int:
    return bmp.write(images.select(F.concat("path", F.lit(".bmp")).alias("name"), "w", "h", F.lit(channels).alias("channels"), "data"), folder)


def split(spark: SparkSession, source: str, target: str, seconds: float) -> int:
    """Recordings cut into whole chunks; returns how many."""
    chunks = audio.split_chunks(wav.read(spark, source), seconds)
    return wav.write(chunks.select(F.concat_ws("_", stem("path"), F.concat("chunk", F.lit(".wav"))).alias("name"), "sample_rate", "samples"), target)


def spectrograms(spark: SparkSession, source: str, target: str, whiten: bool = False) -> int:
    """Spectrogram images of a folder of recordings."""
    images = audio.spectrograms(wav.read(spark, source), whiten=whiten)
    return write_images(images.withColumn("path", stem("path")), target)


def filter_noise(spark: SparkSession, source: str, target: str) -> int:
    return write_images(audio.whitened(grey_images(spark, source)), target)


def copy_files(spark: SparkSession, source: str, target: str, names: DataFrame | None = None) -> int:
    """Copy a folder's files, or those in column ``name`` of a table."""
    every = files.listing(spark, source).withColumn("name", F.element_at(F.split("path", "/"), -1)).select("name", "content")
    return files.write_files(every if names is None else every.join(names.select("name"), "name", "left_semi"), target)


def set_up(path: str) -> list[str]:
    """Make the folders of an analysis where they are missing; their paths."""
    from pyarrow import fs

    target, base = fs.FileSystem.from_uri(path)
    for name in FOLDERS:
        target.create_dir(f"{base}/{name}", recursive=True)
    return [f"{path}/{name}" for name in FOLDERS]


def move_files(spark: SparkSession, source: str, target: str) -> int:
    """Move a folder's files to another folder of the same file system, by name and without reading them; returns how many.

    A task that runs again finds its files moved and counts them all the same.
    """
    from pyarrow import fs

    there, base = fs.FileSystem.from_uri(target)
    there.create_dir(base, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, base = fs.FileSystem.from_uri(target)
        _, start = fs.FileSystem.from_uri(source)
        n = 0
        for b in batches:
            for name in b["name"]:
                if there.get_file_info(f"{start}/{name}").type == fs.FileType.File:
                    there.move(f"{start}/{name}", f"{base}/{name}")
                elif there.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{start}/{name}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    names = files.listing(spark, source).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copy_supporting(spark: SparkSession, examples: str, recordings: str, target: str) -> int:
    """Copy the recordings that a folder of example images was made from: those of the same name up to the first dot."""
    names = files.listing(spark, examples).select(F.concat(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1), F.lit(".wav")).alias("name")).distinct()
    return copy_files(spark, recordings, target, names)


def copy_random(spark: SparkSession, source: str, target: str, k: int, seed: int = 0) -> int:
    """Copy ``k`` files of a folder, chosen by a hash of name and seed."""
    from murmura.operators.recordings import random_rows

    names = files.listing(spark, source).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return copy_files(spark, source, target, random_rows(names, k, ["name"], seed))


def copy_probably_rain(spark: SparkSession, scored: DataFrame, source: str, target: str, at: float = 0.5) -> int:
    """Copy the files (column ``filename``) whose rain probability is ``at`` or more."""
    return copy_files(spark, source, target, scored.filter(F.col("rain_probability") >= at).select(F.col("filename").alias("name")))


def train_segmentation(spark: SparkSession, spectrogram_folder: str, example_folder: str, trees: int = 16, seed: int = 0) -> Forest:
    """A pixel forest from images of which some are marked red and blue in another folder."""
    marks = bmp.read(spark, example_folder).withColumn("path", stem("path"))
    return audio.train_segmentation(audio.annotated_pixels(grey_images(spark, spectrogram_folder), marks, seed=seed), trees, seed)


def outlines(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(path, w, h, data) with three bytes to a pixel: each image with its mask's outline drawn over it in red."""
    both = images.join(masks.select("path", F.col("data").alias("mask")), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                grey, mask = (np.frombuffer(x, np.uint8).reshape(r.h, r.w) for x in (r.data, r.mask))
                yield pd.DataFrame({"path": [r.path], "w": [r.w], "h": [r.h], "data": [image.outlined(np.stack([grey] * 3, 2), mask, RED).tobytes()]})

    return both.mapInPandas(run, audio.IMAGES)


def run_segmentation(spark: SparkSession, model: Forest, source: str, target: str, at: float = 0.5) -> int:
    """Writes folders ``probabilities``, ``masks`` and ``outlines``; returns how many images were segmented."""
    n = write_images(audio.probability_maps(grey_images(spark, source), model), f"{target}/probabilities")
    write_images(audio.masks(grey_images(spark, f"{target}/probabilities"), at), f"{target}/masks")
    write_images(outlines(grey_images(spark, source), grey_images(spark, f"{target}/masks")), f"{target}/outlines", 3)
    return n


def segment_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(path, segment_id, w, h, data, mask) of each large enough segment, cropped, all else blanked."""
    both = images.join(masks.select("path", F.col("data").alias("mask")), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                found = image.segments(*(np.frombuffer(x, np.uint8).reshape(r.h, r.w) for x in (r.data, r.mask)))
                if found:
                    yield pd.DataFrame({"path": r.path, "segment_id": range(len(found)), "w": [s["image"].shape[1] for s in found], "h": [s["image"].shape[0] for s in found], "data": [s["image"].tobytes() for s in found], "mask": [s["mask"].tobytes() for s in found]})

    return both.mapInPandas(run, "path string, segment_id int, w int, h int, data binary, mask binary")


def analyze_segments(spark: SparkSession, source: str, mask_folder: str, target: str, bags: DataFrame | None = None) -> None:
    """Writes the tables ``bags``, ``segment_features`` and ``segment_rectangles`` and the folders ``segments`` and ``segment_masks``.

    ``bags`` (bag_id, filename) keeps numbers given before; else files are numbered by name.
    """
    images, masks = grey_images(spark, source), grey_images(spark, mask_folder)
    if bags is None:
        bags = compact_ids(images.select(F.col("path").alias("filename")), "filename", "bag_id").select("bag_id", "filename")
        text.write_table(bags, f"{target}/bags", ["bag_id"], text.HEADERS["bags"])
    found = audio.segment_table(images, masks).join(bags.select("bag_id", stem("filename").alias("path")), "path")
    text.write_features(found, f"{target}/segment_features", ["bag_id", "segment_id"], text.HEADERS["segment_features"])
    text.write_rectangles(found.select("bag_id", "segment_id", "rect.*"), f"{target}/segment_rectangles")
    crops = segment_images(images, masks).withColumn("path", F.concat_ws("_", "path", "segment_id"))
    write_images(crops, f"{target}/segments")
    write_images(crops.withColumn("data", F.col("mask")), f"{target}/segment_masks")


def segment_boxes(images: DataFrame, segments: DataFrame, caption: str | None = None) -> DataFrame:
    """(path, w, h, data) with three bytes to a pixel: each image with the boxes of its segments in red, and inside a box its caption.

    ``segments``: path, segment_id, rect (min_x, max_x, min_y, max_y), and the column
    that ``caption`` names, null for none. Images without segments stay without boxes.
    What is gathered for an image is bounded by its pixels, as segments don't overlap.
    """
    said = F.coalesce(F.col(caption).cast("string"), F.lit("")) if caption else F.lit("")
    own = segments.select("path", F.struct("segment_id", "rect.min_x", "rect.max_x", "rect.min_y", "rect.max_y", said.alias("said")).alias("box"))
    both = images.join(own.groupBy("path").agg(F.array_sort(F.collect_list("box")).alias("boxes")), "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                img = np.stack([np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)] * 3, 2)
                for box in r.boxes if r.boxes is not None else ():
                    image.draw_box(img, box["min_x"], box["min_y"], box["max_x"], box["max_y"], BOX)
                    captions.draw_text(img, box["said"], box["min_x"] + 2, box["min_y"] + 2, BOX, upwards=True)
                yield pd.DataFrame({"path": [r.path], "w": [r.w], "h": [r.h], "data": [img.tobytes()]})

    return both.select("path", "w", "h", "data", "boxes").mapInPandas(run, audio.IMAGES)


def visualize_boxes(spark: SparkSession, source: str, mask_folder: str, target: str) -> int:
    """Writes each image with the boxes and numbers of its segments; how many."""
    images = grey_images(spark, source)
    return write_images(segment_boxes(images, audio.segment_table(images, grey_images(spark, mask_folder)), "segment_id"), target, 3)


def mosaics(images: DataFrame, width: int = 2000, per_page: int = 500, by: str | None = None) -> DataFrame:
    """(path, w, h, data): pages on which up to ``per_page`` images each, in order of size, are packed into centred rows.

    A page is drawn by one task. ``by``: a column whose values get pages of their own.
    """
    sized = images.withColumn("group_", F.col(by).cast("string") if by else F.lit("all")).withColumn("key_", F.struct("group_", "h", "w", "path"))
    counted = compact_ids(sized, "key_", "place_").drop("key_")
    first = counted.groupBy("group_").agg(F.min("place_").alias("first_"))
    paged = counted.join(F.broadcast(first), "group_").withColumn("page_", F.expr(f"cast((place_ - first_) DIV {per_page} as int)"))

    def draw(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("place_")
        own = [np.frombuffer(d, np.uint8).reshape(h, w) for d, h, w in zip(page["data"], page["h"], page["w"], strict=True)]
        wide = max(width, max(i.shape[1] for i in own) + 12)
        spots = image.mosaic([(i.shape[1], i.shape[0]) for i in own], wide)
        high = max(y + own[i].shape[0] for i, _, y in spots)
        out = np.zeros((high, wide), np.uint8)
        for i, x, y in spots:
            out[y : y + own[i].shape[0], x : x + own[i].shape[1]] = own[i][:, : wide - x]
        return pd.DataFrame({"path": [f"mosaic_{page['group_'].iloc[0]}_{page['page_'].iloc[0]}"], "w": [wide], "h": [high], "data": [out.tobytes()]})

    return paged.select("group_", "page_", "place_", "w", "h", "data").groupBy("group_", "page_").applyInPandas(draw, audio.IMAGES)

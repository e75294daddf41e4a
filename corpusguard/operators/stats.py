"""Corpus statistics over published documents ``path, title, lastmod``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.functions.text import utc_time
from corpusguard.operators.transform import section_directories


def corpus_stats(published: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents published and sections below the root, empty sections included."""
    sections = section_directories(candidates).where("directory <> '.'")
    tally = lambda frame, documents: frame.select(F.lit(documents).alias("document"))
    return (
        tally(published, True)
        .unionByName(tally(sections, False))
        .agg(
            F.count_if("document").alias("documents"),
            F.count_if(~F.col("document")).alias("sections"),
        )
    )


def category_wall(published: DataFrame) -> DataFrame:
    """Documents and latest title per top-level section, largest first.

    Ties of the latest document go to the lowest path.  Counting per time first keeps
    a section of any size in partial aggregates.
    """
    in_section = published.where(F.contains("path", F.lit("/"))).withColumn(
        "section", F.substring_index("path", "/", 1)
    )
    per_time = in_section.groupBy("section", "lastmod").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("title", "path").alias("title")
    )
    return (
        per_time.groupBy("section")
        .agg(F.sum("n").cast("long").alias("documents"), F.max_by("title", "lastmod").alias("latest_title"))
        .orderBy(F.desc("documents"), "section")
    )


def recent_documents(published: DataFrame, limit: int = 6) -> DataFrame:
    """The latest documents with the title of their section and the date."""
    directory = paths.directory(F.col("path"))
    top = published.orderBy(F.desc("lastmod"), "path").limit(limit)
    return top.select(
        "path",
        "title",
        F.when(directory == ".", V.ROOT_SECTION_TITLE).otherwise(paths.base(directory)).alias("section"),
        F.left(utc_time(F.col("lastmod")), F.lit(10)).alias("date"),
    )

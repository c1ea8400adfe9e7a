"""The facade: what an application calls, with detector, recogniser, translator, eraser and font as functions of its own.

Calls return DataFrames and raise named errors with a ``kind``; there is no server here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import names, text
from leafmill.operators import records, safety
from leafmill.plans.standins import members, table


class EngineError(Exception):
    """An error that a caller can tell by its kind; ``status`` is what a server would answer."""

    kind, status = "unknown", 500


class Unavailable(EngineError):
    """A reader or model that this installation lacks (7z, RAR, PDF bytes, detector weights)."""

    kind, status = "unavailable", 503


class MissingInput(EngineError):
    kind, status = "input", 404


class BadRequest(EngineError):
    kind, status = "request", 422


def unavailable(*_):
    raise Unavailable("no detector, recogniser or eraser was given")


class Engine:
    def __init__(self, spark: SparkSession, recognise: Callable[[Column], Column] | None = None, translate: Callable[[Column], Column] | None = None, detect=unavailable, erase=unavailable):
        self.spark, self.detect, self.erase = spark, detect, erase
        self.recognise = recognise or (lambda c: c)
        self.translate = translate or (lambda c: F.lit("HELLO"))

    def health(self) -> dict:
        return {"ok": True, "spark": self.spark.version}

    def models(self) -> dict[str, bool]:
        """The pluggable parts and whether each is there."""
        return {"detect": self.detect is not unavailable, "erase": self.erase is not unavailable, "recognise": True, "translate": True}

    def read_regions(self, regions: DataFrame) -> DataFrame:
        """``regions`` (source, parts) with ``text``: Japanese whole, others per part and joined; an unknown source is refused."""
        lines = F.transform("parts", self.recognise)
        whole = text.canonical_ja(self.recognise(F.array_join("parts", "")))
        read = F.when(F.col("source") == "ja", whole).when(F.col("source").isin("zh", "ko"), text.join_lines(lines, F.col("source")))
        return regions.withColumn("text", F.coalesce(read, F.raise_error(F.concat(F.lit("unknown source language: "), "source")).cast("string"))).drop("parts")

    def run_pages(self, regions: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
        """Regions with state and translation; only what is missing goes to the translator."""
        out = records.apply_translations(regions, stored, on)
        return out.withColumn("translation", F.when(F.col("state") == "missing", self.translate(F.col("text"))).when(F.col("state").isin("edited", "translated"), F.col("stored_text")))

    def run_job(self, sf_dir: str | None = None, paths: DataFrame | None = None) -> DataFrame:
        """Status of each item of exactly one of a folder of tables or a DataFrame of members."""
        if (sf_dir is None) == (paths is None):
            raise BadRequest("exactly one of a folder and paths")
        m = paths if paths is not None else members(self.spark, sf_dir).withColumn("member", F.concat("member", F.lit(".png")))
        from pyspark.sql import Window

        m = m.withColumn("position", F.row_number().over(Window.partitionBy("item").orderBy("member")))
        m = m.withColumn("reason", safety.member_reason(F.col("member"), F.col("position"), F.lit(False)))
        items = safety.refuse(m).join(m.groupBy("item").agg(F.count_if(names.is_page(F.col("member"))).alias("pages")), "item")
        status = F.when(F.col("refused"), "failed").when(F.col("pages") == 0, "skipped").otherwise("ok")
        return items.select("item", "pages", status.alias("status"), F.coalesce("reason", F.when(F.col("pages") == 0, "no pages")).alias("reason"))

    def job_status(self, items: DataFrame) -> DataFrame:
        return items.groupBy("status").agg(F.count("*").alias("items"))

    def rerender(self, regions: DataFrame, page: str, region: int, new: str) -> DataFrame:
        """The page's regions with one edit laid over: only that page is read."""
        mine = regions.where(F.col("page") == page)
        hit = F.col("doc_id") == region
        return mine.select("doc_id", "page", F.when(hit, "edited").otherwise(F.col("state")).alias("state"), F.when(hit, new).otherwise(F.col("stored_text")).alias("text"))

    def cache(self, sf_dir: str) -> DataFrame:
        """Pages, bytes and edits held."""
        return table(self.spark, sf_dir, "documents").agg(F.count("*").alias("pages"), F.sum(F.octet_length("text")).alias("bytes"))

    def cancel(self, tag: str) -> None:
        """Interrupt the jobs that run under a tag."""
        self.spark.interruptTag(tag)

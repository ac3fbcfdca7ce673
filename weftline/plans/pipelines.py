"""The end-to-end flows: research, scrape and summary, with an injected model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exports as X
from ..operators import models as M
from ..operators import pages as P
from ..sources.html import readable_pages

CALLS_AT_ONCE = 3


def research(pages: DataFrame, preferred: list[str], most: int = 6, model: Callable[[str], str] = M.stub) -> DataFrame:
    """Ranked, diversified sources of each task with their digests: ``task_id``, ``rank``, ``url``, ``summary``, ``confidence``."""
    # a candidate's position is its page's id; a page may be captured twice, so its URL is no key
    picked = P.diversified(P.candidates_of(pages), ["task_id"], preferred, most).withColumnRenamed("pos", "page_id")
    read = picked.join(P.fields(pages).select("page_id", "text"), "page_id")
    asked = read.select("task_id", "rank", "url", "text", F.concat(F.lit("Summarise: "), F.substring("text", 1, 5200)).alias("prompt"))
    return M.digested(M.answered(asked, "prompt", model, CALLS_AT_ONCE), "text").select("task_id", "rank", "url", "summary", "confidence")


def scrape(pages: DataFrame) -> DataFrame:
    """The rows of each page's dataset, headings, links and table rows, with the page they come from."""
    read = readable_pages(pages)
    links = read.select("page_id", "url", F.posexplode("links").alias("i", "l")).select("page_id", "url", (F.col("i") + 1).alias("pos"), "l.text", "l.href")
    return X.fallback_dataset(read, links).withColumn("source_parent_url", F.col("url"))


def summarise(pages: DataFrame, model: Callable[[str], str] = M.stub) -> DataFrame:
    """A summary of each page."""
    asked = P.fields(pages).select("page_id", "text", F.concat_ws("\n", "title", F.substring("text", 1, 5200)).alias("prompt"))
    return M.digested(M.answered(asked, "prompt", model), "text").select("page_id", "summary", "confidence")

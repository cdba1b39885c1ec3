"""Pictures and documents as text: binary files, and a text extractor that is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.session import ship


def media(spark: SparkSession, path: str) -> DataFrame:
    """path, name, is_pdf and content of all files below ``path``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content").withColumn("is_pdf", fn.is_pdf(F.lit(""), "name"))


def with_text(files: DataFrame, extract: Callable[[bytes, bool], str] | None = None) -> DataFrame:
    """``files`` with their text, by ``extract`` (content, whether it is a PDF); without one, or where it gives nothing, the text is empty."""
    if extract is None:
        return files.withColumn("text", F.lit(""))
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for content, is_pdf in batches:
            yield pd.Series([extract(c, bool(p)) or "" for c, p in zip(content, is_pdf, strict=True)], dtype=object)

    return files.withColumn("text", text("content", "is_pdf"))

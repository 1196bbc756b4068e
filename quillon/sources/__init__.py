"""Sources and sinks: the driver's tables, HTML pages, JSON metadata, the chunk collection."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str:
    made = _Text()
    made.feed(html or "")
    return "\n".join(made.parts)


def read_html(pages: DataFrame, content: str = "html") -> DataFrame:
    """pages with ``text``: the visible text, one piece a line."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(html_text)

    return pages.withColumn("text", text(F.col(content)))


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects; unreadable ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_collection(chunks: DataFrame, path: str, by: tuple[str, ...] = ("doc_type", "country")) -> None:
    """Replace the partitions that chunks has rows for, so that filters on them prune files."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_collection(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    out = spark.read.parquet(path)
    for k, v in equal.items():
        out = out.where(F.col(k) == v)
    return out


def delete_where(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those gone."""
    return df.join(gone.select(key).distinct(), key, "left_anti")

"""Landed files for the ingest queries, written by Spark from the test tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(*cells: Column) -> Column:
    """Cells as one delimited line: blanks after the commas, quotes where a cell needs them."""
    def quoted(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.concat_ws(", ", *[quoted(c) for c in cells])


def land_lines(df: DataFrame, line: Column, path: str, *head: str) -> str:
    """One text file per partition, each starting with the head lines, as files arrive from a publisher."""
    def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if head:
            yield pd.DataFrame({"value": list(head)})
        yield from batches

    df.select(line.alias("value")).mapInPandas(with_head, "value STRING").write.text(path)
    return path


def zip_batches(df: DataFrame, line: Column, member: str, header: str) -> DataFrame:
    """(path, content): every batch of rows as one zip archive with a read-me and the data member."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("readme.html", "<p>about</p>")
                z.writestr(member, "\r\n".join([header, *batch["value"]]) + "\r\n")
            yield pd.DataFrame({"path": [f"{batch['value'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    return df.select(line.alias("value")).mapInPandas(pack, "path STRING, content BINARY")

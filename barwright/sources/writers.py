"""Writers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..charts.draw import checked_path, save


def parquet(df: DataFrame, path: str, by: tuple[str, ...] = (), compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Partitioned by folders of ``by``, rows of a folder together."""
    placed = df.repartition(*by) if by else df
    placed.write.mode(mode).partitionBy(*by).option("compression", compression).parquet(path)


def _file_name(row: dict[str, Any], keys: tuple[str, ...], form: str) -> str:
    return f"{'-'.join(str(row[k]).replace('/', '_') for k in keys) or 'chart'}.{form}"


def images(charts: DataFrame, folder: str, form: str, keys: tuple[str, ...], roots: tuple[str, ...] = ()) -> DataFrame:
    """One file for each row of ``charts`` (keys, image), written by the tasks that draw it into a folder that they share. Gives keys and ``path``."""
    checked_path(f"{folder}/chart", roots)  # errors now, not in a task
    fields = [charts.schema[k] for k in keys]

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            paths = [str(save(bytes(r["image"]), f"{folder}/{_file_name(r, keys, form)}", roots)) for r in part.to_dict("records")]
            yield part[list(keys)].assign(path=paths)

    return charts.mapInPandas(write, StructType([*fields, StructField("path", StringType())]))

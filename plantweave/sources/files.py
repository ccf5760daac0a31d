"""File sources: declared-schema CSV, JSON, zip members, cached downloads, configs, optional files."""

from __future__ import annotations

import json
import os
import urllib.request
import zipfile
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..runtime import exists


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, bad: str = "cell", audit: bool = False) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line breaks inside quotes allowed.

    ``bad`` says what an unreadable value costs: "cell" makes it null, "row" drops its row, "fail" raises. With
    ``audit`` (and "cell") the raw text of touched rows is kept in ``_corrupt_record``. The schema is never inferred.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", False)
    corrupt = StructField("_corrupt_record", StringType())
    if bad == "row":
        # Read as text and cast here: the reader's own mode looks only at the columns a query needs, so that the rows
        # it drops would differ from query to query.
        text = reader.option("columnNameOfCorruptRecord", corrupt.name).schema(StructType([*text_schema(schema.names).fields, corrupt])).csv(path)
        casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
        ok = F.col(corrupt.name).isNull()
        for f in schema.fields:
            ok = ok & (F.col(f.name).isNull() | casts[f.name].isNotNull())
        return text.filter(ok).select(*(c.alias(n) for n, c in casts.items()))
    reader = reader.option("mode", {"cell": "PERMISSIVE", "fail": "FAILFAST"}[bad])
    if audit and bad == "cell":
        schema = StructType([*schema.fields, corrupt])
        reader = reader.option("columnNameOfCorruptRecord", corrupt.name)
    return reader.schema(schema).csv(path)


def union_years(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Yearly frames whose columns come in different order, chosen by name."""
    out = frames[0].select(*columns)
    for f in frames[1:]:
        out = out.unionByName(f.select(*columns))
    return out


def extract_members(archive: str, target: str, members: Sequence[str] | None = None) -> list[str]:
    """Unpacks the named members, or the one CSV that the archive must hold, unless they are there already."""
    with zipfile.ZipFile(archive) as z:
        if members is None:
            members = [n for n in z.namelist() if n.lower().endswith(".csv")]
            if len(members) != 1:
                raise ValueError(f"{archive} holds {len(members)} CSV files, not one")
        out = []
        for name in members:
            path = os.path.join(target, os.path.basename(name))
            if not os.path.exists(path) or os.path.getsize(path) != z.getinfo(name).file_size:
                with z.open(name) as source, open(path, "wb") as sink:
                    while block := source.read(1 << 20):
                        sink.write(block)
            out.append(path)
    return out


def download(url: str, target: str, opener: Any = urllib.request.urlopen) -> str:
    """``target``, fetched in blocks unless a file of the announced length is there; a broken transfer leaves nothing."""
    with opener(url) as answer:
        size = answer.headers.get("Content-Length")
        if os.path.exists(target) and (size is None or os.path.getsize(target) == int(size)):
            return target
        part = f"{target}.part"
        with open(part, "wb") as sink:
            while block := answer.read(1 << 20):
                sink.write(block)
    os.replace(part, target)
    return target


def read_config(path: str) -> Any:
    """A YAML or JSON config, on the driver."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def read_optional(spark: SparkSession, path: str, schema: StructType, form: str = "csv") -> DataFrame:
    """The file's rows, or none with the same schema if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema) if form == "csv" else spark.read.schema(schema).json(path)


def config_dimension(spark: SparkSession, path: str, entries: str = "verticals", codes: str = "codes") -> DataFrame:
    """(code, vertical, ratio) of a config whose ``entries`` map names to objects with a list of codes and a ratio (null if
    missing); a code that two of them list is an error."""
    rows, seen = [], {}
    for name, entry in read_config(path)[entries].items():
        for code in entry[codes]:
            if seen.setdefault(str(code), name) != name:
                raise ValueError(f"code {code} is listed by {seen[str(code)]} and {name}")
            rows.append((str(code), name, None if entry.get("ratio") is None else float(entry["ratio"])))
    return spark.createDataFrame(rows, "code string, vertical string, ratio double")


def relation(spark: SparkSession, rows: list[tuple], schema: StructType | str, name: str) -> DataFrame:
    """Rows in memory as a registered relation; the schema holds for no rows too."""
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df


def available(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The parquet tables of ``names`` that exist in the folder."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names if exists(spark, f"{folder}/{n}.parquet")}


def flattened(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Nested fields as columns: {name: "outer.inner"}; a missing struct gives null."""
    return df.select(*(F.col(".".join(f"`{p}`" for p in path.split("."))).alias(n) for n, path in paths.items()))

"""Sinks: full-refresh tables, JSON exports, cache upserts, text reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import enrich_once


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path``, which must not be read by ``df``."""
    df.write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_meta(df: DataFrame, path: str, stamp: str | None = None) -> dict:
    """The one row of ``df`` as an indented JSON file; with ``stamp`` the time of the export, in UTC, is added under that name."""
    row = df.select(F.to_json(F.struct("*")).alias("j"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")).first()
    meta = json.loads(row.j) | ({stamp: row["at"]} if stamp else {})
    with open(path, "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=2, ensure_ascii=False)
    return meta


def upsert_cache(cache: DataFrame, new: DataFrame, key: str, path: str) -> DataFrame:
    """Writes the cache with the new keys to another ``path``; keys in the cache keep their rows."""
    out = enrich_once(cache, new, key)
    out.write.mode("overwrite").json(path)
    return out


def report(df: DataFrame, rows: int = 50) -> str:
    """The first rows as aligned text."""
    got = [[*df.columns], *([("" if v is None else str(v)) for v in r] for r in df.limit(rows).collect())]
    widths = [max(len(r[i]) for r in got) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in got)

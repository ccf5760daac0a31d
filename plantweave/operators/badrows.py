"""Rows that fail to parse (problem 6): split raw delimited records into loaded rows and rejects with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checked_broadcast, once

#: Stands for a quoted stretch, for a comma inside one, and for a quote that belongs to a value.
QUOTED, COMMA, QUOTE = "\u0001", "\u0002", "\u0003"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def quoting_broken(line: Column) -> Column:
    """A quote may only open a field, close it, or be doubled inside a quoted field; every open field is closed."""
    rest = F.regexp_replace(F.translate(line, QUOTED, "?"), '"[^"]*"', QUOTED)
    return rest.contains('"') | rest.rlike(f"[^,{QUOTED}]{QUOTED}|{QUOTED}[^,{QUOTED}]")


def split_fields(line: Column) -> Column:
    """Fields of a well-quoted record as text: outer quotes removed, doubled ones halved, line breaks kept."""
    plain = F.split(line, ",")
    inside = F.array_join(
        F.transform(F.split(F.translate(line, COMMA + QUOTE, "??"), '"'), lambda s, i: F.when(i % 2 == 1, F.translate(s, ",", COMMA)).otherwise(s)), QUOTE
    )
    quoted = F.transform(
        F.split(inside, ","),
        lambda f: F.translate(
            F.regexp_replace(F.when(f.startswith(QUOTE), F.substring(f, F.lit(2), F.length(f) - 2)).otherwise(f), QUOTE + QUOTE, '"'), COMMA, ","
        ),
    )
    return F.when(line.contains('"'), quoted).otherwise(plain)


def not_a_number(text: Column) -> Column:
    """Neither empty nor a finite number >= 0 in plain decimal notation, after trimming spaces."""
    t = F.trim(F.coalesce(text, F.lit("")))
    value = t.try_cast("double")
    ok = t.rlike(NUMBER) & F.coalesce((value >= 0) & (value < float("inf")), F.lit(False))
    return (t != "") & ~ok


def classify_lines(lines: DataFrame, number_columns: Sequence[str], default_header: Sequence[str] = ()) -> DataFrame:
    """Each record that isn't a header with its fields, its file's header and ``errors``, an array of reasons.

    ``lines`` has line_id, source_file, line_no, line; line_no 1 of each file is its header. Null lines count as
    empty. Reasons in order: broken_quoting, column_count, "invalid_value: column" for each of the number columns; a rule
    that has no meaning where an earlier one fails gives no reason there. A file without a header gets ``default_header`` (none: its
    records fail column_count). Repeated line_ids are judged one by one; other columns pass through unless they
    clash with the columns made here. Everything stays in the JVM; headers are broadcast after a check of their
    number, the lines are never shuffled.
    """
    made = {"line_id", "source_file", "line_no", "line"}
    base = lines.select(*[F.col(c) for c in lines.columns if c not in {"header", "fields", "errors", "n_fields"}])
    heads = (
        base.filter(F.col("line_no") == 1)
        .groupBy("source_file")
        .agg(F.min(F.regexp_replace("line", r"[\r\n]+$", "")).alias("__h"))
        .select(F.col("source_file").alias("__file"), F.transform(split_fields(F.col("__h")), lambda x: F.lower(F.trim(x))).alias("header"))
    )
    assert made <= set(base.columns), sorted(made - set(base.columns))
    body = base.filter(F.coalesce(F.col("line_no") != 1, F.lit(True))).withColumn("line", F.coalesce("line", F.lit("")))
    joined = body.join(checked_broadcast(heads), F.col("source_file").eqNullSafe(F.col("__file")), "left").drop("__file")
    fallback = F.lit(list(default_header)) if default_header else F.lit(None).cast("array<string>")
    joined = joined.withColumn("header", F.coalesce("header", fallback))
    line = F.col("line")
    broken = F.when(line.contains('"'), quoting_broken(line)).otherwise(F.lit(False))
    judged = joined.withColumn("__broken", once(broken)).withColumn("fields", once(F.when(~F.col("__broken"), split_fields(line))))
    count_off = F.coalesce(F.size("fields") != F.size("header"), F.lit(True))
    values = []
    for name in number_columns:
        at = F.array_position(F.col("header"), F.lit(name)).cast("int")
        values.append(F.when(~F.col("__broken") & ~count_off & F.coalesce(not_a_number(F.get(F.col("fields"), at - 1)), F.lit(False)), f"invalid_value: {name}"))
    layout = F.when(F.col("__broken"), "broken_quoting").when(count_off, "column_count")
    return judged.withColumn("errors", once(F.array_compact(F.array(layout, *values)))).drop("__broken")


def rejects(classified: DataFrame) -> DataFrame:
    """(line_id, reason) of the records that don't load: the kind of the first reason."""
    return classified.filter(F.size("errors") > 0).select("line_id", F.substring_index(F.col("errors")[0], ":", 1).alias("reason"))


def loaded(classified: DataFrame, columns: Sequence[str], number_columns: Sequence[str]) -> DataFrame:
    """The valid records as rows: every column nullable text by its header's name, empty text as null, the number
    columns as doubles. A column the header lacks is null."""
    good = classified.filter(F.size("errors") == 0)
    out = [F.col("line_id"), F.col("source_file")]
    for name in columns:
        text = F.get(F.col("fields"), F.array_position(F.col("header"), F.lit(name)).cast("int") - 1)
        text = F.nullif(F.trim(text), F.lit(""))
        out.append((text.try_cast("double") if name in number_columns else text).alias(name))
    return good.select(*out)

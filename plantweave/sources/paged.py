"""A paged search service as a Spark data source, with date ranges split until each can be read in full."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Rows and pages the service gives at most, when a range is split, how often, tries and longest wait.
PAGE_ROWS, PAGES, SPLIT_ABOVE, DEPTH, TRIES, LONGEST_WAIT_S = 100, 100, 5_000, 12, 5, 20.0


@dataclass(frozen=True)
class Leaf:
    """A range to be read at once; ``whole`` is False if it still holds more than can be read."""

    key: str
    start: date
    end: date
    count: int
    whole: bool


def leaves(key: str, start: date, end: date, count: Callable[[str, date, date], int], above: int = SPLIT_ABOVE, depth: int = DEPTH) -> Iterator[Leaf]:
    """Non-empty ranges, bisected by days while they count more than ``above`` and may be split."""
    todo = [(start, end, 0)]
    while todo:
        a, b, level = todo.pop()
        n = count(key, a, b)
        if n > above and a < b and level < depth:
            middle = a + timedelta(days=(b - a).days // 2)
            todo += [(middle + timedelta(days=1), b, level + 1), (a, middle, level + 1)]
        elif n:
            yield Leaf(key, a, b, n, n <= above)


def trailing(as_of: date, days: int = 730) -> tuple[date, date]:
    return as_of - timedelta(days=days), as_of


def patiently(call: Callable[[], Any], tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; failures are repeated after 1, 2, 4, ... seconds, at most LONGEST_WAIT_S."""
    for k in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if k == tries - 1:
                raise
            wait(min(2.0**k, LONGEST_WAIT_S))


def pages(fetch: Callable[[int], list[dict]], rows: int = PAGE_ROWS, most: int = PAGES) -> Iterator[dict]:
    """Rows of page 1, 2, ... until a page is short; the last row of an id wins is left to ``last_wins``."""
    for number in range(1, most + 1):
        got = fetch(number)
        yield from got
        if len(got) < rows:
            return


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class PagedFiles(DataSource):
    """Reads a cache of answers, one JSON file of rows per leaf range: format "paged_files", option "path" (a folder).

    One partition a file; a live service would differ in ``read`` only.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "key string, payload string"

    def reader(self, schema: Any) -> DataSourceReader:
        folder = self.options["path"]

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                import os

                return [FilePartition(os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f.endswith(".json")]

            def read(self, partition: FilePartition) -> Iterator[tuple]:
                with open(partition.path, encoding="utf-8") as f:
                    for row in json.load(f):
                        yield partition.path.rsplit("/", 1)[-1][:-5], json.dumps(row)

        return Reader()


@dataclass(frozen=True)
class LeafPartition(InputPartition):
    """A leaf range to be read, or a key whose ranges couldn't be planned, with the error."""

    key: str
    start: str
    end: str
    error: str | None = None


class PagedService(DataSource):
    """A search service read by ranges: format "paged_service".

    Options: "service" ("module:factory", importable on the executors; the factory gives an object with count(key, start,
    end) and page(key, start, end, number, sort)), "keys" (comma-separated), "start" and "end" (ISO dates), "sort" (handed
    to the service), "cache" (a shared folder of finished ranges; none: no cache), "wait" (seconds of the first retry, 1).

    Planning probes counts and splits ranges until each can be read; one partition a leaf. Calls are repeated with growing
    waits. A key or range that fails for good doesn't fail the job: it gives one row with ``error``, see ``failed_ranges``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return "key string, start string, end string, payload string, error string"

    def reader(self, schema: Any) -> DataSourceReader:
        options = dict(self.options)

        def service() -> Any:
            import importlib

            module, factory = options["service"].split(":")
            return getattr(importlib.import_module(module), factory)()

        def retried(call: Callable[[], Any]) -> Any:
            first = float(options.get("wait", "1"))
            return patiently(call, wait=lambda s: time.sleep(min(s * first, LONGEST_WAIT_S)))

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                start, end, s, out = date.fromisoformat(options["start"]), date.fromisoformat(options["end"]), service(), []
                for key in options["keys"].split(","):
                    try:
                        found = list(leaves(key, start, end, lambda k, a, b: retried(lambda: s.count(k, a, b))))
                        out += [LeafPartition(x.key, x.start.isoformat(), x.end.isoformat()) for x in found]
                    except Exception as e:  # noqa: BLE001 - reported as a row
                        out.append(LeafPartition(key, start.isoformat(), end.isoformat(), f"{type(e).__name__}: {e}"))
                return out or [LeafPartition("", "", "", None)]

            def read(self, partition: LeafPartition) -> Iterator[tuple]:
                p = partition
                at = (p.key, p.start, p.end)
                if p.error is not None or not p.key:
                    if p.error is not None:
                        yield (*at, None, p.error)
                    return
                path = f"{options['cache']}/{p.key}_{p.start}_{p.end}.json" if options.get("cache") else None
                try:
                    rows = read_cached(path) if path else None
                    if rows is None:
                        s, a, b = service(), date.fromisoformat(p.start), date.fromisoformat(p.end)
                        rows = list(pages(lambda n: retried(lambda: s.page(p.key, a, b, n, options.get("sort")))))
                        if path:
                            write_cached(path, rows)
                except Exception as e:  # noqa: BLE001 - reported as a row
                    yield (*at, None, f"{type(e).__name__}: {e}")
                    return
                for row in rows:
                    yield (*at, json.dumps(row), None)

        return Reader()


def read_cached(path: str) -> list[dict] | None:
    import os

    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_cached(path: str, rows: list[dict]) -> None:
    """Written beside and moved into place, so that a lost executor leaves no half file."""
    import os
    import uuid

    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(rows, f)
    os.replace(part, path)


def failed_ranges(answers: Any) -> Any:
    """(key, start, end, error) of what couldn't be read; the rest of ``answers`` is whole."""
    return answers.filter("error is not null").select("key", "start", "end", "error")


def geocode_answers(lines: Any) -> Any:
    """(id, lat, lon) from a batch geocoder's answer lines (column ``value``): lines with at least six fields and the
    status Match count; the fifth field after it holds "lon,lat"."""
    from pyspark.sql import functions as F

    f = F.split(F.regexp_replace(F.col("value"), '^"|"$', ""), '"\\s*,\\s*"')
    ok = (F.size(f) >= 6) & (F.get(f, F.lit(2)) == "Match")
    point = F.split(F.get(f, F.lit(5)), ",")
    return lines.filter(ok).select(F.get(f, F.lit(0)).alias("id"), F.get(point, F.lit(1)).try_cast("double").alias("lat"), F.get(point, F.lit(0)).try_cast("double").alias("lon"))

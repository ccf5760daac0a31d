"""Evaluation texts leaking into training text (problem 8): pigeonhole pieces, then bit-parallel verification.

One scan of the documents, however many items there are: runs of words whose hash is in a bitmap of fixed size are joined,
with the words around them, to the table of the items' runs; what the hashes claim is then verified by Myers' bit vectors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checked_broadcast, cut

#: Consecutive words of an item that make a leak, and word edits allowed in them.
WINDOW, ERRORS = 25, 1
#: Least and most bits of the bitmap of the items' runs; between them it has BITS_A_RUN for each run. A full bitmap only
#: costs time: the join decides.
BITS_LEAST, BITS_MOST, BITS_A_RUN = 1 << 20, 1 << 30, 16
#: Words a Python worker remembers the hashes of.
REMEMBERED = 1_000_000
_DROP = re.compile(r"[^\w\s]|_")
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    """Words split at white space, without letter case, punctuation and quote marks; a word of these alone is none."""
    if not text:
        return []
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower()).split()


def myers_within(pattern: list[int], text: list[int], errors: int) -> bool:
    """True if some stretch of ``text`` is within ``errors`` edits of ``pattern`` (Myers' bit-vector recurrence over
    words instead of characters; the pattern may have any length, as Python's integers have)."""
    m = len(pattern)
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        at[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for w in text:
        eq = at.get(w, 0)
        x = eq | down
        flat = (((x & up) + up) ^ up) | x
        rise = down | ~(flat | up) & full
        fall = up & flat
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score <= errors:
            return True
        rise, fall = rise << 1, fall << 1
        up = (fall | ~(x | rise)) & full
        down = rise & x & full
    return False


class _Hashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((_HASHES[w] for w in words), dtype=np.uint64, count=len(words))


def run_hashes(ids: np.ndarray, piece: int) -> np.ndarray:
    """Hash of each run of ``piece`` words, as signed integers."""
    n = len(ids) - piece + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = (ids ^ (ids >> np.uint64(7))) * np.uint64(_BASE)
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(piece):
            h = h * np.uint64(0x100000001B3) + mixed[j : j + n]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def item_runs(items: DataFrame, window: int, errors: int) -> DataFrame:
    """(h, item_id, words, at): each run of window // (errors + 1) words of each item's text of ``window`` words or more,
    with the words of all windows that have it as one of their errors + 1 pieces; it begins at ``at`` of them."""
    piece = window // (errors + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].tolist(), batch["text"].tolist()):
                ids = hashed(words_of(text))
                if len(ids) < window:
                    continue
                signed = ids.view(np.int64)
                for q, h in enumerate(run_hashes(ids, piece).tolist()):
                    lo = max(0, q - (window - piece))
                    rows.append((h, item, signed[lo : q + window], q - lo))
            yield pd.DataFrame(rows, columns=["h", "item_id", "words", "at"])

    return items.mapInPandas(run, "h long, item_id long, words array<long>, at int")


def bitmap(runs: DataFrame, bits: int) -> np.ndarray:
    """Bits of the runs' hashes modulo ``bits``, a power of two, made where the runs are; the driver sees bits / 8 bytes."""
    at = F.pmod("h", F.lit(bits))
    made = runs.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect()
    size = 32_768 // 8
    out = np.zeros(max(bits // 8, 1) + 2 * size, dtype=np.uint8)
    for r in made:  # buckets count from 1; position 0 of a bucket is a value of 32768 * (bucket - 1) + 1
        got = np.frombuffer(bytes(r.b), dtype=np.uint8)
        out[(r.bucket) * size : (r.bucket) * size + len(got)] = got
    return out


def _bit_of(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of ``bitmap`` for a position, as the engine's bucket and bit position functions count them: position
    p > 0 is in bucket 1 + (p - 1) // 32768 at (p - 1) % 32768, position 0 in bucket 0 at 0."""
    bucket = np.where(position > 0, 1 + (position - 1) // 32_768, 0)
    bit = np.where(position > 0, (position - 1) % 32_768, 0)
    return bucket * 4_096 + bit // 8, (bit % 8).astype(np.uint8)


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, errors: int = ERRORS, bits: int | None = None) -> DataFrame:
    """(doc_id, item_id), each once: documents that contain ``window`` consecutive words of an item with at most
    ``errors`` of them changed, dropped or followed by an added word.

    ``documents`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Null and empty texts
    and items shorter than the window give nothing; rows with a null id take no part; repeated ids, of documents or
    of items, are judged by each of their texts. All words of all documents are read, in one scan. An edit can spoil one of
    the errors + 1 pieces of a window only, so each leak has an exact piece and none is missed.
    """
    spark = documents.sparkSession
    piece = window // (errors + 1)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    runs = cut(item_runs(wanted, window, errors))
    if bits is None:
        bits = BITS_LEAST
        n = runs.count()
        while bits < min(BITS_MOST, BITS_A_RUN * n):
            bits *= 2
    known = spark.sparkContext.broadcast(bitmap(runs, bits))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[k : k + 500] for whole in batches for k in range(0, len(whole), 500)):
            split = [words_of(t) for t in batch["text"]]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            ids = hashed([w for ws in split for w in ws])
            h = run_hashes(ids, piece)
            byte, bit = _bit_of(h & (bits - 1))
            row = np.repeat(np.arange(len(split)), sizes)
            hit = np.flatnonzero(((known.value[byte] >> bit) & 1).astype(bool) & (row[piece - 1 :] == row[: len(h)]) if len(h) else np.zeros(0, dtype=bool))
            first = np.concatenate([[0], np.cumsum(sizes)])
            lo = np.maximum(first[row[hit]], hit - (window - piece) - errors) if len(hit) else hit
            hi = np.minimum(first[row[hit] + 1], hit + window + errors) if len(hit) else hit
            signed = ids.view(np.int64)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].to_numpy()[row[hit]].astype("int64"), "h": h[hit], "near": [signed[a:b] for a, b in zip(lo, hi)], "begin": (hit - lo).astype("int32")}
            )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = [window if i == errors else (i + 1) * piece for i in range(errors + 1)]
        for batch in batches:
            found, failed = set(), set()
            for d, near, begin, item, words, at in zip(*(batch[c].tolist() for c in ("doc_id", "near", "begin", "item_id", "words", "at"))):
                if (d, item) in found:
                    continue
                for s in {at - (e - piece) for e in ends}:
                    if s < 0 or s + window > len(words):
                        continue
                    start = begin + s - at
                    pattern, region = tuple(words[s : s + window]), tuple(near[max(0, start - errors) : start + window + errors])
                    if (pattern, region) in failed:
                        continue
                    if myers_within(pattern, region, errors):
                        found.add((d, item))
                        break
                    failed.add((pattern, region))
            yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"]).astype("int64")

    candidates = docs.mapInPandas(scan, "doc_id long, h long, near array<long>, begin int")
    claimed = candidates.join(checked_broadcast(runs), "h").select("doc_id", "near", "begin", "item_id", "words", "at")
    return claimed.mapInPandas(verify, "doc_id long, item_id long").distinct()

"""Variant spellings of organisation names (problem 2).

A name is reduced to a canonical string: the words that tell organisations apart, then its trade; legal forms, codes,
places and site labels fall away. Which words are trades and which are general additions is learnt from the column
itself. Canonical names are points of a metric space under Levenshtein's distance of whole names, in the best order of
their words. Pivots are the best supported words: a name is assigned to the pivot nearest to each of its words and
repeated in every further cell that the triangle inequality can't rule out; inside a cell an exact radius join by the
whole names finds all pairs within the radius. A word of a name gives way to the better supported word it meets in a
near name, and names that come out alike are one organisation.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import DROPPED_WORDS, STATES
from ..operators.graph import follow
from ..runtime import checked_broadcast, cut, keep_only, once, salted, tables_written
from .addresses import plain

#: Legal forms and the general words that company keys drop anyway.
LEGAL = frozenset(DROPPED_WORDS) - {"THE", "GROUP", "HOLDINGS", "ENTERPRISES", "INDUSTRIES"} | {"LC", "CRP", "PC"}
GENERAL = tuple(w for w in DROPPED_WORDS if w in ("GROUP", "HOLDINGS", "ENTERPRISES", "INDUSTRIES"))
ARTICLES = ("THE", "AND", "OF")
PLACE_STARTS = frozenset("NORTH SOUTH EAST WEST LAKE FORT FT SAINT ST MOUNT MT PORT".split())
LABELS = frozenset("PLANT FACILITY WORKS SITE BUILDING BLDG HALL HQ HEADQUARTERS WAREHOUSE SHOP DIV DIVISION ASSEMBLY MAIN MACHINE ANNEX YARD BAY OFFICE UNIT".split())
SHORT = {
    "ROBERT": "BOB ROB ROBT", "WILLIAM": "BILL WILL WM", "RICHARD": "DICK RICK RICH", "THOMAS": "TOM THOS", "JAMES": "JIM JAS", "JOSEPH": "JOE JOS", "CHARLES": "CHUCK CHAS CHARLIE",
    "MICHAEL": "MIKE", "EDWARD": "ED TED EDW", "SAMUEL": "SAM SAML", "THEODORE": "THEO", "ANTHONY": "TONY", "ELIZABETH": "BETH LIZ ELIZ", "MARGARET": "MAGGIE MEG PEG PEGGY",
    "KATHERINE": "KATE KATHY", "SUSAN": "SUE", "DEBORAH": "DEB DEBBIE", "PATRICIA": "PAT TRISH", "VICTORIA": "VICKY", "ALEXANDRA": "ALEX", "FRANCISCO": "PACO", "GREGORY": "GREG", "JOSE": "PEPE",
}
NICK = {n: full for full, all_ in SHORT.items() for n in all_.split()}
#: Cells of the metric space, edits of a whole name, share of the names a learnt word is in, share of its places at the
#: end of a name, and most learnt words.
PIVOTS, RADIUS, LEARNT_SHARE, END_SHARE, LEARNT = 1_024, 3, 0.002, 0.3, 500
#: Rows of a few bytes (words, cells) that may be broadcast.
SMALL = 500_000
_CODE = re.compile(r"^\s*(?:[A-Z]{0,3}\d[\dA-Z]{2,})\s*-\s+")
_DIGITS, _SILENT = str.maketrans("0135", "OIES"), str.maketrans("", "", "'’.")
_DBA, _STATE_LAST, _BRACKETS = re.compile(r"\bD\s?/?\s?B\s?/?\s?A\b\.?"), re.compile(r",\s*([A-Z]{2})$"), re.compile(r"\(([^)]*)\)?")
_DOTTED, _ALNUM = re.compile(r"\b([A-Z])\.(?=[A-Z]\b\.?)"), re.compile(r"[A-Z0-9]+")


def distance(a: str, b: str) -> int:
    """Levenshtein's distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits(a: str, b: str) -> int:
    """Levenshtein's distance by Myers' bit vectors: one step a letter of ``a``."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, score = full, 0, len(b)
    for c in a:
        eq = at.get(c, 0)
        x = eq | down
        flat = (((x & up) + up) ^ up) | x
        rise, fall = down | ~(flat | up) & full, up & flat
        score += (1 if rise & top else 0) - (1 if fall & top else 0)
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(x | rise)) & full, rise & x & full
    return score


def _swapped(a: str, b: str) -> bool:
    off = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(a) == len(b) and len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]


def _in_order(short: str, word: str) -> bool:
    at = iter(word)
    return all(c in at for c in short)


def _shortens(token: str, word: str) -> bool:
    """First letter and some others in order, ending in the last letter or in G, or without vowels after the first letter."""
    if token[0] != word[0] or not 3 <= len(token) < len(word) - 1:
        return False
    vowels = sum(map(token.count, "AEIOU"))
    ends = word[-1:] == token[-1] or token[-1] == "G" or not set(token[1:]) & set("AEIOU")
    return ends and vowels <= 2 and _in_order(token, word)


def _words(text: str) -> list[str]:
    if "." in text:
        text = _DOTTED.sub(r"\1", text)
    if "." in text or "'" in text or "’" in text:
        text = text.translate(_SILENT)
    out = _ALNUM.findall(text)
    for k, t in enumerate(out):
        if not t.isalpha() and t[0].isalpha():
            out[k] = t.translate(_DIGITS)
    return out


class Reader:
    """Reads names with the trades and general words of a column."""

    def __init__(self, trades: list[str] | tuple[str, ...] = (), general: list[str] | tuple[str, ...] = ()) -> None:
        self.trades, self.general = tuple(trades), tuple(dict.fromkeys((*general, *GENERAL)))
        # Three parts of each word: two edits leave one of them whole.
        self._parts = {w: (w[: len(w) // 3], w[len(w) // 3 : 2 * len(w) // 3], w[2 * len(w) // 3 :]) for w in self.trades + self.general}
        both = self.trades + self.general
        # Learnt words by their beginnings, inner parts, first letters and third parts, so that a token meets few of them.
        self._starts, self._inner, self._first, self._third = ({} for _ in range(4))
        for w in dict.fromkeys(both):
            n = len(w)
            for at, keys in ((self._starts, {w[:k] for k in range(3, n + 1)}), (self._inner, {w[i:j] for i in range(n) for j in range(i + 5, n + 1)}), (self._first, {w[:1]}), (self._third, set(self._parts[w]))):
                for key in keys:
                    at.setdefault(key, []).append(w)
        self._lengths = sorted({len(p) for p in self._third})
        self.readings, self.cached_key = lru_cache(200_000)(self._readings), lru_cache(200_000)(self.operator_key)

    def __reduce__(self) -> tuple:
        return _reader, (self.trades, self.general)  # one a worker process, with what it remembers

    def _slips(self, token: str, word: str) -> int:
        """Edits, two swapped neighbours being one; 3 stands for more than two."""
        a, b, c = self._parts[word]
        if not (a in token or b in token or c in token) or not -3 < len(token) - len(word) < 3:
            return 3
        d = edits(token, word)
        return 1 if d == 2 and _swapped(token, word) else min(d, 3)

    def _readings(self, token: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(trades, general words) that the token can stand for: exact, else abbreviated, else misspelt."""
        if token in self.trades:
            return (token,), ()
        if token in self.general:
            return (), (token,)
        n = len(token)
        found = self._starts.get(token, []) if n >= 3 else []
        found = found or [w for w in self._first.get(token[:1], ()) if _shortens(token, w)]
        found = found or (self._inner.get(token, []) if n >= 5 else [])
        if not found and n >= 4:
            shared = {w for k in self._lengths for i in range(n - k + 1) for w in self._third.get(token[i : i + k], ())}
            slips = [(w, self._slips(token, w)) for w in shared]
            found = [w for w, d in slips if d == 1] or ([w for w, d in slips if d == 2] if n >= 7 else [])
        if found:
            return tuple(w for w in self.trades if w in found), tuple(w for w in self.general if w in found)
        return (), ()

    def organisation(self, name: str | None) -> tuple[list[str], list[str], list[str], int] | None:
        """(words, initials, possible trades, sure) of the organisation a string names; null if it names none.

        Words come as written, without repeats; no trade means that none is written. What stands after a
        dash, in brackets or after the legal form is a place, unless it repeats a word of the name. "A Holdings dba B" is
        B; a part before a comma that holds one word only is completed by the part after it. The words after the first
        ``sure`` ones may be the place that a site label follows.
        """
        if not name:
            return None
        t = " ".join(plain(name).split())
        if "-" in t:
            t = _CODE.sub("", t)
        while ("BA" in t or "B " in t or "B/" in t) and (m := _DBA.search(t)):
            t = t[m.end() :]
        m = _STATE_LAST.search(t) if "," in t else None
        if m and m[1] in STATES and not any(w in LEGAL for w in _words(t)[:-1]):
            return None
        t = t.split(" - ")[0].removesuffix(" -")
        inner = _BRACKETS.findall(t) if "(" in t else []
        t = _BRACKETS.sub(" ", t) if inner else t
        words, initials, trades, seen_trade, legal, label, general_seen, first_trade = [], [], None, False, False, False, False, ""
        for k, segment in enumerate(s for s in t.split(",") if s.strip()):
            tokens = [w for w in _words(segment) if w not in ARTICLES]
            if k and len(words) + len(initials) >= 2 and (seen_trade or legal):
                break
            if k and tokens and tokens[0] in PLACE_STARTS and seen_trade:
                break
            if k and len(words) >= 2 and not any(w in LEGAL or self.readings(w)[0] for w in tokens):
                break
            for w in tokens:
                if legal and (words or trades):
                    break
                if w in LEGAL or (len(w) == 1 and w in "LC" and words and tokens[-1] == w and len(tokens) > 2 and not w.isalpha()):
                    legal = legal or bool(words or seen_trade)
                    continue
                if w in LABELS and not (w == "WORKS" and not words):
                    label = True
                    continue
                if w.isdigit():
                    continue
                if len(w) == 1:
                    initials.append(w)
                    continue
                r = self.readings(w)
                if len(w) == 2 and words and not (r[0] or r[1]):
                    guess = tuple(x for x in self.trades if x[0] == w[0])
                    guess = tuple(x for x in guess if x.startswith(w) or any(g[0] == w[1] for g in self.general))
                    if guess and len(words) == 1 and first_trade in self.trades:
                        words.append(first_trade)
                        trades, first_trade = guess, ""
                        continue
                    if guess and not seen_trade:  # initials of trade and general word, or a name cut off
                        trades, seen_trade = guess, True
                        continue
                if r[0] and not seen_trade:
                    trades, seen_trade = r[0], True
                    first_trade = w
                elif r[0] and len(words) <= 1 and first_trade in self.trades and not legal:  # the first trade word is a proper word
                    words.append(first_trade)
                    trades, first_trade = r[0], w
                elif r[0] or r[1]:
                    general_seen = True
                elif len(w) > 2 and NICK.get(w, w) not in words:
                    words.append(NICK.get(w, w))
            # a label ends the segment: what lies between the trade and it is a place
            if label and seen_trade and tokens and tokens[-1] in LABELS:
                cutoff = max((i for i, w in enumerate(tokens) if w in LEGAL or any(self.readings(w))), default=-1)
                before = {NICK.get(w, w) for w in tokens[:cutoff]}
                if sum(w in before for w in words) >= 2:
                    words = [w for w in words if w in before or w not in tokens]
        if label:
            words = words[: next((i for i, w in enumerate(words) if i >= 2 and w in PLACE_STARTS), len(words))]
        if len(words) >= 2 and initials and not trades:
            trades = tuple(x for x in self.trades if x[0] == initials[-1])
        if len(words) >= 2:
            initials = []
        for extra in inner:
            more = [NICK.get(w, w) for w in _words(extra) if w not in LEGAL and w not in LABELS]
            if any(len(x) > 3 and (x in words or any(abs(len(x) - len(w)) <= 2 and edits(x, w) <= 2 for w in words)) for x in more):
                initials += [x for x in more if len(x) == 1]
                words += [x for x in more if len(x) > 1 and x not in words and not any(abs(len(x) - len(w)) <= 2 and edits(x, w) <= 2 for w in words)]
        if len(words) == 1 and not initials and len(words[0]) < 13 and not (seen_trade or legal):
            return None
        if not words or (label and not seen_trade and not legal) or not (seen_trade or legal or general_seen or len(words) >= 2):
            return None
        words = list(dict.fromkeys(words))
        return words, sorted(set(initials)), sorted(trades or ()), min(2, len(words)) if label else len(words)

    def operator_key(self, name: str | None) -> str | None:
        """The organisation as "WORDS|TRADES|INITIALS", words in order of letters; null without words."""
        o = self.organisation(name)
        return "|".join((" ".join(sorted(o[0])), "/".join(o[2]), " ".join(o[1]))) if o and o[0] else None


@lru_cache(4)
def _reader(trades: tuple[str, ...], general: tuple[str, ...]) -> Reader:
    return Reader(trades, general)


# --- what a column teaches --------------------------------------------------------------------------------------


def _tokens(names: DataFrame) -> DataFrame:
    """(w): the words of the part of each name that can hold words and trade, without code, holding company, brackets and
    places; none for strings with a site label or a state at the end. Computed once a name."""
    site = rf"\b({'|'.join(sorted(LABELS - {'WORKS', 'MACHINE', 'MAIN'}))})\b|,\s*({'|'.join(STATES)})$"
    t = names.select(once(F.upper("name")).alias("t"))
    head = F.when(F.col("t").contains(" - "), F.regexp_replace(F.regexp_replace("t", r"^\s*[A-Z]{0,3}\d[\dA-Z]{2,}\s*-\s+", ""), r"\s-\s.*", "")).otherwise(F.col("t"))
    t = t.select(once(F.when(~F.col("t").rlike(site), head)).alias("t"))
    may_dba = F.col("t").contains("BA") | F.col("t").rlike(r"B[\s/]")
    head = F.when(may_dba & F.col("t").rlike(r"\bD\s?/?\s?B\s?/?\s?A\b"), F.regexp_replace("t", r".*\bD\s?/?\s?B\s?/?\s?A\b\.?", "")).otherwise(F.col("t"))
    head = F.substring_index(F.substring_index(head, ",", 1), "(", 1)
    words = F.regexp_extract_all(F.regexp_replace(head, "['’.]", ""), F.lit("[A-Z0-9]{2,}+(?<=[A-Z])"), F.lit(0))
    return t.select(once(F.array_distinct(F.filter(words, lambda w: ~w.isin([*LEGAL, *GENERAL, *LABELS, *ARTICLES])))).alias("w"))


def learnt_words(names: DataFrame) -> tuple[list[str], list[str]]:
    """(trades, general words) of the distinct strings ``name``.

    A learnt word is in at least LEARNT_SHARE of the names (and in five) and ends at least END_SHARE of them; it is
    general if most often another learnt word stands before it, else a trade. A word that abbreviates a more frequent
    learnt word is none of its own. Counts cover all names; the driver sees at most LEARNT words.
    """
    lists = _tokens(names).withColumn("w", F.when(F.size("w") > 1, F.col("w")).otherwise(F.array(F.lit(""))))
    places = lists.select(F.posexplode("w").alias("k", "word"), F.get("w", F.col("k") - 1).alias("before"), (F.col("k") == F.size("w") - 1).alias("last"))
    counts = cut(places.groupBy("word", "before").agg(F.count(F.lit(1)).alias("n"), F.count_if("last").alias("ends"), F.count_if(F.col("k") == 0).alias("names")))
    n = counts.agg(F.sum("names").alias("n")).first().n or 0
    often = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).filter("word <> ''")
    often = often.filter((F.col("n") >= max(5.0, LEARNT_SHARE * n)) & (F.col("ends") >= END_SHARE * F.col("n"))).orderBy(F.desc("n"), "word").limit(LEARNT).collect()
    found = [r.word for r in often]
    kept = [w for k, w in enumerate(found) if not any(v.startswith(w) or _shortens(w, v) for v in found[:k])]
    if not kept:
        return [], []
    second = counts.filter(F.col("word").isin(kept) & F.col("before").isin(kept)).groupBy("word").agg(F.sum("n").alias("n")).collect()
    after = {r.word: r.n for r in second}
    general = [r.word for r in often if r.word in kept and after.get(r.word, 0) >= 0.5 * r.n]
    return [w for w in kept if w not in general], general


def parsed_names(names: DataFrame, column: str = "name", reader: Reader | None = None) -> DataFrame:
    """(name, words, initials, trades, sure) of each string that names an organisation; lists may be empty. Without a
    ``reader`` the strings are made distinct and the trades learnt from them first."""
    one = names.select(F.col(column).cast("string").alias("name")).filter("name is not null")
    one = one if reader else cut(one.distinct())  # with a reader the caller has distinct strings
    known = reader or Reader(*learnt_words(one))

    @F.pandas_udf(StringType())
    def read(name: pd.Series) -> pd.Series:
        return pd.Series(["|".join((" ".join(o[0]), " ".join(o[1]), " ".join(o[2]), str(o[3]))) if (o := known.organisation(n)) else None for n in name], dtype=object)

    read = read.asNondeterministic()  # else filters would be pushed below and parse again
    got = one.withColumn("o", read("name")).filter("o is not null").withColumn("o", F.split("o", r"\|"))
    lists = (F.filter(F.split(F.col("o")[k], " "), lambda x: x != "").alias(n) for k, n in enumerate(("words", "initials", "trades")))
    return got.select("name", *lists, F.col("o")[3].cast("int").alias("sure"))


# --- the metric space -------------------------------------------------------------------------------------------


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein's distances of all ``a`` to all ``b``, by Myers' bit vectors: one step a letter of ``a`` for all
    pairs at once. Words of ``b`` have at most 63 letters; characters beyond one byte are taken by their low byte plus
    one of 256 classes each word of ``b`` is told apart by, so they are exact for A-Z and 0-9 only."""
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    if not len(a) or not len(b):
        return out
    if any(not x.isascii() or len(x) > 63 for x in b) or any(not x.isascii() for x in a):
        out[:] = [[distance(x, y) for y in b] for x in a]
        return out
    lb = np.array([len(x) for x in b])
    wide = np.uint64 if lb.max() > 31 else np.uint32
    masks = np.zeros((128, len(b)), dtype=wide)
    for j, y in enumerate(b):
        for k, ch in enumerate(y):
            masks[ord(ch), j] |= wide(1 << k)
    order = np.argsort([-len(x) for x in a], kind="stable")
    texts = [a[i] for i in order]
    la = np.array([len(x) for x in texts])
    codes = np.zeros((len(a), max(1, int(la.max()))), dtype=np.int64)
    for i, x in enumerate(texts):
        codes[i, : len(x)] = np.frombuffer(x.encode(), dtype=np.uint8)
    full = np.array([(1 << int(n)) - 1 for n in lb], dtype=wide)
    top = np.array([1 << max(int(n) - 1, 0) for n in lb], dtype=wide)
    up, down = np.tile(full, (len(a), 1)), np.zeros((len(a), len(b)), dtype=wide)
    score = np.tile(lb.astype(np.int16), (len(a), 1))
    one = wide(1)
    with np.errstate(over="ignore"):
        for t in range(int(la.max())):
            n = int(np.searchsorted(-la, -t))  # texts longer than t
            u, d = up[:n], down[:n]
            eq = masks[codes[:n, t]]
            x = eq | d
            flat = (((x & u) + u) ^ u) | x
            rise, fall = d | ~(flat | u), u & flat
            score[:n] += ((rise & top) != 0).astype(np.int16) - ((fall & top) != 0).astype(np.int16)
            rise, fall = (rise << one) | one, fall << one
            up[:n], down[:n] = (fall | ~(x | rise)) & full, rise & x & full
    empty = lb == 0
    if empty.any():
        score[:, empty] = la[:, None]
    out[order] = score
    return out


def pivots_of(words: DataFrame, count: int = PIVOTS, apart: int = RADIUS) -> list[str]:
    """Of the at most ``count`` best supported words of up to 63 letters those that are at least ``apart`` edits from the
    pivots before them, so that spellings of one word share a cell. Any choice gives the same pairs."""
    top = [r.word for r in words.filter(F.length("word") <= 63).orderBy(F.desc("support"), "word").limit(count).collect()]
    near, kept = distances(top, top) < apart, []
    for k in range(len(top)):
        if not near[k, kept].any():
            kept.append(k)
    return [top[k] for k in kept]


def cells_of(words: DataFrame, pivots: list[str], reach: int) -> DataFrame:
    """(word, cell, home, excess): the pivot nearest to each word, and the others at most ``reach`` farther than it."""
    known = words.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 512):
                part = b["word"].iloc[k : k + 512]
                d = distances(part.tolist(), known.value)
                home = d.argmin(1)
                excess = d - d[np.arange(len(d)), home][:, None]
                i, j = np.nonzero(excess <= reach)
                yield pd.DataFrame({"word": part.to_numpy()[i], "cell": j.astype("int32"), "home": home[i] == j, "excess": excess[i, j].astype("int32")})

    return words.select("word").repartition(32).mapInPandas(assign, "word string, cell int, home boolean, excess int")


def _letters(text: Column) -> Column:
    """The letters A-Z of a text as bits: one edit changes at most two of them. An expression the engine compiles."""
    out = F.lit(0)
    for k, letter in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        out = out + F.when(F.contains(text, F.lit(letter)), 1 << k).otherwise(0)
    return out


def radius_pairs(names: DataFrame, words: DataFrame, radius: int = RADIUS, pivots: list[str] | None = None) -> DataFrame:
    """(a, b, own, other, d): ordered pairs of different names of the same block at most ``radius`` edits apart, or of which
    a is b cut off in a word; ``own`` and ``other`` are their words, each beside the word it corresponds to.

    ``names`` has id, words (distinct words in order of the alphabet), ``blocks`` (array) in which it looks for others and
    ``found_in`` (array), those in which it is found; ``words`` has word and support. The distance of names of as many
    words is the sum of the edits of their words in the best order (of four words or more: with the other words in the
    order given); for names of one word the radius is at most 2. By the pigeonhole two names of n words within the radius have
    a pair of words within radius // n edits: a is in the home cell of its word, and b, by the triangle inequality, in
    every cell at most twice as much farther from its word than the nearest. No such pair is lost. A name of one word of
    eight letters or more may be several written together: it is also placed in the cells of the pivots it begins or ends
    with, where it meets longer names by the edits of the whole string. Names of one word also meet the single words of
    longer ones. An empty table gives no pairs.
    """
    spark = names.sparkSession
    pivots = pivots_of(words) if pivots is None else pivots
    if not pivots:
        return spark.createDataFrame([], "a long, b long, own array<string>, other array<string>, d int")
    share = lambda n: F.when(n == 1, min(radius, 2)).otherwise(F.floor(F.lit(radius) / n)).cast("int")
    parts = names.select("id", "words", "blocks", "found_in", F.size("words").alias("n"), F.explode("words").alias("word"))
    alone = parts.filter("n = 1").select("word").distinct()
    near_by = lambda w, k: checked_broadcast(cut(cells_of(w, pivots, 2 * k)), SMALL)
    placed = parts.filter("n > 1").join(near_by(words, radius // 2), "word").filter(F.col("excess") <= 2 * share(F.col("n")))
    placed = placed.unionByName(parts.filter("n = 1").join(near_by(alone, min(radius, 2)), "word"))
    rest = F.filter("words", lambda w: w != F.col("word"))
    turns = F.when(F.size(rest) == 2, F.array(F.array_join(rest, " "), F.array_join(F.reverse(rest), " "))).otherwise(F.array(F.array_join(rest, " ")))
    key = F.xxhash64("block", "cell").alias("cell")
    wide = placed.filter("home").withColumn("block", F.explode("blocks")).select("id", key, "n", "word", F.array_join(rest, " ").alias("rest"))
    found = placed.withColumn("block", F.explode("found_in")).select("id", key, "n", "word", "words", F.explode(turns).alias("rest"))
    a, b = wide.withColumn("letters", _letters(F.col("rest"))).alias("a"), found.withColumn("letters", _letters(F.col("rest"))).drop("words").alias("b")
    # The join itself only compares the letters, which spares most pairs the rest; distances follow on what is left.
    la, lb = F.col("a.letters"), F.col("b.letters")
    on = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.id") != F.col("b.id"))
    left = F.when(F.col("a.word") == F.col("b.word"), 2 * radius).otherwise(2 * radius - 2)  # one edit is spent on the word
    on = on & (((F.bit_count(la.bitwiseXOR(lb)) <= left) & (F.abs(F.length("a.rest") - F.length("b.rest")) <= radius)) | (la.bitwiseAND(lb) == la))
    even = a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "a.n", "a.word", "a.rest", F.col("b.word").alias("to"), F.col("b.rest").alias("left"))
    same = F.col("word") == F.col("to")
    even = even.withColumn("head", once(F.when(same, 0).otherwise(F.levenshtein("word", "to", 2)))).filter((F.col("head") >= 0) & (F.col("head") <= share(F.col("n"))))
    cutoff = same & (F.col("n") > 1) & F.col("left").startswith(F.col("rest"))
    even = even.withColumn("tail", once(F.levenshtein("rest", "left", radius))).filter((F.col("head") + F.col("tail")).between(F.col("head"), radius) | cutoff)
    beside = lambda w, r: F.filter(F.concat(F.array(w), F.split(F.col(r), " ")), lambda x: x != "")
    even = even.select("a", "b", "n", beside("word", "rest").alias("own"), beside("to", "left").alias("other"), "head", "tail", cutoff.alias("cutoff"))
    each = F.aggregate(F.zip_with("own", "other", lambda x, y: F.levenshtein(x, y)), F.lit(0), lambda t, x: t + x)
    d = F.when((F.col("n") <= 2) & (F.col("tail") >= 0), F.col("head") + F.col("tail")).otherwise(each)
    even = even.select("a", "b", "own", "other", once(d).alias("d"), "cutoff").filter((F.size("own") == F.size("other")) & (F.col("cutoff") | (F.col("d") <= radius))).drop("cutoff")
    # Names of one word: among the words of longer ones, and as words written together.
    one = checked_broadcast(cut(wide.filter("n = 1").select("id", "cell", "word"))).alias("s")
    longer = placed.filter("n > 1").withColumn("all", F.length(F.array_join("words", ""))).withColumn("block", F.explode("found_in")).select("id", key, "word", "words", "all").alias("t")
    single = longer.join(one, (F.col("s.cell") == F.col("t.cell")) & (F.abs(F.length("s.word") - F.length("t.word")) <= 1) & (F.levenshtein(F.col("s.word"), F.col("t.word"), 1) >= 0) & (F.col("s.id") != F.col("t.id")))
    single = single.select(F.col("s.id").alias("a"), F.col("t.id").alias("b"), F.array("s.word").alias("own"), F.array("t.word").alias("other"), F.levenshtein(F.col("s.word"), F.col("t.word")).alias("d"))
    listed = F.broadcast(spark.createDataFrame(list(enumerate(pivots)), "cell int, pivot string"))  # at most PIVOTS rows
    long = parts.filter("n = 1 and length(word) >= 8").withColumn("block", F.explode("blocks")).withColumn("at", F.explode(F.sequence(F.lit(3), F.length("word") - 3)))
    ends = long.select("id", "block", "word", F.explode(F.array(F.substring("word", F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 1, F.length("word")))).alias("pivot"))
    joined = checked_broadcast(cut(ends.join(listed, "pivot").select("id", key, "word").distinct())).alias("s")
    ways = lambda n: [F.concat(*(F.col("t.words")[k] for k in p)) for p in itertools.permutations(range(n))]
    least = lambda n: F.greatest(*(radius - F.levenshtein(F.col("s.word"), t, radius) - F.when(F.levenshtein(F.col("s.word"), t, radius) < 0, 99).otherwise(0) for t in ways(n)))
    spare = F.when(F.size("t.words") == 2, least(2)).otherwise(least(3)) - F.size("t.words") + 1  # edits left of the radius
    together = longer.filter("size(words) <= 3").join(joined, (F.col("s.cell") == F.col("t.cell")) & (F.abs(F.col("t.all") - F.length("s.word")) <= radius) & (spare >= 0))
    together = together.select(F.col("s.id").alias("a"), F.col("t.id").alias("b"), F.array("s.word").alias("own"), F.col("t.words").alias("other"), (radius - spare).alias("d"))
    pairs = even.unionByName(single).unionByName(together)
    best = F.min_by(F.struct("own", "other"), F.struct("d", "own", "other"))
    return pairs.groupBy("a", "b").agg(best.alias("p"), F.min("d").alias("d")).select("a", "b", "p.own", "p.other", "d")


def corrections(names: DataFrame, words: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS) -> DataFrame:
    """(id, words): the names whose words give way to better supported ones in near names, words in order.

    A word is led to the word in its place in a near name: the nearest of those that are, of eight letters or more, twice
    as common (one edit, or two neighbours swapped) or four times (two or three edits), of four to seven letters three
    times as common and one edit away, or ten times as common and two edits away (of three or four letters: one), or a word
    it is the beginning of. Where both are rarer than a fiftieth of the mean support, a word of seven letters or more
    follows one no less common within two edits (of ten or more: three), as all else in the names agrees. Common words
    are therefore never taken for one another. A name written together gives way to the near name of which every word
    is three times as common.
    """
    pairs = radius_pairs(names, words, radius, pivots_of(words, pivots))
    text = names.select(F.col("id").alias("a"), F.col("words").alias("own"))
    both = cut(pairs.drop("b").distinct())
    at = both.filter(F.size("own") == F.size("other")).select("a", F.explode(F.arrays_zip("own", "other")).alias("p")).select("a", F.col("p.own").alias("word"), F.col("p.other").alias("to"))
    at = at.filter("word <> to").distinct()
    listed = checked_broadcast(words, SMALL)
    sa, sb = listed.select("word", F.col("support").alias("sa")), listed.select(F.col("word").alias("to"), F.col("support").alias("sb"))
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    e = F.levenshtein("word", "to")
    e = F.when((e == 2) & (F.length("word") == F.length("to")) & (letters("word") == letters("to")), 1).otherwise(e)
    steps = at.select("word", "to").distinct().join(sa, "word").join(sb, "to").withColumn("e", e)
    mean = words.agg((F.sum(F.col("support") * F.col("support")) / F.sum("support")).alias("m")).first()["m"] or 0.0
    size = F.least(F.length("word"), F.length("to"))
    better = (F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("to") < F.col("word")))
    fit = F.when(size >= 8, F.col("sb") >= F.when(F.col("e") <= 1, 2).otherwise(4) * F.col("sa"))
    fit = fit.when(size >= 4, (F.col("e") <= 1) & (F.col("sb") >= 3 * F.col("sa"))).otherwise(F.lit(False))
    fit = fit | ((F.col("sb") >= 10 * F.col("sa")) & (F.col("e") <= F.when(size >= 5, 2).otherwise(1)) & (size >= 3))
    fit = fit | ((F.col("sb") <= mean / 50) & (size >= 7) & (F.col("e") <= F.when(size >= 10, 3).otherwise(2)))
    begins = (F.length("word") >= 3) & F.col("to").startswith(F.col("word")) & (F.col("sb") >= 10 * F.col("sa"))
    steps = steps.filter(better & (fit | begins))
    best = at.join(steps, ["word", "to"]).groupBy("a", "word").agg(F.min_by("to", F.struct("e", -F.col("sb"), "to")).alias("to"))
    best = best.groupBy("a").agg(F.map_from_arrays(F.collect_list("word"), F.collect_list("to")).alias("m"))  # the words of one name
    new = best.join(text, "a").select(F.col("a").alias("id"), F.array_sort(F.array_distinct(F.transform("own", lambda w: F.coalesce(F.element_at("m", w), w)))).alias("words"))
    split = both.filter(F.size("own") < F.size("other")).select("a", F.col("own")[0].alias("word"), "other", "d", F.explode("other").alias("to"))
    split = split.join(sb, "to").groupBy("a", "word", "other", "d").agg(F.min("sb").alias("sb"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("other"))
    split = split.join(sa, "word").filter(F.col("sb") >= 3 * F.col("sa"))
    split = split.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.min_by("other", F.struct("d", -F.col("sb"), F.array_join("other", " ")))).alias("words"))
    return split.unionByName(new.join(split.select("id"), "id", "left_anti"))


def _without_places(parsed: DataFrame) -> DataFrame:
    """``parsed`` without the words that are the place before a site label: of a name with words after its ``sure`` ones
    the longest beginning stays that is a name, with that trade, without a label; all words if none is."""
    parsed = cut(parsed)
    key = lambda w: F.concat_ws("|", F.array_join(F.array_sort(w), " "), F.array_join("trades", "/"))
    open_ = parsed.filter("sure < size(words)")
    ends = open_.select("name", "trades", "words", F.explode(F.sequence("sure", F.size("words"))).alias("n"))
    ends = cut(ends.select("name", "n", key(F.slice("words", F.lit(1), F.col("n"))).alias("key")))
    known = parsed.filter("sure = size(words)").select(key(F.col("words")).alias("key")).join(checked_broadcast(ends.select("key").distinct()), "key", "left_semi").distinct()
    ends = ends.join(known, "key").groupBy("name").agg(F.max("n").alias("n"))
    cutoff = open_.join(ends, "name", "left").withColumn("words", F.slice("words", F.lit(1), F.coalesce("n", F.size("words")))).drop("n")
    return parsed.filter("sure = size(words)").unionByName(cutoff).drop("sure")


def organisations(names: DataFrame, column: str = "name", radius: int = RADIUS) -> DataFrame:
    """(name, org): each distinct string that names an organisation and a key shared by the organisation's names.

    Strings that name none (null, blank, labels, numbers, places) are left out; an empty table gives no rows; other
    columns are ignored. Names that come out of the metric space with the same words belong together if they have the same
    trade. A name whose trade is missing, misspelt or ambiguous, or that has one word (with or without an initial), goes to
    the one organisation that agrees with it, and stays alone where several do.
    """
    mark = tables_written()
    strings = cut(names.select(F.col(column).cast("string").alias("name")).filter("name is not null").distinct())
    reader = Reader(*learnt_words(strings))
    parsed = cut(_without_places(parsed_names(strings, reader=reader)).withColumn("words", F.array_sort("words")))
    words = cut(parsed.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("support")))
    key = F.concat_ws("|", F.array_join("words", " "), F.array_join("trades", "/"))
    forms = parsed.filter("size(words) > 0").select("words", "trades").distinct().withColumn("id", F.xxhash64("words", "trades"))
    every = F.lit([*reader.trades, ""]).cast("array<string>")
    none = F.size("trades") == 0
    forms = cut(forms.withColumns({"blocks": F.when(none, every).otherwise(F.col("trades")), "found_in": F.when(none, F.array(F.lit(""))).otherwise(F.col("trades"))}))
    changed = forms.withColumnRenamed("words", "old").join(corrections(forms, words, radius), "id").withColumn("to", key)
    changed = changed.select("to", F.concat_ws("|", F.array_join("old", " "), F.array_join("trades", "/")).alias("key")).filter("key <> to")
    led = checked_broadcast(follow(cut(changed)), SMALL)
    full = parsed.withColumn("key", key).join(led, "key", "left").withColumn("key", F.substring_index(F.coalesce("to", "key"), "|", 1)).drop("to")
    full = cut(full.withColumn("words", F.filter(F.split("key", " "), lambda x: x != "")))
    keep_only(mark, full)
    sure = full.filter((F.size("words") >= 2) & (F.size("trades") == 1)).select("name", "key", "words", F.col("trades")[0].alias("trade"))
    orgs = cut(sure.groupBy("key", "trade").agg(F.first("words").alias("owords")))
    # A word too many may be a trade that is misspelt beyond reading.
    odd = full.filter((F.size("words") >= 3) & (F.size("trades") == 0)).select("name", F.explode("words").alias("odd"), "words")
    odd = odd.select("name", "odd", F.array_join(F.filter("words", lambda x: x != F.col("odd")), " ").alias("key"))
    slip = F.least(F.levenshtein(F.col("odd"), F.col("trade")), F.levenshtein(F.col("odd"), F.substring(F.col("trade"), F.lit(1), F.length("odd"))))
    misspelt = odd.join(orgs.select("key", "trade"), "key").filter((F.length("odd") >= 4) & (slip <= F.when(F.length("odd") >= 7, 3).otherwise(2)))
    misspelt = cut(misspelt.groupBy("name").agg(F.min_by(F.concat_ws("|", "key", "trade"), F.struct(slip, "trade")).alias("org")))
    sure = sure.select("name", F.concat_ws("|", "key", "trade").alias("org"))
    vague = full.join(misspelt.select("name"), "name", "left_anti").filter((F.size("words") >= 2) & (F.size("trades") != 1)).alias("v")
    fits = (F.size("v.trades") == 0) | F.array_contains(F.col("v.trades"), F.col("o.trade"))
    one = vague.join(orgs.alias("o"), (F.col("v.key") == F.col("o.key")) & fits, "left")
    one = one.groupBy("v.name", "v.key", "v.trades").agg(F.count("o.trade").alias("n"), F.min("o.trade").alias("trade"))
    one = one.select("name", F.when(F.col("n") == 1, F.concat_ws("|", "key", "trade")).otherwise(F.concat_ws("|", "key", F.array_join("trades", "/"))).alias("org"))
    by_word = orgs.select("key", "trade", "owords", F.explode("owords").alias("w"))
    short = full.filter(F.size("words") == 1).withColumn("w", F.col("words")[0]).withColumn("initial", F.get("initials", F.lit(0))).alias("s")
    other = F.exists("o.owords", lambda x: (x != F.col("s.w")) & x.startswith(F.col("s.initial")))
    agrees = (F.size("s.trades") == 0) | F.array_contains(F.col("s.trades"), F.col("o.trade"))
    few = short.join(by_word.alias("o"), (F.col("s.w") == F.col("o.w")) & agrees & (F.col("s.initial").isNull() | other), "left")
    few = few.groupBy("s.name", "s.key", "s.trades", "s.initial").agg(F.count("o.key").alias("n"), F.min(F.struct("o.key", "o.trade")).alias("o"))
    few = few.select(
        "name",
        F.when(F.col("n") == 1, F.concat_ws("|", "o.key", "o.trade"))
        .otherwise(F.concat(F.col("key"), F.lit(" "), F.coalesce("initial", F.lit("")), F.lit("|"), F.array_join("trades", "/")))
        .alias("org"),
    )
    return sure.unionByName(misspelt).unionByName(one).unionByName(few)


def spelling_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """(name_a, name_b), name_a < name_b in byte order: different strings that name the same organisation."""
    mark = tables_written()
    members = cut(organisations(names, column))
    keep_only(mark, members)
    b, a = salted(members, members, "org", "name", 20_000)
    a, b = a.alias("a"), b.alias("b")
    on = (F.col("a.org") == F.col("b.org")) & (F.col("a.__salt") == F.col("b.__salt")) & (F.col("a.name") < F.col("b.name"))
    return a.join(b, on).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))

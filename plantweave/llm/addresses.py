"""Same postal address written differently (problem 4): parse, expand, put in order, join on hierarchical keys."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import STATES
from ..runtime import cut

#: Locale dictionary: written form -> full form, by component.
TYPES = {
    "ST": "STREET", "STR": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "RD": "ROAD", "DR": "DRIVE", "DRV": "DRIVE", "LN": "LANE", "CT": "COURT", "CRT": "COURT",
    "CIR": "CIRCLE", "CIRC": "CIRCLE", "BLVD": "BOULEVARD", "BOUL": "BOULEVARD", "PKWY": "PARKWAY", "PKY": "PARKWAY", "PKWAY": "PARKWAY", "PL": "PLACE", "PLC": "PLACE",
    "WY": "WAY", "WAY": "WAY", "TRL": "TRAIL", "TR": "TRAIL", "TER": "TERRACE", "TERR": "TERRACE", "SQ": "SQUARE", "ALY": "ALLEY", "PLZ": "PLAZA", "XING": "CROSSING",
}
FULL_TYPES = frozenset(TYPES.values()) | {"LOOP", "PIKE", "ROW", "RUN", "PATH"}
DIRECTIONS = {
    "N": "N", "NO": "N", "NORTH": "N", "S": "S", "SO": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W",
    "NE": "NE", "NW": "NW", "SE": "SE", "SW": "SW", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
PREFIXES = {"ST": "SAINT", "STE": "SAINT", "SAINT": "SAINT", "MT": "MOUNT", "MOUNT": "MOUNT", "FT": "FORT", "FORT": "FORT"}
_UNIT = re.compile(r"(?:\b(?:SUITE|STE|UNIT|BLDG|BUILDING|DOCK|GATE|APT|ROOM|RM|LOT|BAY|HANGAR|FLOOR|FL)\b\.?\s*#?\s*|#\s*)(?:\d+[A-Z]?|[A-Z]\d*)\b|\b\d+(?:ST|ND|RD|TH)\s+FLOOR\b|\bREAR\b")
_ASIDE = re.compile(r"\b(?:ATTN|ATTENTION|C/O|CARE OF)\b.*$")
_BOX = re.compile(r"\b(?:P\s?\.?\s?O\s?\.?\s+)?(?:POST\s+OFFICE\s+)?BOX\s+#?\d+")
_ROUTE = re.compile(
    r"\b(?P<c>U\s?\.?\s?S\.?(?:\s*-?\s*(?:HIGHWAY|HWY|ROUTE|RTE))?|FED(?:ERAL)?\.?\s+(?:HIGHWAY|HWY)|(?:STATE|ST)\.?\s+(?:HIGHWAY|HWY|ROUTE|RTE|ROAD|RD)|S\.?\s?H\.?|S\.?\s?R\.?"
    r"|(?:COUNTY|CNTY|CO)\.?\s+(?:ROAD|RD|HIGHWAY|HWY)|C\.?\s?R\.?|HIGHWAY|HWY|ROUTE|RTE)\.?\s*[-#]?\s*(?P<n>\d+[A-Z]?)\b"
)
_NUMBER = re.compile(r"\d+")
_STUCK_SAINT, _STUCK = re.compile(r"^(\W*\d+)(ST\.?\s+[A-Z])"), re.compile(r"(?<![A-Z0-9])(\d+)(?!(?:ST|ND|RD|TH)\b)([A-Z][A-Z.])")
_RANGE, _BEFORE_ROUTE, _SIGNS = re.compile(r"(?<![\w])(\d+)\s*[-–]\s*\d+(?=\s)"), re.compile(r"^[\s,\d]*(?:[A-Z]+\.?\s+)?$"), re.compile(r"[^A-Z0-9' ]+")
_ORDINAL = re.compile(r"^\d+(?:ST|ND|RD|TH)$")
#: What every numbered route, and every number written together with a word, has in it; few addresses do.
_MAY_ROUTE, _MAY_STICK = re.compile(r"[A-Z][.\s#-]*\d"), re.compile(r"\d[A-Z]")
_UNIT_WORDS = ("#", "STE", "SUITE", "UNIT", "BLDG", "BUILDING", "DOCK", "GATE", "APT", "ROOM", "RM", "LOT", "BAY", "HANGAR", "FL", "REAR")
_FIRST = {"N": "NORTH", "NO": "NORTH", "S": "SOUTH", "SO": "SOUTH", "E": "EAST", "W": "WEST"} | PREFIXES


def _near(a: str, b: str) -> bool:
    """One change, lost or added letter, or two swapped neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


@lru_cache(100_000)
def _type(token: str) -> str | None:
    if token in TYPES or token in FULL_TYPES:
        return TYPES.get(token, token)
    return next((t for t in sorted(FULL_TYPES) if len(t) > 3 and len(token) > 3 and _near(token, t)), None)


@lru_cache(100_000)
def _direction(token: str) -> str | None:
    return DIRECTIONS.get(token) or next((DIRECTIONS[d] for d in ("NORTH", "SOUTH", "EAST", "WEST") if len(token) > 3 and _near(token, d)), None)


@lru_cache(100_000)
def _prefix(token: str) -> str | None:
    if token in PREFIXES or token in ("M", "MTT", "STT"):
        return PREFIXES.get(token, token)
    if len(token) == 2 and (token[0] in "SM" or token[1] == "T"):  # a slip in ST or MT
        return token
    return next((p for p in ("SAINT", "MOUNT") if 3 < len(token) < 7 and _near(token, p)), None)


def plain(text: str) -> str:
    if text.isascii():
        return text.upper().strip()
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c)).upper().strip()


@lru_cache(100_000)
def city_key(city: str | None, state: str | None) -> str | None:
    """City with abbreviated first words written out, and state; null without a city."""
    if not city or not city.strip():
        return None
    t = re.sub(r"[^A-Z0-9 ]+", " ", plain(city)).split()
    if not t:
        return None
    return _written_out(t) + "|" + plain(state or "")


def _written_out(words: list[str]) -> str:
    return " ".join([_FIRST.get(words[0], words[0]), *words[1:]]) if len(words) > 1 else words[0]


def zip5(code: str | None) -> str | None:
    """First five digits; a code that lost its leading zero gets it back."""
    if not code:
        return None
    if len(code) == 5 and code.isascii() and code.isdigit():
        return code if code != "00000" else None
    head = code.strip().split("-")[0]
    digits = re.sub(r"\D", "", head)
    if len(digits) in (4, 8):
        digits = "0" + digits
    return digits[:5] if len(digits) in (5, 9) and digits[:5] != "00000" else None


def _street_end(words: list[str], i: int, town: str | None) -> tuple[int, int]:
    """(end, tail) of a street whose first word is ``words[i]``: its words go up to ``end``, where its type or
    direction may stand, and the city, state and ZIP of a segment without commas begin at ``tail``."""
    n, tail = len((town or "").split()), len(words)
    while tail > i + 1 and words[tail - 1].isdigit() and len(words[tail - 1]) >= 4:
        tail -= 1
    if tail > i + 1 and words[tail - 1] in STATES and (tail < len(words) or words[tail - 1] not in TYPES):
        tail -= 1
    if n and tail - n > i and _near(_written_out(words[tail - n : tail]), town):
        tail -= n
    tail = next((j for j in range(i + 1, tail) if words[j][0].isdigit()), tail)
    last = tail - 1
    if last - 1 > i and _direction(words[last]) and _type(words[last - 1]):
        last -= 1
    exact = [j for j in range(i + 1, tail) if words[j] in TYPES or words[j] in FULL_TYPES]
    if last > i and last in exact:
        end = last
    else:
        end = next(iter(exact or [j for j in range(i + 1, tail) if _type(words[j])]), None)
        if end is None:
            end = next((j for j in range(i + 1, tail) if _direction(words[j])), tail)
    while end - 1 > i and _direction(words[end - 1]):  # between the street and its type
        end -= 1
    return end, tail


def parse(address: str | None, city: str | None = None) -> tuple[str, str, str | None, str | None] | None:
    """(number, street, type, direction), or null if there is no street address.

    A street is all its words up to the type, the direction or the end. A range counts as its first number. Units,
    addressees and what follows the street are dropped. Numbered routes have the street "RTE n" and as type their
    class (null for a plain "highway"). Prefixes such as Saint or Mount don't belong to the street's key. Missing type
    or direction is null.
    """
    if not address:
        return None
    t = " ".join(plain(address).split())
    if "ATT" in t or "C/O" in t or "CARE" in t:
        t = _ASIDE.sub("", t)
    if "BOX" in t:
        t = _BOX.sub(" ", t)
    if any(map(t.__contains__, _UNIT_WORDS)):
        t = _UNIT.sub(" ", t)
    if _MAY_STICK.search(t):
        t = _STUCK.sub(r"\1 \2", _STUCK_SAINT.sub(r"\1 \2", t))
    if "-" in t or "–" in t:
        t = _RANGE.sub(r"\1", t)
    m = _ROUTE.search(t) if _MAY_ROUTE.search(t) else None
    if m and _BEFORE_ROUTE.match(t[: m.start()]):
        kind = re.sub(r"[^A-Z]", "", m["c"])
        if kind in ("HIGHWAY", "HWY", "ROUTE", "RTE"):
            cls = None
        else:
            cls = "US" if kind.startswith(("US", "FED")) else "COUNTY" if kind.startswith("C") else "STATE"
        before, after = t[: m.start()], t[m.end() :]
        number = _NUMBER.search(before) or re.match(r"\s*(?:[A-Z]+\.?)?\s*,\s*(\d+)\b", after)
        if not number:
            return None
        words = re.sub(r"[^A-Z ]+", " ", before).split()
        tail = re.match(r"\s*([A-Z]+)\.?\s*(?:,|$)", after)
        sides = [d for w in words if (d := _direction(w))] or ([d] if tail and (d := _direction(tail[1])) else [])
        return number[number.lastindex or 0].lstrip("0") or "0", f"RTE {m['n']}", cls, sides[0] if sides else None
    segments = [_SIGNS.sub(" ", s).replace("'", "").split() for s in t.split(",")]
    segments = [s for s in segments if s]
    if not segments:
        return None
    if _ORDINAL.match(segments[0][0]) and not (len(segments) > 1 and segments[1][0].isdigit()):
        number, words = "", segments[0]
    elif segments[0][0].isdigit():
        number, words, rest = segments[0][0], segments[0][1:], segments[1:]
        if not words and rest:
            words = rest[0]
    elif len(segments) > 1 and segments[1][0].isdigit():
        number, words = segments[1][0], segments[0]
    else:
        return None
    if not words:
        return None
    side, kind, i = None, None, 0
    if len(words) > 1 and (d := _direction(words[0])) and (not _type(words[1]) or (words[1] == "ST" and len(words) > 2)):
        side, i = d, 1
    while i < len(words) - 1 and (_prefix(words[i]) or (i and len(words[i]) == 1)) and not (_type(words[i + 1]) and len(words) - i == 2 and words[i] in ("ST",)):
        i += 1
    town = (city_key(city, "") or "|")[:-1]
    core, j = ([words[i]], i + 1) if i < len(words) else ([], i)
    if not core or (core[0].isalpha() and len(core[0]) < 3 and not kind):
        return None
    if not _ORDINAL.match(core[0]):
        j, tail = _street_end(words, i, town)
        core, words = words[i:j], words[:tail] if j < tail else words
    town = town.split()
    while j < len(words):
        w = words[j]
        if k := _type(w):
            kind = k
            j += 1
            break
        if (d := _direction(w)) and (j == len(words) - 1 or _type(words[j + 1]) or side is None):
            if town and d and town[0].startswith(w[:1]) and j < len(words) - 1:
                break
            side = side or d
            j += 1
            continue
        break
    if j < len(words) and side is None and (d := _direction(words[j])) and j == len(words) - 1:
        side = d
    if core[0] in STATES and len(words) < 3:
        return None
    if _ORDINAL.match(core[0]):  # often written together with the number
        return number.lstrip("0") + core[0], "ORDINAL", kind, side
    return number.lstrip("0") or "0", " ".join(core), kind, side


def zip9(code: str | None) -> str | None:
    """All nine digits, if there are so many."""
    if not code or (len(code) == 5 and code.isascii()):
        return None
    digits = re.sub(r"\D", "", code)
    digits = "0" + digits if len(digits) == 8 else digits
    return digits if len(digits) == 9 else None


PARTS = ("number", "street", "type", "side", "zip", "zip9", "town")
_GAP = "\x1f"


@lru_cache(50_000)
def packed_parts(address: str | None, city: str | None, state: str | None, code: str | None) -> str:
    """PARTS in one string, empty for null: one column costs less on the way from Python than seven."""
    number, street, kind, side = parse(address, city) or ("", "", None, None)
    return _GAP.join((number, street, kind or "", side or "", zip5(code) or "", zip9(code) or "", city_key(city, state) or ""))


@F.pandas_udf(StringType())
def _packed(address: pd.Series, city: pd.Series, state: pd.Series, code: pd.Series) -> pd.Series:
    texts = ([x if isinstance(x, str) else None for x in c] for c in (address, city, state, code))
    return pd.Series([packed_parts(*row) for row in zip(*texts, strict=True)], dtype=object)


def with_parts(df: DataFrame, address: str, city: str, state: str, zip_code: str) -> DataFrame:
    """``df`` and the parsed PARTS of its address columns; number is null without a street address. Only the four
    address columns go through Python, in Arrow batches."""
    read = _packed.asNondeterministic()  # else filters on the parts would be pushed down and parse again
    split = df.withColumn("__p", F.split(read(*(F.col(c).cast("string") for c in (address, city, state, zip_code))), _GAP))
    return split.withColumns({n: F.nullif(F.col("__p")[k], F.lit("")) for k, n in enumerate(PARTS)}).drop("__p")


def places(df: DataFrame) -> Column:
    """Keys of the place, from the ZIP code and from the city, as far as they are known."""
    return F.array_compact(F.array(F.concat(F.lit("Z"), "zip"), F.concat(F.lit("C"), "town")))


def compatible(a: str, b: str) -> Column:
    """The explicit rules for two writings with the same number in the same place: the streets are equal or, unless
    numbered or under five letters, within two letters (three if the full ZIP codes agree), streets of several words
    word by word, or written together; type and direction agree where both are known."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    same9 = F.coalesce(c(a, "zip9") == c(b, "zip9"), F.lit(False))
    letters = ~c(a, "street").rlike("^(RTE |ORDINAL)") & ~c(b, "street").rlike("^(RTE |ORDINAL)") & (F.length(c(a, "street")) >= 5)
    distance = F.levenshtein(c(a, "street"), c(b, "street"))
    most = F.when(same9, 3).otherwise(2)
    x, y = F.split(c(a, "street"), " "), F.split(c(b, "street"), " ")
    worded = F.forall(F.zip_with(x, y, lambda v, w: F.coalesce((v == w) | ((F.length(v) >= 5) & (F.levenshtein(v, w) <= most)), F.lit(False))), lambda ok: ok)
    together = F.replace(c(a, "street"), F.lit(" ")) == F.replace(c(b, "street"), F.lit(" "))
    several = c(a, "street").contains(" ") | c(b, "street").contains(" ")
    street = (c(a, "street") == c(b, "street")) | (letters & F.when(several, worded | together).otherwise(distance <= most))
    agree = street
    for name in ("type", "side"):
        agree = agree & F.coalesce(c(a, name) == c(b, name), F.lit(True))
    return agree


def location_links(nodes: DataFrame) -> DataFrame:
    """(node_a, node_b), node_a < node_b: writings (PARTS and ``node``) that denote the same street address.

    Candidates share the number and a place key. A writing without a type (or direction) that is compatible with two
    writings of different types (directions) is ambiguous: it is linked to neither unless the full ZIP codes agree.
    """
    keyed = nodes.withColumn("place", F.explode(places(nodes))).select("node", "number", "street", "type", "side", "zip9", F.xxhash64("place").alias("key"))
    keyed = keyed.repartition(F.col("key"), F.col("number"))
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.number") == F.col("b.number")) & (F.col("a.node") < F.col("b.node")) & compatible("a", "b")
    sure = F.coalesce(F.col("a.zip9") == F.col("b.zip9"), F.lit(False))
    against = F.coalesce(F.col("a.zip9") != F.col("b.zip9"), F.lit(False))
    partial = [F.col(f"a.{n}").isNull() != F.col(f"b.{n}").isNull() for n in ("type", "side")]
    pairs = a.join(b, on).select(
        F.col("a.node").alias("node_a"),
        F.col("b.node").alias("node_b"),
        sure.alias("sure"),
        F.coalesce("a.type", "b.type").alias("type"),
        F.coalesce("a.side", "b.side").alias("side"),
        F.when(partial[0], F.when(F.col("a.type").isNull(), F.col("a.node")).otherwise(F.col("b.node"))).alias("no_type"),
        F.when(partial[1], F.when(F.col("a.side").isNull(), F.col("a.node")).otherwise(F.col("b.node"))).alias("no_side"),
        ((partial[0] | partial[1]) & against).alias("against"),
    )
    pairs = cut(pairs.filter("not against").drop("against").distinct())
    vague = (
        pairs.filter("not sure and (no_type is not null or no_side is not null)")
        .select(F.explode(F.array(F.struct(F.col("no_type").alias("node"), F.col("type").alias("v"), F.lit(0).alias("w")), F.struct(F.col("no_side").alias("node"), F.col("side").alias("v"), F.lit(1).alias("w")))).alias("x"))
        .select("x.*")
        .filter("node is not null")
        .groupBy("node", "w")
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        .filter("lo <> hi")
    )
    vague_type = vague.filter("w = 0").select(F.col("node").alias("no_type"))
    vague_side = vague.filter("w = 1").select(F.col("node").alias("no_side"))
    certain = pairs.filter("sure or (no_type is null and no_side is null)")
    rest = pairs.filter("not sure and (no_type is not null or no_side is not null)")
    rest = rest.join(vague_type, "no_type", "left_anti").join(vague_side, "no_side", "left_anti")
    return certain.select("node_a", "node_b").unionByName(rest.select("node_a", "node_b"))


def same_location(records: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b, each once: records whose addresses denote one street address.

    ``records`` has record, address, city, state, zip_code; other columns are ignored. Null records and records without a
    street address are in no pair; a record with several writings is paired by each of them. An empty table gives no
    rows. Writings, not records, are compared, so a writing that a third of
    all records share costs one comparison; only its record pairs, which are the result, grow.
    """
    named = records.select(*(F.col(c).cast("string").alias(c) for c in ("record", "address", "city", "state", "zip_code"))).filter("record is not null and address is not null")
    parts = with_parts(named, "address", "city", "state", "zip_code").filter("number is not null")
    members = cut(parts.select("record", F.xxhash64(*PARTS).alias("node"), *PARTS).distinct())
    nodes = members.select("node", *PARTS).distinct()
    own = members.select("record", "node")
    links = location_links(nodes).unionByName(own.select(F.col("node").alias("node_a"), F.col("node").alias("node_b")).distinct())
    left = links.join(own.withColumnRenamed("node", "node_a").withColumnRenamed("record", "ra"), "node_a")
    both = left.join(own.withColumnRenamed("node", "node_b").withColumnRenamed("record", "rb"), "node_b")
    ends = both.filter("ra <> rb and (node_a <> node_b or ra < rb)")
    return ends.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")).distinct()

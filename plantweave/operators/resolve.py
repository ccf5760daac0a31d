"""Resolving source records into places: buckets, clusters, coordinate consensus, review queue."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m
from ..functions.text import DROPPED_WORDS, SITE_LABELS, STATES, company_key, company_shaped, name_similarity
from ..runtime import cut
from .graph import components

# Metres and ratio of the clustering tiers, records a bucket may have, and confidences.
NEAR_M, SAME_M, SPAN_M, CONSENSUS_M, ALIKE, BUCKET = 750.0, 50.0, 1_500.0, 100.0, 0.6, 500
#: Degrees of the cells in which the widest pair of a large group is sought, each size a multiple of the next.
CELLS = (8.0, 1.0, 0.125)
CONFIDENCE = {"singleton": 1.0, "1": 0.95, "2b": 0.80, "2": 0.75, "oversized_chain": 0.40}
CLUSTER_SCHEMA = (
    "account string, idx int, cluster long, tier string, confidence double, lat double, lon double, suspect boolean, "
    "review_a int, review_b int, metres double, similarity double"
)


def assign_accounts(records: DataFrame, aliases: Mapping[str, str], name: str, parent: str, fixed: str | None = None) -> DataFrame:
    """Adds ``account``: the fixed account if present, else the alias of the name's key, else the key; records with
    an empty key get one of their own. ``records`` has source and source_id. The aliases are a driver-side config."""
    key = company_key(F.coalesce(F.nullif(F.col(parent), F.lit("")), F.col(name)))
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else F.create_map().cast("map<string,string>")
    own = F.concat(F.lit("_unnamed_"), "source", F.lit("_"), F.coalesce("source_id", F.lit("")))
    account = F.coalesce(table[key], F.nullif(key, F.lit("")), own)
    return records.withColumn("account", F.coalesce(F.col(fixed), account) if fixed else account)


def split_oversized(records: DataFrame, cap: int = BUCKET) -> DataFrame:
    """Adds ``size`` and ``oversized``: the account has more than ``cap`` records. Counts are combined before the shuffle."""
    counts = records.groupBy("account").agg(F.count(F.lit(1)).alias("size")).withColumn("oversized", F.col("size") > cap)
    return records.join(counts, "account")


def near_in_bucket(records: DataFrame, metres: float = NEAR_M) -> DataFrame:
    """(account, id_a, id_b, metres): pairs of records of one account within ``metres``. The key of the join is the account,
    a band of latitude and a cell of longitude whose width fits its band, so that large accounts compare neighbours only; the
    last cell of a band borders on its first."""
    step = metres / EARTH_RADIUS_M * 57.29577951308232 * 1.000001
    # Cells of a band: as many as are at least ``step`` of arc wide at its end nearer to a pole, whose neighbours count too.
    pole = F.least((F.greatest(F.abs(F.col("band")), F.abs(F.col("band") + 1)) + 1) * step, F.lit(90.0))
    cells = F.greatest(F.floor(F.cos(F.radians(pole)) * (360.0 / step)), F.lit(1))
    cell = F.least(F.floor((F.col("lon") + 180) / 360 * F.col("cells")), F.col("cells") - 1)
    p = records.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("band", F.floor(F.col("lat") / step))
    a = p.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumn("cells", cells).withColumn("cell", cell)
    a = a.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("cell") + k, F.col("cells")) for k in (-1, 0, 1)))))).alias("a")
    b = p.withColumn("cells", cells).withColumn("cell", cell).alias("b")
    d = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    on = (F.col("a.account") == F.col("b.account")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") < F.col("b.id")) & (d <= metres)
    return a.join(b, on).select("a.account", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), d.alias("metres"))


def _metres(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    f, g = np.radians(lat), np.radians(lon)
    a = np.sin((f[:, None] - f) / 2) ** 2 + np.cos(f)[:, None] * np.cos(f) * np.sin((g[:, None] - g) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1)))


_DROP = re.compile(r"\b(?:" + "|".join(DROPPED_WORDS) + r")\b")
_LABEL = re.compile(rf"(?:{'|'.join(SITE_LABELS)})\s*#?\d*")


def _key(name: str) -> str:
    return " ".join(sorted(_DROP.sub(" ", re.sub("[^A-Z0-9 ]", " ", name.upper().replace("&", " AND "))).split()))


def _shaped(name: str) -> bool:
    t = name.strip()
    place = re.fullmatch(r"[A-Za-z .'\-]+,\s*([A-Za-z]{2})(?:\s*\(\w+\))?", t)
    return not (len(t) < 3 or re.fullmatch(r"[\d\s_.\-]+", t) or (place and place[1].upper() in STATES) or _LABEL.fullmatch(" ".join(t.lower().split())))


def consensus(metres: np.ndarray) -> tuple[int | None, set[int]]:
    """(position of the agreed point, positions that disagree): each point joins the first group whose first point is
    within CONSENSUS_M; the strictly largest group is right, on a tie nobody is."""
    firsts: list[int] = []
    group = []
    for i in range(len(metres)):
        at = next((k for k, f in enumerate(firsts) if metres[i, f] <= CONSENSUS_M), None)
        if at is None:
            at = len(firsts)
            firsts.append(i)
        group.append(at)
    if not firsts:
        return None, set()
    (best, n), *rest = Counter(group).most_common()
    if rest and rest[0][1] == n:
        return None, set(range(len(metres)))
    return firsts[best], {i for i, g in enumerate(group) if g != best}


def cluster_rows(account: str, idx: list[int], names: list[str | None], keys_: list[str | None], lat: np.ndarray, lon: np.ndarray) -> list[tuple]:
    """Rows of CLUSTER_SCHEMA for one account's records, given in the order of ``idx``.

    Equal address keys join first (tier 1). Then pairs of located records, in order and unless joined already: within
    SAME_M and a name that is no company's: joined (2b); within NEAR_M and names alike: joined (2); within NEAR_M
    only: a row for review. A cluster without a common address that spans more than SPAN_M is flagged and reviewed.
    """
    n = len(idx)
    label = np.arange(n)
    how: list[set[str]] = [set() for _ in range(n)]
    review = []

    def join(i: int, j: int, tier: str) -> None:
        lo, hi = sorted((label[i], label[j]))
        label[label == hi] = lo
        how[i].add(tier)
        how[j].add(tier)

    first_at: dict[str, int] = {}
    for j, key in enumerate(keys_):
        if key is not None and (i := first_at.setdefault(key, j)) != j:
            join(i, j, "1")
    located = np.flatnonzero(~np.isnan(lat) & ~np.isnan(lon))
    d = _metres(lat[located], lon[located])
    names = [x or "" for x in names]
    keys, shaped = [_key(x) for x in names], [_shaped(x) for x in names]
    for p, q in zip(*np.nonzero(np.triu(d <= NEAR_M, 1)), strict=True):
        i, j = int(located[p]), int(located[q])
        if label[i] == label[j]:
            continue
        if d[p, q] <= SAME_M and not (shaped[i] and shaped[j]):
            join(i, j, "2b")
            continue
        alike = SequenceMatcher(None, keys[i], keys[j]).ratio() if keys[i] and keys[j] else 0.0
        if alike >= ALIKE:
            join(i, j, "2")
        else:
            review.append((i, j, float(d[p, q]), alike))
    where = {int(g): k for k, g in enumerate(located)}
    out = []
    for cluster, (_, members) in enumerate(itertools.groupby(sorted(range(n), key=lambda i: (label[i], i)), key=lambda i: label[i])):
        own = list(members)
        tiers = set().union(*(how[i] for i in own))
        tier = "singleton" if len(own) == 1 else "1" if tiers <= {"1"} else "2b" if tiers <= {"1", "2b"} else "2"
        at = [where[i] for i in own if i in where]
        spot: tuple[float | None, float | None] = (None, None)
        suspects: set[int] = set()
        if at:
            sub = d[np.ix_(at, at)]
            if tier in ("singleton", "1"):
                point, off = consensus(sub)
                suspects = {int(located[at[k]]) for k in off}
                if point is not None:
                    spot = float(lat[located[at[point]]]), float(lon[located[at[point]]])
            elif sub.max() > SPAN_M:
                tier = "oversized_chain"
                x, y = np.unravel_index(int(np.argmax(np.triu(sub))), sub.shape)
                review.append((int(located[at[x]]), int(located[at[y]]), float(sub[x, y]), None))
            else:
                spot = float(lat[located[at]].mean()), float(lon[located[at]].mean())
        out += [(account, idx[i], cluster, tier, CONFIDENCE[tier], *spot, i in suspects, None, None, None, None) for i in own]
    return out + [(account, None, None, None, None, None, None, None, idx[i], idx[j], m, s) for i, j, m, s in review]


def cluster_batch(batch: pd.DataFrame) -> pd.DataFrame:
    """``cluster_rows`` of each account of a batch, which is ordered by account and idx."""
    out: list[tuple] = []
    if len(batch):
        account, idx = batch["account"].tolist(), batch["idx"].astype(int).tolist()
        names, keys = ([x if isinstance(x, str) else None for x in batch[c]] for c in ("name", "address_key"))
        lat, lon = batch["lat"].to_numpy(float), batch["lon"].to_numpy(float)
        ends = [i for i in range(1, len(account)) if account[i] != account[i - 1]] + [len(account)]
        for a, b in zip([0, *ends], ends):
            out += cluster_rows(account[a], idx[a:b], names[a:b], keys[a:b], lat[a:b], lon[a:b])
    return pd.DataFrame(out, columns=[c.split()[0] for c in CLUSTER_SCHEMA.split(", ")])


def _cluster_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if len(b):
            whole = b["account"] != b["account"].iat[-1]  # the last account may go on in the next batch
            held = b[~whole]
            yield cluster_batch(b[whole])
    if held is not None:
        yield cluster_batch(held)


def cluster(records: DataFrame, cap: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(members, review) of records (account, id, name, address_key, lat, lon).

    Accounts of up to ``cap`` records, so groups of a bounded size, go through ``cluster_rows`` in Python, many in one batch, as its
    result depends on the order of the pairs; in larger accounts every record stays alone, as the guard says; ``cluster_large``
    is the way to cluster those too. Order is by id.
    """
    sized = split_oversized(records, cap)
    small = sized.filter("not oversized and size > 1").withColumn("idx", F.row_number().over(Window.partitionBy("account").orderBy("id")))
    ordered = small.select("account", "idx", "name", "address_key", "lat", "lon").repartition("account").sortWithinPartitions("account", "idx")
    got = ordered.mapInPandas(_cluster_batches, CLUSTER_SCHEMA)
    ids = small.select("account", "idx", "id")
    members = got.filter("idx is not null").join(ids, ["account", "idx"]).select("account", "id", "cluster", "tier", "confidence", "lat", "lon", "suspect")
    alone = sized.filter("oversized or size = 1").select(
        "account", "id", F.when(F.col("size") == 1, F.lit(0).cast("long")).otherwise(F.xxhash64("id")).alias("cluster"), F.lit("singleton").alias("tier"), F.lit(1.0).alias("confidence"), "lat", "lon", F.lit(False).alias("suspect")
    )
    a = ids.select("account", F.col("idx").alias("review_a"), F.col("id").alias("record_a"))
    b = ids.select("account", F.col("idx").alias("review_b"), F.col("id").alias("record_b"))
    review = got.filter("review_a is not null").join(a, ["account", "review_a"]).join(b, ["account", "review_b"])
    return members.unionByName(alone), review.select("account", "record_a", "record_b", "metres", "similarity")


def cluster_large(records: DataFrame) -> DataFrame:
    """(account, id, cluster) of records (account, id, name, address_key, lat, lon) of accounts of any size: the connected
    components of the links that ``cluster_rows`` makes - equal address keys; within SAME_M and a name that is no
    company's; within NEAR_M and names alike - without the order of pairs, on which tiers and reviews depend. No group is
    held in one task. Null names are no company's; rows of a null id or account are left out. ``cluster`` is a number."""
    own = records.filter("account is not null and id is not null").withColumn("node", F.xxhash64("account", "id"))
    keyed = own.filter("address_key is not null")
    hub = keyed.groupBy("account", "address_key").agg(F.min("node").alias("h"))
    links = keyed.join(hub, ["account", "address_key"]).filter("node <> h").select(F.col("h").alias("node_a"), F.col("node").alias("node_b"))
    near = near_in_bucket(own)
    for side in ("a", "b"):
        named = own.select("account", F.col("id").alias(f"id_{side}"), F.col("name").alias(f"name_{side}"), F.col("node").alias(f"node_{side}"), company_shaped(F.col("name")).alias(f"shaped_{side}"))
        near = near.join(named, ["account", f"id_{side}"])
    near = cut(near)
    same = (F.col("metres") <= SAME_M) & ~(F.col("shaped_a") & F.col("shaped_b"))
    alike = near.filter(~same).withColumn("r", name_similarity(F.col("name_a"), F.col("name_b"))).filter(F.col("r") >= ALIKE)
    links = links.unionByName(near.filter(same).select("node_a", "node_b")).unionByName(alike.select("node_a", "node_b"))
    return own.join(components(links), "node", "left").select("account", "id", F.coalesce("place", "node").alias("cluster"))


def _cell(size: float) -> Column:
    return F.floor((F.col("lat") + 90) / size) * 1_000_000 + F.floor((F.col("lon") + 180) / size)


def _far_cells(points: DataFrame) -> DataFrame:
    """(grp, ca, cb), ca <= cb: pairs of cells of the finest of CELLS that may hold a group's widest pair. From level
    to level, a pair of cells goes whose boxes can't reach as far as two points known from the group do."""
    live = None
    for k in range(len(CELLS)):
        keys = ["grp", f"c{k}"] + ([f"c{k - 1}"] if k else [])
        box = points.groupBy(*keys).agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lat", "lon")), F.min(F.struct("id", "lat", "lon")).alias("one"))
        mid = {c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in ("lat", "lon")}
        half = F.radians((F.col("max_lat") - F.col("min_lat") + F.col("max_lon") - F.col("min_lon")) / 2) * EARTH_RADIUS_M
        box = box.select("grp", F.col(f"c{k}").alias("c"), (F.col(f"c{k - 1}") if k else F.lit(0).cast("long")).alias("up"), mid["lat"].alias("lat"), mid["lon"].alias("lon"), half.alias("half"), "one")
        a, b = box.alias("a"), box.alias("b")
        if live is None:
            both = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.c") <= F.col("b.c")))
        else:
            both = live.alias("l").join(a, (F.col("l.grp") == F.col("a.grp")) & (F.col("l.ca") == F.col("a.up")))
            both = both.join(b, (F.col("l.grp") == F.col("b.grp")) & (F.col("l.cb") == F.col("b.up")) & ((F.col("a.up") < F.col("b.up")) | (F.col("a.c") <= F.col("b.c"))))
        reach = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) + F.col("a.half") + F.col("b.half")
        sure = F.when(F.col("a.one.id") != F.col("b.one.id"), haversine_m(F.col("a.one.lat"), F.col("a.one.lon"), F.col("b.one.lat"), F.col("b.one.lon")))
        both = cut(both.select("a.grp", F.col("a.c").alias("ca"), F.col("b.c").alias("cb"), reach.alias("reach"), sure.alias("sure")))
        known = both.groupBy("grp").agg(F.coalesce(F.max("sure"), F.lit(0.0)).alias("known"))
        live = both.join(known, "grp").filter(F.col("reach") + 1 >= F.col("known")).select("grp", "ca", "cb")  # 1 m for rounding
    return live


def diameters(members: DataFrame, cap: int = BUCKET) -> DataFrame:
    """(group, id_a, id_b, metres): the widest pair of each group of located rows (grp, id, lat, lon); of equally wide
    pairs the first. Groups of over ``cap`` points compare only the points of cells that may hold the widest pair; a
    point shared by many records counts with its first two, which are enough for the first of its pairs."""
    w = Window.partitionBy("grp", "lat", "lon").orderBy("id")
    points = members.select("grp", "id", "lat", "lon").distinct().withColumn("k", F.row_number().over(w)).filter("k <= 2").drop("k")
    points = cut(points.withColumns({f"c{k}": _cell(size) for k, size in enumerate(CELLS)}))
    large = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("grp")
    small, big = points.join(large, "grp", "left_anti"), cut(points.join(large, "grp"))
    d = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    out = (F.col("a.grp").alias("grp"), F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), d.alias("metres"))
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.id") < F.col("b.id"))).select(*out)
    cell = f"c{len(CELLS) - 1}"
    far = _far_cells(big).alias("l").join(big.alias("a"), (F.col("l.grp") == F.col("a.grp")) & (F.col("l.ca") == F.col(f"a.{cell}")))
    once = (F.col("a.id") < F.col("b.id")) | ((F.col("l.ca") < F.col("l.cb")) & (F.col("a.id") > F.col("b.id")))
    far = far.join(big.alias("b"), (F.col("l.grp") == F.col("b.grp")) & (F.col("l.cb") == F.col(f"b.{cell}")) & once).select(*out)
    w = Window.partitionBy("grp").orderBy(F.desc("metres"), "id_a", "id_b")
    return pairs.unionByName(far).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")

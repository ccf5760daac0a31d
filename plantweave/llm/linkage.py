"""Matching entities across sources without keys (problem 1): soft logic, solved by alternating directions.

The model is a hinge-loss Markov random field over the operator names found at one location, with the unknowns "names p and
q at this place are one operator" and "the records without a usable name belong to operator p". Weighted rules:

* similarity: names of one place that are spelt alike are one operator (how strongly depends on the spelling);
* a record that goes by both names supports that they are one;
* exclusivity: a source in which a plant is one record and that lists p and q under different records speaks against
  them being one; a record without a name belongs to one operator at most, unless two are one;
* transitivity: same(p, q) and same(q, r) imply same(p, r), so that q is one with p or r only where those are held apart;
* prior: names are different, records belong nowhere.

A record goes to the best supported name of its operator, as surely as its own evidence (name, address) and the solved
value allow; two records match as far as both belong there: match = belong(a) + belong(b) - 1. Candidates come by address
(all writings of one location, through chains of any length) and, for rows without a street address, by name and area.
Rules never join two locations, so the convex problem falls into blocks by location, over distinct names, not records.
Blocks are spread over the partitions; each partition solves all its blocks at once by the alternating direction method of
multipliers, until residuals are below TOLERANCE.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.graph import components
from ..runtime import checked_broadcast, cut, keep_only, salted, tables_written
from .addresses import PARTS, location_links, packed_parts
from .names import Reader, _swapped, edits, learnt_words

#: Weights of the rules; evidence and the nameless rule are squared hinges, the others linear.
WEIGHTS = {"alike": 5.0, "record": 5.0, "nameless": 2.0, "prior": 0.15, "two_records": 1.0, "one_plant": 20.0, "transitive": 20.0}
ACCEPT, ALIKE, STEP, TOLERANCE, ROUNDS = 0.55, 0.7, 3.0, 1e-5, 2_000
#: Rounds between looks for places that are solved.
LOOK = 5
#: Rows of names that are solved together.
SOLVED_AT_ONCE = 50_000
#: Sources in which a plant is one record; a record of another source is a company.
ONE_RECORD = ("epa", "osha")


def _near(x: str, y: str) -> float:
    """1 for equal words, 0.9 for one edit or two swapped neighbours in four letters or more, else the share of letters kept;
    0 if under half of the letters can be kept, which no comparison of names tells from any other value under one half."""
    if x == y:
        return 1.0
    if abs(len(x) - len(y)) > 3:
        return 0.0
    i, m, n = 0, len(x), len(y)
    least = m if m < n else n
    while i < least and x[i] == y[i]:
        i += 1
    while m > i and n > i and x[m - 1] == y[n - 1]:
        m, n = m - 1, n - 1
    a, b = x[i:m], y[i:n]  # what differs: its edits are those of the words
    if 2 * max(len(set(a).difference(b)), len(set(b).difference(a))) > max(len(x), len(y)):
        return 0.0
    d = edits(a, b)
    if min(len(x), len(y)) >= 4 and (d == 1 or (d == 2 and _swapped(x, y))):
        return 0.9
    return 1.0 - d / max(len(x), len(y), 1)


def _joint(words: list[tuple[str, str, float]]) -> float:
    """Of the pairs of differing words: their mean by length if none is under one half, else the weakest."""
    weakest = min(s for *_, s in words)
    return weakest if weakest < 0.5 else sum(s * max(len(x), len(y)) for x, y, s in words) / sum(max(len(x), len(y)) for x, y, _ in words)


@lru_cache(100_000)
def name_similarity(a: str, b: str) -> float:
    """Of two operator keys "WORDS|TRADES|INITIALS": that of the words that differ in the best order, or of the words
    written together; 0.9 if one has words, or its only word's partner, more; halved if both trades are known and differ."""
    (wa, ta, ia), (wb, tb, ib) = a.split("|"), b.split("|")
    xs, ys = wa.split(), wb.split()
    few, many, first = (xs, ys, ia) if len(xs) <= len(ys) else (ys, xs, ib)
    if not few:
        return 0.0
    trades = 1.0 if not (ta and tb) or set(ta.split("/")) & set(tb.split("/")) else 0.9 if edits(ta, tb) <= 2 and "/" not in ta + tb and ta[0] == tb[0] else 0.5
    rest, more = [x for x in few if x not in many], [y for y in many if y not in few]
    if not rest:
        best = 1.0 if not more else 0.9 if len(few) > 1 or not first or any(y[0] == first[0] for y in more) else 0.5
    elif len(few) == len(many):
        ways = itertools.permutations(more) if len(rest) <= 3 else [more]
        best = max(_joint([(x, y, _near(x, y)) for x, y in zip(rest, p)]) for p in ways)
    else:
        best = max(_near("".join(x), "".join(y)) for x in (few, few[::-1]) for y in (many, many[::-1]))
        if len(few) > 1:  # a word more, such as a misspelt trade
            best = max(best, 0.95 * min(max(_near(x, y) for y in more) for x in rest))
        elif not first or any(y[0] == first[0] for y in many):
            best = max(best, 0.9 * max(_near(rest[0], y) for y in more))
    return best * trades


def solve(n: int, weight: np.ndarray, offset: np.ndarray, squared: np.ndarray, rule: np.ndarray, var: np.ndarray, coef: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
    """Values in [0, 1] that minimise the sum of weight * max(0, coef . x + offset) ** (2 if squared else 1).

    ``rule``, ``var`` and ``coef`` list the entries of the rules. Each rule keeps its own copies of its variables and
    moves them in closed form; a variable becomes the mean of its copies; multipliers settle the difference. Rounds end
    when no copy differs from its variable, and no variable moves, by more than TOLERANCE. ``block`` has the number of the
    part of the problem each variable is in, if no rule joins two parts: each part then ends by itself, as if it were alone.
    """
    k = len(weight)
    norm = np.maximum(np.bincount(rule, coef * coef, k), 1e-12)
    copies = np.maximum(np.bincount(var, minlength=n), 1)
    z, out, at = np.full(n, 0.5), np.full(n, 0.5), np.arange(n)
    block = np.zeros(n, dtype=np.int64) if block is None else block
    u = np.zeros(len(var))
    for turn in range(1, ROUNDS + 1):
        v = z[var] - u
        s = np.bincount(rule, coef * v, k) + offset
        flat = np.minimum(s / norm, weight / STEP)
        curved = 2 * weight * s / (STEP + 2 * weight * norm)
        move = np.where(s > 0, np.where(squared, curved, flat), 0.0)
        x = v - move[rule] * coef
        new = np.clip(np.bincount(var, x + u, n) / copies, 0.0, 1.0)
        apart = x - new[var]
        u += apart
        moved, z = np.abs(new - z), new
        if turn % LOOK:
            continue
        going = np.zeros(block.max(initial=0) + 1, dtype=bool)
        going[block[moved >= TOLERANCE]] = True
        going[block[var[np.abs(apart) >= TOLERANCE]]] = True
        if going.sum() > 0.8 * len(np.unique(block)):
            continue
        stay = going[block]
        out[at[~stay]] = z[~stay]
        if not stay.any():
            return out
        entries, number = stay[var], np.cumsum(stay) - 1
        rules = np.unique(rule[entries])
        weight, offset, squared, norm = weight[rules], offset[rules], squared[rules], norm[rules]
        rule, var, coef, u = np.searchsorted(rules, rule[entries]), number[var[entries]], coef[entries], u[entries]
        z, copies, block, at, n, k = z[stay], copies[stay], block[stay], at[stay], int(stay.sum()), len(rules)
    out[at] = z
    return out


@lru_cache(100_000)
def _ends(op: str) -> frozenset[str]:
    """The beginnings and ends of the words of a name."""
    return frozenset(k for w in op.split("|")[0].split() for k in (w[:3], "-" + w[-3:]))


def _candidates(ops: list[str], told: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Pairs of names of one place with their similarity: those alike, and those one record goes by. Only names that share
    the beginning or the end of a word are compared."""
    found = dict.fromkeys(told)
    if len(ops) < 10:
        ends = [_ends(op) for op in ops]
        found |= dict.fromkeys((i, j) for j in range(1, len(ops)) for i in range(j) if not ends[i].isdisjoint(ends[j]))
    else:
        keys = defaultdict(list)
        for i, op in enumerate(ops):
            for key in _ends(op):
                keys[key].append(i)
        for own in keys.values():
            found |= dict.fromkeys(itertools.combinations(own, 2))
    return {(i, j): s for i, j in found if (s := name_similarity(ops[i], ops[j])) >= ALIKE or (i, j) in told}


def ground(ops: list[str], listed: list[int], told: set[tuple[int, int]]) -> tuple[list[tuple[int, int]], list]:
    """(variables, rules) of one place, or the one variable and its value. A variable is the pair (p, q) of names that may be one operator; a rule is (weight,
    offset, squared, [(variable, coefficient), ...]). ``listed`` has the bits of the ONE_RECORD sources of each name,
    ``told`` the pairs of names that one record goes by."""
    w, rules = WEIGHTS, []
    pairs = _candidates(ops, told)
    if not pairs:
        return [], []
    if len(pairs) == 1:  # one unknown: the optimum is known
        (p, q), s = next(iter(pairs.items()))
        alike, one = (w["alike"] if s >= ALIKE else 0.0), (w["record"] if (p, q) in told else 0.0)
        against = w["prior"] + (w["two_records"] if listed[p] & listed[q] and not one else 0.0)
        return [(p, q)], [min(1.0, max(0.0, (alike * min(1.0, (s - 0.4) / 0.5) + one - against / 2) / (alike + one)))]
    near = defaultdict(set)
    for p, q in pairs:
        near[p].add(q)
        near[q].add(p)
    triples = [(p, q, r) for q, own in near.items() for p, r in itertools.combinations(sorted(own), 2)]
    variables = list(dict.fromkeys([*pairs, *((p, r) for p, _, r in triples)]))
    at = {p: v for v, p in enumerate(variables)}
    for v, (p, q) in enumerate(variables):
        if pairs.get((p, q), 0.0) >= ALIKE:
            rules.append((w["alike"], min(1.0, (pairs[p, q] - 0.4) / 0.5), True, [(v, -1.0)]))
        if (p, q) in told:
            rules.append((w["record"], 1.0, True, [(v, -1.0)]))
        apart = listed[p] & listed[q] and (p, q) not in told
        rules.append((w["prior"] + (w["two_records"] if apart else 0.0), 0.0, False, [(v, 1.0)]))
    for p, q, r in triples:
        rules.append((w["transitive"], -1.0, False, [(at[min(p, q), max(p, q)], 1.0), (at[min(q, r), max(q, r)], 1.0), (at[p, r], -1.0)]))
    return variables, rules


def _hubs(ops: list[str], weight: list[int], same: dict[tuple[int, int], float]) -> list[tuple[int, float]]:
    """(hub, value) of each name: the best supported of the names it is one with, itself included, and the weakest link
    on the way there."""
    linked = defaultdict(list)
    for (p, q), v in same.items():
        if v >= 0.5:
            linked[p].append((q, v))
            linked[q].append((p, v))
    hub = [(i, 1.0) for i in range(len(ops))]
    taken: set[int] = set()
    for h in sorted(range(len(ops)), key=lambda i: (-weight[i], -len(ops[i].split("|")[0]), ops[i])):
        if h in taken:
            continue
        taken.add(h)
        todo = [(h, 1.0)]
        while todo:
            i, value = todo.pop()
            hub[i] = (h, value)
            for j, v in linked[i]:
                if j not in taken:
                    taken.add(j)
                    todo.append((j, min(value, v)))
    return hub


def solve_places(block: pd.DataFrame) -> pd.DataFrame:
    """(place, op, hub, value) of the names of whole places (place, op, listed, n, other), in order of place.

    A row with ``other`` says that one record goes by both names; one without a name stands for the nameless records of the
    place. For those the optimum is known: with k operators left, evidence and exclusivity meet at the least of
    1 - prior / (2 weight) and 1 / k, the same for each operator.
    """
    place, op, other = block["place"].to_numpy(), block["op"].to_numpy(dtype=object), block["other"].to_numpy(dtype=object)
    listed, n = block["listed"].to_numpy(), block["n"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, dtype=int)
    ends = np.append(starts[1:], len(place))
    named, tells = block["op"].notna().to_numpy(), block["other"].notna().to_numpy()
    whole = (ends - starts > 1) | ~named[starts]  # a name that is alone is its own operator
    listed, n = listed.tolist(), n.tolist()
    groups, grounded = [], []
    for s, e in zip(starts[whole].tolist(), ends[whole].tolist()):
        rows = [i for i in range(s, e) if named[i] and not tells[i]]
        ops = [op[i] for i in rows]
        index = {o: k for k, o in enumerate(ops)}
        told = {tuple(sorted((index[op[i]], index[other[i]]))) for i in range(s, e) if tells[i] and other[i] in index and op[i] in index}
        groups.append((place[s], ops, [n[i] for i in rows], any(not named[i] for i in range(s, e))))
        grounded.append(ground(ops, [listed[i] for i in rows], told) if len(ops) > 1 else ([], []))
    base, weight, offset, squared, sizes, var, coef, block = 0, [], [], [], [], [], [], []
    for part, (variables, rules) in enumerate(grounded):
        if len(variables) < 2:
            continue
        weight += [r[0] for r in rules]
        offset += [r[1] for r in rules]
        squared += [r[2] for r in rules]
        sizes += [len(r[3]) for r in rules]
        var += [base + v for r in rules for v, _ in r[3]]
        coef += [x for r in rules for _, x in r[3]]
        base += len(variables)
        block += [part] * len(variables)
    values = solve(base, np.array(weight), np.array(offset), np.array(squared, dtype=bool), np.repeat(np.arange(len(sizes)), sizes), np.array(var, dtype=np.int64), np.array(coef), np.array(block, dtype=np.int64)) if base else np.zeros(0)
    out, at = [], 0
    for (where, ops, support, nameless), (variables, rules) in zip(groups, grounded):
        if len(variables) == 1:
            same = {variables[0]: rules[0]}
        else:
            same = {p: float(values[at + k]) for k, p in enumerate(variables)}
            at += len(variables)
        hubs = _hubs(ops, support, same) if same else [(i, 1.0) for i in range(len(ops))]
        out += [(where, ops[i], ops[h], v) for i, (h, v) in enumerate(hubs) if h != i]
        left = sorted({h for h, _ in hubs})
        if nameless:
            best = min(1 - WEIGHTS["prior"] / (2 * WEIGHTS["nameless"]), 1 / max(len(left), 1))
            out += [(where, None, ops[h], best) for h in left if best >= ACCEPT] or ([(where, None, "", best)] if not ops else [])
    return pd.DataFrame(out, columns=["place", "op", "hub", "value"])


def operators_of(names: DataFrame) -> DataFrame:
    """(place, op, hub, value): the names of a place that are another name's operator, and the operator of its nameless
    records (op null), if there is one; a name that isn't listed is its own operator."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= SOLVED_AT_ONCE:
                b = pd.concat(held, ignore_index=True)
                whole = b["place"] != b["place"].iat[-1]  # the last place may go on in the next batch
                held = [b[~whole]]
                if whole.any():
                    yield solve_places(b[whole])
        if sum(map(len, held)):
            yield solve_places(pd.concat(held, ignore_index=True))

    return names.repartition("place").sortWithinPartitions("place").mapInPandas(run, "place long, op string, hub string, value double")


# --- records ----------------------------------------------------------------------------------------------------

_GAP, _NEXT = "\x1f", "\x1e"


def _read(base: DataFrame, reader: Reader) -> DataFrame:
    """record, source, PARTS and ``ops``, the operator keys of the names of each row. One pass through Python."""

    @F.pandas_udf(StringType())
    def packed(address: pd.Series, city: pd.Series, state: pd.Series, code: pd.Series, names: pd.Series) -> pd.Series:
        texts = ([x if isinstance(x, str) else None for x in c] for c in (address, city, state, code))
        out = []
        for parts, all_ in zip(zip(*texts, strict=True), names, strict=True):
            ops = []
            for name in dict.fromkeys(all_.split(_NEXT) if isinstance(all_, str) and all_ else ()):
                if op := reader.cached_key(name):
                    ops.append(op)
            out.append(packed_parts(*parts) + _GAP + _NEXT.join(dict.fromkeys(ops)))
        return pd.Series(out, dtype=object)

    cells = [F.col(c).cast("string") for c in ("address", "city", "state", "zip_code")]
    split = base.select("record", "source", F.split(packed.asNondeterministic()(*cells, F.array_join("names", _NEXT)), _GAP).alias("p"))
    ops = F.filter(F.split(F.col("p")[len(PARTS)], _NEXT), lambda x: x != "").alias("ops")
    return split.select("record", "source", *(F.nullif(F.col("p")[k], F.lit("")).alias(n) for k, n in enumerate(PARTS)), ops)


def _placed(rows: DataFrame, edits_most: int = 3) -> DataFrame:
    """(record, source, place, op): rows without an address that name an operator, each with the place it goes to.

    In the area of the row the plants are looked for whose names have the same words, else those with the fewest edits up to
    ``edits_most`` that share a word and don't differ in trade; only plants of lost names are shuffled.
    """
    lost = cut(rows.filter("place is null and op is not null").select("record", "source", "op", "zip", "town").distinct())
    areas = F.explode(F.array_compact(F.array(F.concat(F.lit("Z"), "zip"), F.concat(F.lit("C"), "town")))).alias("area")
    words, trade = (lambda c: F.split(c, r"\|")[0]), (lambda c: F.split(c, r"\|")[1])
    keyed = lambda df, *more: df.select("op", areas, *more).withColumn("w", F.explode(F.split(words(F.col("op")), " "))).withColumn("key", F.xxhash64("area", "w")).drop("w")
    located = rows.filter("place is not null")
    asked = cut(keyed(lost).distinct())
    plants = keyed(located.filter("op is not null").select("op", "zip", "town", "place"), "place")
    plants = plants.join(checked_broadcast(asked.select("key").distinct(), 1_000_000), "key", "left_semi").select("key", F.col("op").alias("other"), "place").distinct()
    apart = F.levenshtein(words(F.col("op")), words(F.col("other")), edits_most)
    fits = (apart >= 0) & ((trade(F.col("op")) == trade(F.col("other"))) | (trade(F.col("op")) == "") | (trade(F.col("other")) == "") | (F.col("op") == F.col("other")))
    near = asked.join(plants, "key").filter(fits).groupBy("op", "area", "place").agg(F.min(apart).alias("d"))
    best = near.groupBy("op", "area").agg(F.min("d").alias("least"))
    plants = near.join(best, ["op", "area"]).filter("d = least").groupBy("op", "area").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    own = located.join(lost.select("record").distinct(), "record", "left_semi").select("record", areas).distinct().withColumn("own", F.lit(True))
    wanted = lost.select("record", "source", "op", "town", "zip", areas).join(own, ["record", "area"], "left").join(plants, ["op", "area"], "left")
    by_area = [F.max(F.when(F.col("area").startswith(a), F.col(c))).alias(c + a) for a in "ZC" for c in ("own", "lo", "hi")]
    found = wanted.groupBy("record", "source", "op", "town", "zip").agg(*by_area)
    only = {a: F.when(F.col("own" + a).isNull() & (F.col("lo" + a) == F.col("hi" + a)), F.col("lo" + a)) for a in "ZC"}
    # The ZIP code decides if it has a plant of the operator, or the record itself; else the city. Two answers are none.
    by_zip = F.when(F.coalesce(only["Z"] == only["C"], F.lit(True)), only["Z"])
    place = F.when(F.col("ownZ").isNotNull() | F.col("loZ").isNotNull(), by_zip).otherwise(only["C"])
    none = F.coalesce("ownZ", "ownC").isNull() & F.coalesce("loZ", "loC").isNull()
    found = found.withColumn("place", F.when(none, F.xxhash64("op", F.coalesce("town", "zip"))).otherwise(place))
    return found.filter("place is not null").select("record", "source", "place", "op")


def _evidence(placeless: bool) -> Column:
    """How surely a row belongs to the operator it names: less without trade, street type or ZIP code, or placed by area."""
    trade = F.split(F.col("op"), r"\|")[1]
    gaps = [F.when((trade == "") | trade.contains("/"), 0.03).otherwise(0.0)]
    gaps += [F.lit(0.08)] if placeless else [F.when(F.col("type").isNull(), 0.02).otherwise(0.0), F.when(F.col("zip").isNull(), 0.02).otherwise(0.0)]
    out = F.lit(1 - WEIGHTS["prior"] / (2 * WEIGHTS["alike"]))
    for g in gaps:
        out = out - g
    return out


def memberships(records: DataFrame) -> DataFrame:
    """(record, source, plant, value): the operator at a location that each record describes, and how surely.

    ``records`` has record, source, names (array), address, city, state, zip_code, several rows a record allowed; other
    columns are ignored. Null records take no part; a record without name and without address belongs nowhere; an
    empty table gives no rows. A record's names and addresses count together. A row without a street address, unless its
    record is placed in the same ZIP code or city by another row, is placed where its operator has its only located
    plant of that ZIP code or, if that has none, of that city; where there are several it stays out, and where
    there is none, rows without an address meet under operator and city.
    """
    mark = tables_written()
    base = records.filter("record is not null").select("record", "source", "names", *(F.col(c).cast("string").alias(c) for c in ("address", "city", "state", "zip_code")))
    strings = base.select(F.explode("names").alias("name")).filter("name is not null").distinct()
    read = cut(_read(base, Reader(*learnt_words(strings))).withColumn("node", F.when(F.col("number").isNotNull(), F.xxhash64(*PARTS))))
    places = components(location_links(read.filter("node is not null").select("node", *PARTS).distinct()))
    rows = read.select("record", "source", "node", "type", "zip", "town", F.explode_outer("ops").alias("op")).join(places.hint("shuffle_hash"), "node", "left")  # a row a node: no key is hot on this side
    rows = cut(rows.withColumn("place", F.coalesce("place", "node")).drop("node"))
    keep_only(mark, rows)
    near = rows.filter("place is not null").select("record", "source", "place", "op", F.when(F.col("op").isNotNull(), _evidence(False)).otherwise(0.97).alias("value"))
    far = _placed(rows).withColumn("value", _evidence(True))
    members = near.unionByName(far).groupBy("record", "source", "place", "op").agg(F.max("value").alias("value"))
    members = cut(members)
    keep_only(mark, members)
    bit = F.lit(0)
    for k, source in enumerate(ONE_RECORD):
        bit = F.when(F.col("source") == source, 1 << k).otherwise(bit)
    none = F.lit(None).cast("string").alias("other")
    names = members.groupBy("place", "op").agg(F.bit_or(bit).alias("listed"), F.count(F.lit(1)).alias("n")).select("place", "op", "listed", "n", none)
    first = members.filter("op is not null").groupBy("record", "place").agg(F.min("op").alias("op"), F.max("op").alias("other"))
    told = first.filter("op <> other").select("place", "op", F.lit(0).alias("listed"), F.lit(0).cast("long").alias("n"), "other").distinct()
    solved = operators_of(names.unionByName(told))
    solved = solved.select(F.col("place").alias("at"), F.col("op").alias("name"), "hub", F.col("value").alias("same"))
    joined = members.join(solved.hint("shuffle_hash"), (F.col("place") == F.col("at")) & F.col("op").eqNullSafe(F.col("name")), "left").filter("op is not null or hub is not null")
    plant = F.xxhash64("place", F.coalesce("hub", "op")).alias("plant")
    belongs = joined.select("record", "source", plant, (F.col("value") + F.coalesce("same", F.lit(1.0)) - 1).alias("value"))
    return belongs.groupBy("record", "source", "plant").agg(F.max("value").alias("value"))


def link_records(records: DataFrame) -> DataFrame:
    """(record_a, record_b, confidence), record_a < record_b: records of different sources that describe one plant, with a
    confidence of ACCEPT or more; see ``memberships`` for records and cases."""
    mark = tables_written()
    belongs = cut(memberships(records).filter(F.col("value") >= ACCEPT))
    keep_only(mark, belongs)
    build, probe = salted(belongs, belongs, "plant", "record", 20_000)
    a, b = probe.alias("a"), build.alias("b")
    match = F.col("a.value") + F.col("b.value") - 1
    meets = (F.col("a.plant") == F.col("b.plant")) & (F.col("a.__salt") == F.col("b.__salt")) & (F.col("a.source") < F.col("b.source")) & (match >= ACCEPT)
    pairs = a.join(b, meets).groupBy(F.least("a.record", "b.record").alias("record_a"), F.greatest("a.record", "b.record").alias("record_b"))
    return pairs.agg(F.max(match).alias("confidence"))

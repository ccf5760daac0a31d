"""Leakage, personal details and packing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantweave.llm import leakage, packing, pii


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.randint(0, 4) for _ in range(rng.randint(1, 9))]
        t = [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]
        for k in (0, 1, 2):
            best = min((edits(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1)), default=len(p))
            if len(p) > k:
                assert leakage.myers_within(p, t, k) == (best <= k)


def leaks_by_brute_force(docs, items, window=25):
    out = set()
    for d, text in docs:
        w = leakage.words_of(text)
        for i, item in items:
            v = leakage.words_of(item)
            hit = False
            for s in range(len(v) - window + 1):
                p = v[s : s + window]
                for a in range(max(0, len(w) - window + 2)):
                    for n in (window - 1, window, window + 1):
                        if a + n <= len(w) and edits(p, w[a : a + n]) <= 1:
                            hit = True
            if hit:
                out.add((d, i))
    return out


def test_bitmap_holds_its_runs_and_little_else(spark):
    rng = random.Random(7)
    own = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(3_000)] + [0, 1, 1 << 16, 32_768, 32_769]
    bits = leakage.bitmap(spark.createDataFrame([(h,) for h in own], "h long"), 1 << 16)
    has = lambda hs: (bits[(at := leakage._bit_of(np.array(hs, dtype=np.int64) & 0xFFFF))[0]] >> at[1]) & 1
    positions = {h & 0xFFFF for h in own}
    assert has(own).all() and [h for h in range(1 << 16) if has([h])[0]] == sorted(positions)


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((40, 30, 26, 24, 0))] + [(9, None)]
    docs = []
    for d in range(24):
        noise = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 15)))
        v = items[d % 4][1].split()
        n = rng.choice((12, 24, 25, 26, 30))
        s = rng.randint(0, max(0, len(v) - n))
        part = v[s : s + n]
        kind = d % 5
        if part and kind == 1:
            part[rng.randrange(len(part))] = "changed"
        elif part and kind == 2:
            del part[rng.randrange(len(part))]
        elif part and kind == 3:
            part.insert(rng.randrange(len(part)), "added")
        elif kind == 4 and len(part) > 20:
            part[5], part[15] = "two", "edits"
        quote = " ".join(part).upper() if d % 2 else "“" + ",\n> ".join(part) + "!”"
        docs.append((d, f"{noise()} {quote} {noise()}"))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "x " * 60_000 + items[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    real = [(d, t) for d, t in docs if d is not None and t and d != 102]
    want = leaks_by_brute_force(real, [(i, t) for i, t in items if t]) | {(102, 0)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(df, it).collect()} == want and len(want) > 5
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(df, it, bits=1 << 8).collect()} == want  # a bitmap too small to filter
    twice = spark.createDataFrame([(0, "w1 " * 30), (0, items[1][1]), (0, items[0][1])], "item_id long, text string")
    assert {r.doc_id for r in leakage.leaks(df, twice).collect()} == {d for d, i in want if i in (0, 1)}
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


TEXT = """Contact Dr. Alex Fovitwick at alexandra+shop@north.works.example or (515)555-0145. Part no. 555-0192 of the wash rack is old.
Regards,
Kortindgate, Patricia
423-555-0167 ext. 421.
The injured worker, THOMAS FLURTULANDER, gave taxpayer ID 971 23 7350 on the intake form. Award AM24D577667804 and registry number 110400680689 stand.
Home address: 7281 N. Foundrybank Ln, Unit 36, Peskul Falls, IA 41163; cell +44 20 7946 0360. Reply-To: s.flick (at) plant-office dot test
Its rival William Buldenumber Coatings LLC closed. According to Thos. R. Jeritiva, it was swept. El trabajador vive en 1128 Dairybrook Ln. Llame a José Cruz al 8155550166 antes."""


def test_details():
    got = {(k, TEXT[s:e]) for s, e, k in pii.details([TEXT])[0]}
    assert got == {
        ("NAME", "Alex Fovitwick"), ("EMAIL", "alexandra+shop@north.works.example"), ("PHONE", "(515)555-0145"), ("NAME", "Kortindgate, Patricia"), ("PHONE", "423-555-0167 ext. 421"),
        ("NAME", "THOMAS FLURTULANDER"), ("ID", "971 23 7350"), ("ADDRESS", "7281 N. Foundrybank Ln, Unit 36, Peskul Falls, IA 41163"), ("PHONE", "+44 20 7946 0360"),
        ("EMAIL", "s.flick (at) plant-office dot test"), ("NAME", "Thos. R. Jeritiva"), ("ADDRESS", "1128 Dairybrook Ln"), ("NAME", "José Cruz"), ("PHONE", "8155550166"),
    }


REPEATS = "Witnessed by Dr. Uxor Fovitwick. Smith saw Uxor Fovitwick there; later U. Fovitwick left, and Fovitwick called Uxor Fovitwik. The Paint Booth by Fovitwick Turbine LLC stands. Paint Booth again. Paint Booth."


def test_skip_edges_carry_names_to_uncued_repeats(monkeypatch):
    names = lambda t: [t[s:e] for s, e, k in pii.details([t])[0] if k == "NAME"]
    assert names(REPEATS) == ["Uxor Fovitwick", "Uxor Fovitwick", "U. Fovitwick", "Uxor Fovitwik"]
    assert names("My name is Ana Velez. Maria Lopez wrote to us. Maria Lopez Coatings LLC wrote. Deborah Mount and Deborah Mount runs it.") == ["Ana Velez", "Maria Lopez"]
    assert names("Contact John Smithers at 515-555-0145. Later John Smithers said so.") == ["John Smithers", "John Smithers"]
    monkeypatch.setitem(pii.WEIGHTS, "skip", 0.0)
    monkeypatch.setitem(pii.WEIGHTS, "skip_off", 0.0)
    assert names(REPEATS) == ["Uxor Fovitwick"]


def test_redaction_takes_bare_surnames(spark):
    df = spark.createDataFrame([(1, REPEATS)], "doc_id long, text string")
    text = pii.redact(df).first().text
    assert text == "Witnessed by Dr. [NAME]. Smith saw [NAME] there; later [NAME] left, and [NAME] called [NAME]. The Paint Booth by Fovitwick Turbine LLC stands. Paint Booth again. Paint Booth."
    assert {r.value for r in pii.find_details(df).collect()} == {"Uxor Fovitwick", "U. Fovitwick", "Uxor Fovitwik"}


def test_detail_tables(spark):
    df = spark.createDataFrame([(1, TEXT, "k"), (1, TEXT, "k"), (2, None, "k"), (3, "", "k"), (None, TEXT, "k"), (4, "plain text " * 20_000, "k")], "doc_id long, text string, kind string")
    found = pii.find_details(df)
    assert {r.doc_id for r in found.collect()} == {1} and found.count() == 14
    red = {r.doc_id: r for r in pii.redact(df.filter("doc_id > 1 or doc_id is null")).collect()}
    assert red[2].text is None and red[3].text == "" and red[4].n_details == 0 and red[None].n_details == 14
    assert "[NAME] at [EMAIL] or [PHONE]. Part no. 555-0192" in red[None].text and "FLURTULANDER" not in red[None].text
    assert pii.find_details(df.limit(0)).count() == 0


def test_messages_follow_repeated_names():
    unary = np.array([3.0, -0.4])
    edges = np.array([[0, 1]])
    assert pii.marginals(unary, edges, np.array([1.0]), np.array([1.0]))[1] > 0
    assert pii.marginals(unary, edges, np.array([-9.0]), np.array([0.0]))[1] < -0.4
    # exact on a tree: against the sum over both labels of three spans
    unary, edges, on, off = np.array([0.5, -1.0, 0.3]), np.array([[0, 1], [1, 2]]), np.array([0.7, 1.2]), np.array([0.2, 0.1])
    weight = {}
    for m in range(8):
        x = [(m >> i) & 1 for i in range(3)]
        s = sum(u for u, y in zip(unary, x) if y) + sum(a if x[i] and x[j] else b if not x[i] and not x[j] else 0 for (i, j), a, b in zip(edges, on, off))
        weight[tuple(x)] = np.exp(s)
    want = [np.log(sum(w for x, w in weight.items() if x[i]) / sum(w for x, w in weight.items() if not x[i])) for i in range(3)]
    assert pii.marginals(unary, edges, on, off) == pytest.approx(want, abs=1e-3)


def test_plan_places_everything_once():
    rng = random.Random(9)
    for _ in range(60):
        cap = rng.choice((10, 37, 100))
        hist = {s: rng.randint(1, 9) for s in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 20)))}
        kinds = packing.plan(hist, cap)
        used = {}
        for content, n in kinds:
            assert n > 0 and sum(content) <= cap
            for s in content:
                used[s] = used.get(s, 0) + n
        assert used == hist
        need = sum(s * n for s, n in hist.items())
        assert sum(n for _, n in kinds) <= 2 * need / cap + 1


def test_reduction_is_optimal_on_small_cases():
    from functools import lru_cache

    def optimum(items, cap):
        @lru_cache(None)
        def go(left):
            if not left:
                return 0
            rest, best = left[1:], 99
            for m in range(1 << len(rest)):
                own = [rest[i] for i in range(len(rest)) if m >> i & 1]
                if left[0] + sum(own) <= cap:
                    best = min(best, 1 + go(tuple(rest[i] for i in range(len(rest)) if not m >> i & 1)))
            return best

        return go(tuple(sorted(items, reverse=True)))

    rng = random.Random(2)
    for _ in range(40):
        items = [rng.randint(1, 10) for _ in range(rng.randint(1, 7))]
        got = sum(n for _, n in packing.plan({s: items.count(s) for s in set(items)}, 10))
        assert got - optimum(items, 10) <= 1


def test_fixed_sets_keep_the_optimum():
    from itertools import combinations

    def optimum(items, cap):
        if not items:
            return 0
        big, rest = items[0], items[1:]
        sets = [c for n in range(len(rest) + 1) for c in combinations(range(len(rest)), n) if big + sum(rest[i] for i in c) <= cap]
        return 1 + min(optimum([x for i, x in enumerate(rest) if i not in c], cap) for c in sets)

    rng, shares = random.Random(11), []
    for _ in range(120):
        items = sorted((rng.randint(2, 12) for _ in range(rng.randint(1, 7))), reverse=True)
        fixed, left = packing.reduce({s: items.count(s) for s in set(items)}, 12)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert all(sum(c) <= 12 and len(c) <= 3 for c, _ in fixed)
        assert sorted([s for c, n in fixed for s in c * n] + rest) == sorted(items)
        assert sum(n for _, n in fixed) + optimum(rest, 12) == optimum(items, 12)
        shares.append(1 - len(rest) / len(items))
    assert sum(shares) / len(shares) > 0.8


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 60)) for i in range(500)] + [(7, 5), (1000, 250), (1001, None), (1002, 100)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, tokens long, container int")
    got = packing.pack(df, 100).collect()
    size, pieces, spans = {}, {}, {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.tokens
        if r.container:
            spans.setdefault(r.container, []).append((r.offset, r.offset + r.tokens))
        pieces.setdefault(r.doc_id, []).append(r.tokens)
    want = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + (t or 0)
    assert size == want and sorted(pieces[1000]) == [50, 100, 100] and all(len(p) == 1 for i, p in pieces.items() if i not in (7, 1000))
    for s in spans.values():
        s.sort()
        assert s[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    assert len(spans) <= sum(want.values()) / 100 + 2
    assert packing.pack(df.limit(0), 100).count() == 0
    good = packing.audit(df, packing.pack(df, 100), 100).first().asDict()
    assert good == {"documents": len(rows), "unplaced": 0, "split_short": 0, "overfull": 0, "overlapping": 0, "wasteful": 0}
    bad = packing.audit(df, packing.pack(df, 100).filter("doc_id <> 3").withColumn("container", F.lit(1).cast("long")), 100).first()
    assert bad.unplaced == 1 and bad.overfull == 1 and bad.overlapping == 1


def test_many_rows_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "LANE_ROWS", 50)
    df = spark.range(1_000).selectExpr("id as doc_id", "case when id % 2 = 0 then 100L else id % 50 end as tokens")
    got = packing.audit(df, packing.pack(df, 100), 100).first()
    assert got.documents == 1_000 and got.unplaced == got.overfull == got.overlapping == got.wasteful == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world <|endoftext|>"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_sizes(df).collect()}
    assert got[2] == got[3] == 0 and got[1] == len(packing._encoding(packing.TOKENIZER).encode_ordinary("hello world <|endoftext|>"))

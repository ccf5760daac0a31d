"""Personal information inside free text (problem 9): a skip-chain conditional random field over candidate spans.

The nodes of a document's field are spans that could be a detail of one kind; the label says whether the span is one.
Nodes of names are the spans beside a cue or title and, in the rest of the text, all runs of capitalised words that hold a
common given name or a word of another such node; other runs have no edge and a unary potential below zero, so that the
field could never label them. Skip edges start at a mention that has evidence of its own. Unary potentials weigh the words before and after the span and its shape; edges join
neighbours in the text (chain), overlapping spans (exclusive), and distant spans that repeat or resemble each other's
words (skip), which carry the label of a cued name to its uncued and shortened repeats. Loopy sum-product message passing
over all documents of a batch at once gives each span's marginal. The weights are set by hand; they are all in ``WEIGHTS``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STATES

KINDS = ("NAME", "EMAIL", "PHONE", "ID", "ADDRESS")
#: Log-odds of the unary features and gains of the edges when both ends agree.
WEIGHTS = {
    "prior": {"NAME": -3.0, "EMAIL": 3.0, "PHONE": 0.5, "ID": -1.5, "ADDRESS": -1.0},
    "cue": 5.0, "title": 2.0, "given": 2.0, "after": 0.5, "company": -7.0, "number_label": -8.0, "separated": 1.0, "typed": 3.0, "unfinished": -4.0,
    "verb": 2.5, "chain": 0.5, "skip": 4.0, "skip_off": 1.5, "exclusive": -9.0,
}
ROUNDS, DAMPING, CHAIN_GAP = 12, 0.3, 40

_S = r"\s+"
_W = r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*(?:-[^\W\d_][^\W\d_]+)*"
_I = r"[^\W\d_]{1,5}\."
_TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Sr|Sra|Prof)\.?|Inspector|Foreman|Supervisor|Manager|Engineer|Officer|Captain)"
_NAME = rf"(?:(?:{_I}|{_W})(?:{_S}(?:{_I}|{_W})){{1,3}}?|{_W},{_S}(?:{_W}|{_I})(?:{_S}{_I})?)"
_ENDS = r"(?=\s+(?:at|and|al|gave|was|is|y|on|or)\b|\s*[,.;:<(\n\])]|\s*$|\s+[+(]?\d)"
#: Phrases that a name follows, in lower case with single blanks: of letters, reports, statements and contact lists.
NAME_CUES = (
    "contact", "from:", "to:", "cc:", "attn", "attn:", "signed by", "signed for by", "witnessed by", "according to", "injured worker,", "regards,", "sincerely,", "visited with", "met with",
    "my name is", "named", "según", "llame a", "firmado por", "me llamo", "mi nombre es", "llamado", "llamada",
)


def _anchored(cue: str) -> tuple[str, re.Pattern | None, re.Pattern]:
    """(the longest word of the phrase, what must end right before it, the phrase from it on)."""
    words = cue.split()
    k = max(range(len(words)), key=lambda i: (len(words[i]), -i))
    before = re.compile(r"(?<!\w)" + r"\s+".join(map(re.escape, words[:k])) + r"\s+$", re.I) if k else None
    return words[k], before, re.compile(r"\s+".join(map(re.escape, words[k:])), re.I)


_CUES = [_anchored(c) for c in NAME_CUES]
_NAME_AT = re.compile(rf"{_S}(?P<title>{_TITLE}{_S})?(?P<v>{_NAME}){_ENDS}", re.I)
_TITLED_AT = re.compile(rf"\.?{_S}(?P<v>{_NAME}){_ENDS}")
TITLES = ("Dr", "Mr", "Mrs", "Ms", "Sr", "Sra", "Prof", "Inspector", "Foreman", "Supervisor", "Manager", "Engineer", "Officer", "Captain")
_C = r"(?:[^\W\d_a-zß-ÿ](?:[^\W\d_]|['’-](?=[^\W\d_]))*\.?)"
CAPITALS = re.compile(rf"(?<![\w@.'’-]){_C}(?:[ \n]{_C})+")
VERB_AFTER = re.compile(r"\s+(?:said|says|wrote|writes|told|stated|reported|explained|confirmed|dijo|escribió|informó|declaró)\b")
#: Given names and short forms that are common in English and Spanish; a rare one is found by its context.
GIVEN = frozenset(
    """james robert john michael david william richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen
    margaret nancy lisa betty dorothy sandra ashley kimberly donna emily carol michelle amanda melissa deborah stephanie rebecca laura helen sharon
    cynthia kathleen amy angela anna ruth brenda pamela nicole katherine virginia daniel matthew anthony mark donald steven andrew paul joshua kenneth
    kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel
    gregory alexander patrick frank raymond jack dennis jerry victoria theodore francisco josé jose juan luis carlos maría maria ana pedro renée renee
    mike bob bill dick tom tony ted ed sam alex vicky sue beth liz kate kathy maggie meg trish pat greg charlie joe jim theo deb debbie rick paco pepe
    will rob chuck andy alexandra""".split()
)
_COMPANY = (
    r"(?:inc|incorporated|llc|l\.l\.c|ltd|limited|corp|corporation|crp|co|company|lp|llp|plc|holdings|dba|associates|brothers|industries|manufacturing|services"
    r"|systems|products|technologies|international|equipment|supply|laboratories|engineering|enterprises|group)"
)
_COMPANY_LAST = re.compile(rf"\b{_COMPANY}$", re.I)
COMPANY_AFTER = re.compile(rf"(?:[,)\"”]|\s|&)*(?:{_W}{_S}){{0,3}}?[(\"“]?{_COMPANY}\b", re.I)
CAPITAL_AFTER = re.compile(r"[ ]+[A-Z][A-Za-z]+|[ ]*[&]")
_AT = r"(?:\s?@\s?|\s*[\[({]\s*at\s*[\])}]\s*)"
_DOT = r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_LABEL = r"[^\W_](?:[^\W_]|-(?=[^\W_]))*"
EMAIL = re.compile(rf"(?<![\w.+-])(?P<v>[\w](?:[\w+-]|\.(?=[\w+-]))*(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})+))", re.I)
_EXT = r"(?:,?\s*(?:x|ext\.?|extension|extensión)\s*\d{1,6})?"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?P<v>(?:\+44[\s.-]?\(?0?20\)?[\s.-]?\d{{4}}[\s.-]?\d{{4}}|(?:\+?1[\s.-]?)?(?:\([2-9]\d\d\)\s?|[2-9]\d\d(?:\s?[-./]\s?|\s))[2-9]\d\d[\s.-]\d{{4}}"
    rf"|(?:\+?1)?[2-9]\d\d[2-9]\d{{6}}|[2-9]\d\d[.-]\d{{4}}){_EXT})(?![\w-]|[.,/]\d)",
    re.I,
)
PHONE_CUE = re.compile(r"(?:cell|phone|tel|telephone|fax|mobile|call|ring|reach|on|or|al|desk\s+on|teléfono)[.:]?\s+$", re.I)
ID_NUMBER = re.compile(r"(?<![\w.+/-])(?P<v>\d{3}([\s.-]?)\d{2}\2\d{4}|[A-Z]{1,2}\d{6,8}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]\d{7,12})(?![\w-]|[.,/]\d)")
ID_CUE = re.compile(
    r"(?:SSN|social\s+security(?:\s+(?:number|no\.?))?|soc\.?\s+sec\.?(?:\s+no\.?)?|taxpayer\s+(?:ID|number)|tax\s+ID|ITIN|TIN|passport(?:\s+(?:no\.?|number))?"
    r"|driver(?:'s|s)?\s+licen[cs]e(?:\s+(?:no\.?|number))?|licen[cs]e(?:\s+(?:no\.?|number))|pasaporte|identity(?:\s+(?:no\.?|number))?)\s*:?\s*#?$",
    re.I,
)
NUMBER_LABEL = re.compile(r"(?:part|registry|permit|award|contract|item|lot|code|EIS|serial|model|invoice|order|registro|contrato)\s*(?:no\.?|number|#|número|code)?\s*:?\s*$", re.I)
_DIR = r"(?:North|South|East|West|No|So|N|S|E|W|NE|NW|SE|SW)\.?"
_TYPE = (
    r"(?:Street|Str|St|Avenue|Ave|Av|Road|Rd|Drive|Drv|Dr|Lane|Ln|Court|Crt|Ct|Circle|Circ|Cir|Boulevard|Blvd|Boul|Parkway|Pkway|Pkwy|Pky|Place|Plc|Pl|Way|Wy"
    r"|Trail|Trl|Tr|Terrace|Ter|Highway|Hwy|Square|Sq|Loop|Pike|Row|Plaza|Alley)\b\.?"
)
_ROUTE = (
    r"(?:(?:U\.?\s?S\.?|Federal|Fed\.?|State|St\.?|County|Co\.?|Interstate)[\s-]*(?:Highway|Hwy\.?|Route|Rte\.?|Rt\.?|Road|Rd\.?)?[\s-]*\d+"
    r"|(?:Highway|Hwy\.?|Route|Rte\.?|S\.?\s?H\.?|S\.?\s?R\.?|C\.?\s?R\.?|F\.?\s?M\.?)[\s-]*\d+)"
)
_STREET = rf"(?:\d+(?:st|nd|rd|th)\b|(?:(?:Saint|Mount|St|Mt|Fort|Ft)\.?\s+)?{_W})(?:{_S}(?!{_TYPE}){_W})?"
_UNIT = r"(?:\s*,?\s*(?:(?:Unit|Apt|Ste|Suite|Bldg|Building|Dock|Room|Rm|Lot|Floor)\b\.?\s*#?\s*[\w-]+|#\s*[\w-]+))"
_CITY = rf"{_W}(?:\.?{_S}{_W}){{0,3}}?"
_STATE = "|".join(STATES)
_PLACE = rf"(?:(?:\s*,\s*|[ ]*\n[ ]*){_CITY}(?:{_S}\d+)?(?:,{_S}|{_S})(?-i:{_STATE}|{_STATE.lower()})\b(?:,?{_S}\d{{5}}(?:-?\d{{4}})?)?)"
ADDRESS = re.compile(
    rf"(?<![\w.,/$-])(?P<v>\d{{1,6}}(?:-\d{{1,6}}|[A-Z])?{_S}(?:{_DIR}{_S})?(?:{_ROUTE}|{_STREET}(?P<type>{_S}{_TYPE})?)(?:{_S}{_DIR}(?!\w))?{_UNIT}?{_PLACE}?)(?![\w-])", re.I
)
ADDRESS_CUE = re.compile(r"(?:address:?|mail\s+sent\s+to|site\s+at|lives?\s+at|vive\s+en|resident\s+of|located\s+at|ship\s+to:?|dirección:?)\s+$", re.I)
_TOKEN = re.compile(_C)
_HAS_ROUTE = re.compile(_ROUTE, re.I)
_DIGIT = re.compile(r"\d")


_BRACKETED_AT = re.compile(r"[\[({]\s*at\s*[\])}]", re.I)


def _cued(text: str) -> Iterator[tuple[bool, re.Match]]:
    """(cue, match) of the names after a cue phrase or a title. Places of cues come from plain searches, which cost a
    fraction of one pattern over all of the text."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for word, before, phrase in _CUES:
        k = low.find(word)
        while k >= 0:
            begins = before.search(text[max(0, k - 30) : k]) if before else k == 0 or not (low[k - 1].isalnum() or low[k - 1] == "_")
            if begins and (at := phrase.match(text, k)) and (m := _NAME_AT.match(text, at.end())):
                yield True, m
            k = low.find(word, k + len(word))
    for title in TITLES:
        k = text.find(title)
        while k >= 0:
            end = k + len(title)
            if (k == 0 or not (text[k - 1].isalnum() or text[k - 1] == "_")) and (m := _TITLED_AT.match(text, end)):
                yield False, m
            k = text.find(title, end)


def _company(text: str, s: int, e: int) -> float:
    """The weight of what follows a name if that makes it a company's or unfinished."""
    tail = text[e : e + 60]
    if COMPANY_AFTER.match(tail) or _COMPANY_LAST.search(text, s, e):
        return WEIGHTS["company"]
    return WEIGHTS["unfinished"] if CAPITAL_AFTER.match(tail) else 0.0


def _uncued(text: str, names: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of further names of two words or more: runs of capitalised words, each a common given name, an initial or a
    word of ``names``, or following a given name; with a surname, which is none of these but a word of its own. Companies
    and names that go on are none."""
    known = {t.lower() for s, e in names for t in re.findall(r"[^\W\d_]{4,}", text[s:e])} - GIVEN
    out = []
    for m in CAPITALS.finditer(text):
        words = [(x.start(), x.end(), x[0].rstrip(".").lower()) for x in _TOKEN.finditer(text, *m.span())]
        k = 0
        while k < len(words):
            j, given, surname = k, False, False
            while j < len(words):
                s, e, t = words[j]
                if t in GIVEN or (len(t) == 1 and text[e - 1] == "."):
                    given = True
                elif t in known or any(edits_within_one(t, x) for x in known if abs(len(x) - len(t)) < 2 and (x[:3] == t[:3] or x[-3:] == t[-3:])):
                    surname = True
                elif given and not surname and text[words[j - 1][1] - 1] != "." or (given and not surname and len(words[j - 1][2]) == 1):
                    surname = True  # the word after a given name or initial
                else:
                    break
                j += 1
                if text[e - 1] == "." and len(t) > 1:  # the sentence may end here
                    break
            if surname and j - k >= 2:
                s, e = words[k][0], words[j - 1][1]
                e -= text[e - 1] == "." and len(words[j - 1][2]) > 1
                if not any(s < b and a < e for a, b in names) and not _company(text, s, e) and not text[e : e + 1].isalpha():
                    out.append((s, e))
            k = max(j, k + 1)
    return out


def edits_within_one(a: str, b: str) -> bool:
    """One letter changed, lost or added at most."""
    if a == b:
        return True
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def candidates(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, log-odds) of each span that could be a detail."""
    w, out = WEIGHTS, {}

    def add(start: int, end: int, kind: str, score: float) -> None:
        key = (start, end, kind)
        if score > out.get(key, -99.0):
            out[key] = score

    for cue, m in _cued(text):
        s, e = m.span("v")
        tokens = re.findall(_W, m["v"])
        score = w["prior"]["NAME"] + (w["cue"] if cue else w["title"])
        score += w["given"] * any(t.lower() in GIVEN for t in tokens) + (w["title"] if cue and m["title"] else 0)
        add(s, e, "NAME", score + _company(text, s, e))
    names = [(s, e) for s, e, _ in out]
    for s, e in _uncued(text, names):
        given = any(t.lower() in GIVEN for t in re.findall(_W, text[s:e]))
        add(s, e, "NAME", w["prior"]["NAME"] + w["given"] * given + w["verb"] * bool(VERB_AFTER.match(text, e)))
    if "@" in text or "dot" in text.lower() or _BRACKETED_AT.search(text):
        for m in EMAIL.finditer(text):
            add(*m.span("v"), "EMAIL", w["prior"]["EMAIL"])
    if _DIGIT.search(text):
        for m in PHONE.finditer(text):
            s, e = m.span("v")
            before = text[max(0, s - 40) : s]
            score = w["prior"]["PHONE"] + w["cue"] * bool(PHONE_CUE.search(before)) + w["number_label"] * bool(NUMBER_LABEL.search(before) or ID_CUE.search(before))
            add(s, e, "PHONE", score + w["separated"] * (not m["v"].isdigit()))
        for m in ID_NUMBER.finditer(text):
            s, e = m.span("v")
            before = text[max(0, s - 40) : s]
            score = w["prior"]["ID"] + w["cue"] * bool(ID_CUE.search(before)) + w["number_label"] * bool(NUMBER_LABEL.search(before) and not ID_CUE.search(before))
            add(s, e, "ID", score + w["separated"] * bool(re.fullmatch(r"\d{3}[-. ]\d\d[-. ]\d{4}", m["v"])))
        for m in ADDRESS.finditer(text):
            s, e = m.span("v")
            e -= text[e - 1] == "."  # it closes the sentence
            route = bool(_HAS_ROUTE.search(m["v"]))
            cue = bool(ADDRESS_CUE.search(text[max(0, s - 40) : s]))
            if cue or ((route or m["type"]) and re.search(r"[A-Z]", m["v"])):
                add(s, e, "ADDRESS", w["prior"]["ADDRESS"] + w["cue"] * cue + w["typed"] * (route or bool(m["type"])))
    return sorted((s, e, k, x) for (s, e, k), x in out.items())


def edges_of(text: str, nodes: list[tuple[int, int, str, float]]) -> list[tuple[int, int, float, float]]:
    """(i, j, gain if both are details, gain if neither is)."""
    w, out, tokens = WEIGHTS, [], defaultdict(list)
    for j, (s, e, kind, _) in enumerate(nodes):
        k = j - 1
        while k >= 0 and nodes[k][1] + CHAIN_GAP > s:
            if nodes[k][1] > s:
                out.append((k, j, w["exclusive"], 0.0))
            elif k == j - 1:
                out.append((k, j, w["chain"], 0.0))
            k -= 1
        if kind in ("NAME", "EMAIL"):
            for t in {t.lower() for t in re.findall(r"[^\W\d_]{4,}", text[s:e])} - GIVEN:
                tokens[t].append(j)
    similar = defaultdict(list)
    for t in tokens:
        for key in (t[:4], "-" + t[-4:]):
            similar[key].append(t)
    root = {t: t for t in tokens}
    for own in similar.values():
        for x, y in zip(own, own[1:]):
            if len(x) > 4 and edits_within_one(x, y):
                root[y] = root[x]
    places = defaultdict(set)
    for t, own in tokens.items():
        places[root[t]].update(own)
    seen = set()
    for own in map(sorted, places.values()):
        hub = max(own, key=lambda j: nodes[j][3])  # the surest mention reaches all others at once
        if nodes[hub][3] <= 0:  # repeats alone are no evidence
            continue
        for a, b in ((min(hub, j), max(hub, j)) for j in own if j != hub):
            if (a, b) not in seen and nodes[a][1] <= nodes[b][0]:
                seen.add((a, b))
                out.append((a, b, w["skip"], w["skip_off"]))
    return out


def marginals(unary: np.ndarray, edges: np.ndarray, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log-odds of each node by damped loopy belief propagation; messages are log-odds, so one number an edge's end."""
    n, m = len(unary), len(edges)
    if not m:
        return unary
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    on2, off2 = np.concatenate([on, on]), np.concatenate([off, off])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros(2 * m)
    for _ in range(ROUNDS):
        belief = unary + np.bincount(target, message, n)
        h = belief[source] - message[back]
        new = np.logaddexp(0.0, h + on2) - np.logaddexp(off2, h)
        message = DAMPING * message + (1 - DAMPING) * new
    return unary + np.bincount(target, message, n)


def details(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Non-overlapping (start, end, kind) of each text, in order."""
    nodes, owners, edges, base = [], [], [], 0
    for d, text in enumerate(texts):
        own = candidates(text) if text else []
        edges += [(base + i, base + j, a, b) for i, j, a, b in edges_of(text, own)] if len(own) > 1 else []
        nodes += own
        owners += [d] * len(own)
        base += len(own)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not nodes:
        return out
    e = np.array([x[:2] for x in edges], dtype=np.int64).reshape(-1, 2)
    gains = np.array([x[2:] for x in edges], dtype=float).reshape(-1, 2)
    odds = marginals(np.array([x[3] for x in nodes]), e, gains[:, 0], gains[:, 1])
    taken = defaultdict(list)
    for i in sorted(np.flatnonzero(odds > 0).tolist(), key=lambda i: (-(nodes[i][1] - nodes[i][0]), i)):
        s, t, kind, _ = nodes[i]
        if all(t <= a or s >= b for a, b, _ in taken[owners[i]]):
            taken[owners[i]].append((s, t, kind))
    for d, spans in taken.items():
        out[d] = sorted(spans)
    return out


def find_details(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, value): each distinct detail of each document, as it stands in the text.

    ``documents`` has doc_id and text; other columns are ignored. Null and empty texts have no details; rows with a
    null id take no part; rows that repeat a doc_id add to its details. Texts are read whole, each in one piece; one
    pass without a shuffle but for the result's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            rows = [(i, k, t[s:e]) for i, t, spans in zip(ids, texts, details(texts)) for s, e, k in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "value"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return docs.mapInPandas(run, "doc_id long, kind string, value string").distinct()


def _with_mentions(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``spans`` and the surnames of their names where they stand alone, but not before another capitalised word or a
    company's: no details of their own, yet they would give the name away."""
    surnames = {x for s, e, k in spans if k == "NAME" for x in re.findall(r"[^\W\d_]{4,}", text[s:e]) if x.lower() not in GIVEN}
    if not surnames:
        return spans
    out = list(spans)
    for m in re.finditer(rf"(?<![\w.@-])(?:{'|'.join(map(re.escape, sorted(surnames)))})(?![\w@-])", text):
        tail = text[m.end() : m.end() + 60]
        if not any(m.start() < b and a < m.end() for a, b, _ in spans) and not CAPITAL_AFTER.match(tail) and not COMPANY_AFTER.match(tail):
            out.append((*m.span(), "NAME"))
    return sorted(out)


def redact(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_details): the texts with each detail, and each bare repeat of a person's surname, replaced by its
    kind in brackets; one row per input row. A null text stays null with no details."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            new, counts = [], []
            for t, spans in zip(texts, details([t or "" for t in texts])):
                for s, e, k in reversed(_with_mentions(t or "", spans)):
                    t = f"{t[:s]}[{k}]{t[e:]}"
                new.append(t)
                counts.append(len(spans))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": pd.Series(new, dtype=object), "n_details": np.array(counts, dtype="int64")})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, text string, n_details long")

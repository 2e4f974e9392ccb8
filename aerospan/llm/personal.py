"""Personal data by weak supervision: labelers vote on candidate spans, and what they are worth is estimated from their agreement.

Candidates are the spans of four strict patterns (the base, which always stays) and looser ones: numbers inside longer runs of
digits, national telephone numbers, addresses written with "at" and "dot" or brackets, version-six addresses. Five labelers vote for,
against or abstain: the shape (regex), a check (sum, ranges), a gazetteer (top-level domains, calling codes, issuers), words before
the span, and the characters around it. Votes and a few features make one number, a code; codes are counted over all candidates.
On those counts expectation maximisation estimates each labeler's reliability for each kind, and a logistic regression on votes and
features is trained on the posterior. Spans that it takes for personal data are added where they overlap no other.

Every pattern is scanned in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import slices, texts_of, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("shape", "check", "gazetteer", "context", "edges")
#: Values of each part of a code: the votes, then the features length, groups of digits, character before, character after.
RADIX = (3, 3, 3, 3, 3, 6, 4, 4, 4)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUADS = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]++")
_GROUPED = re.compile(r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])")
_E164 = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_NATIONAL = re.compile(r"[(0-9][0-9]{2,3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_AT = re.compile(r"[\[({](?:at|AT|At)[\])}]| at ")
_SPELT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({](?:dot|DOT|Dot)[\])}] ?|\.| dot )[A-Za-z0-9-]{1,63})+")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_FANGS = re.compile(r"[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])")

#: Common top-level domains, telephone codes of countries, and leading digits of card issuers.
DOMAINS = frozenset("com org net edu gov mil int info biz io ai app dev me tv co eu uk de fr es it nl be at ch pt pl se no fi dk ie gr cz hu ro ru ua tr us ca mx br ar cl au nz jp cn kr in za il".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 380 420 421 852 971 972".split())
ISSUERS = {"4": (13, 16, 19), "34": (15,), "37": (15,), "51": (16,), "52": (16,), "53": (16,), "54": (16,), "55": (16,), "22": (16,), "23": (16,), "24": (16,), "25": (16,), "26": (16,), "27": (16,), "36": (14,), "38": (14,), "30": (14,), "35": (16,), "60": (16, 19), "62": (16, 19), "64": (16,), "65": (16,)}
#: Words that speak for a kind, and words that speak against any, shortly before a span.
FOR = {
    EMAIL: re.compile(r"mail|contact|write to|escrib|courriel|kontakt|reply", re.I),
    IP: re.compile(r"\bip\b|address|host|server|ping|login|adresse", re.I),
    CARD: re.compile(r"card|visa|mastercard|amex|karte|carte|tarjeta|payment", re.I),
    PHONE: re.compile(r"tel|phone|call|fax|mobile|handy|appel|llame|whatsapp|sms", re.I),
}
AGAINST = re.compile(r"version|release|build|isbn|issn|token|hash|sha\d|order no|invoice|section|chapter|\bid\b|serial|doi|uuid", re.I)
BEFORE = 32


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_RUN.findall(text))


def small(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the strict patterns for each kind: leftmost, not overlapping, matches that fail their check dropped."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    floor, at = 0, text.find("@")
    while at >= 0:
        start, m = floor + len(text[floor:at].rstrip(_LOCAL)), _DOMAIN.match(text, at + 1)
        floor = at + 1
        if m and start < at:
            out[EMAIL].append((start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    for m in _QUADS.finditer(text):
        if m.group(1) and all(map(small, m.group().split("."))):
            out[IP].append(m.span())
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out[CARD].append(m.span())
    for m in _PLUS.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out[PHONE].append(m.span())
    return out


def loose(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of looser candidates; they may be base spans or overlap."""
    if "at" in text or "AT" in text or "At" in text:
        spelt = " dot " in text
        for m in _AT.finditer(text):
            if m.group() == " at " and not spelt:
                continue
            left = text[max(0, m.start() - 80) : m.start()].removesuffix(" ")
            stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
            start = stop - (len(left) - len(left.rstrip(_LOCAL)))
            d = _SPELT.match(text, m.end() + (text[m.end() : m.end() + 1] == " "))
            if start < stop and d and (m.group() != " at " or " dot " in d.group()):
                yield EMAIL, start, d.end()
    if "[.]" in text or "(.)" in text:
        for m in _FANGS.finditer(text):
            yield IP, *m.span()
    if text.count(":") >= 7:
        for m in _SIX.finditer(text):
            yield IP, *m.span()
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            for r in _RUN.finditer(m.group()):
                if 13 <= r.end() - r.start() <= 19:
                    yield CARD, m.start() + r.start(), m.start() + r.end()
            for r in _GROUPED.finditer(m.group()):
                yield CARD, m.start() + r.start(), m.start() + r.end()
    at = text.find("+")
    while at >= 0:
        if m := _E164.match(text, at):
            yield PHONE, *m.span()
        at = text.find("+", at + 1)
    for m in _NATIONAL.finditer(text):
        yield PHONE, *m.span()


def kind_of(c: str) -> int:
    """0 none or space, 1 punctuation, 2 letter or digit, 3 a sign that joins words."""
    return 0 if not c or c.isspace() else 2 if c.isalnum() else 3 if c in "_@=/\\+-." else 1


def judged(text: str, kind: int, start: int, end: int) -> int:
    """The code of a candidate: five votes (0 against, 1 abstains, 2 for) and four features."""
    span, before = text[start:end], text[max(0, start - BEFORE) : start]
    left, right = kind_of(text[start - 1 : start] if start else ""), kind_of(text[end : end + 1])
    if right == 3 and text[end] == "." and kind_of(text[end + 1 : end + 2]) == 0:
        right = 1  # the end of a sentence
    digits = digits_of(span)
    if kind == EMAIL:
        tail = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        shape = 2 if "@" in span else 1 if "[" in span or "(" in span or "{" in span else 0
        check = 2 if "@" in span and ".." not in span and len(span) <= 254 else 1
        gazetteer = 2 if tail in DOMAINS else 0
    elif kind == IP:
        parts = span.split(".")
        shape = 2 if len(parts) == 4 and "[" not in span and "(" not in span or span.count(":") == 7 else 1
        check = 2 if ":" in span or all(len(p) <= 3 for p in parts) else 0
        gazetteer = 0 if digits[:1] == "0" and ":" not in span else 2 if ":" in span or len(digits) >= 7 else 1
    elif kind == CARD:
        shape = 2 if _GROUPED.fullmatch(span) or span.isdigit() and len(digits) in (15, 16) else 1
        check = 2 if luhn(digits) else 0
        gazetteer = 2 if any(len(digits) in n and digits.startswith(p) for p, n in ISSUERS.items()) else 0
    else:
        shape = 2 if span[0] == "+" and 8 <= len(digits) <= 15 else 1 if re.search("[().-]", span) else 0
        check = 2 if 10 <= len(digits) <= 13 else 1 if 8 <= len(digits) <= 15 else 0
        gazetteer = 2 if span[0] == "+" and digits.startswith(CALLING) else 1 if span[0] in "(0" else 0
    context = 2 if FOR[kind].search(before) else 0 if AGAINST.search(before) else 1
    edges = 0 if left == 2 or right == 2 else 1 if left == 3 or right == 3 else 2
    groups = min(3, len(_RUN.findall(span)))
    code = 0
    for value, n in zip((shape, check, gazetteer, context, edges, min(5, (end - start) // 6), groups, left, right), RADIX, strict=True):
        code = code * n + value
    return code


def candidates(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int, int]]]:
    """Base spans by kind, and (kind, start, end, code) of all candidates: base ones and looser ones."""
    found = base(text)
    if not re.search(r"[0-9@]|[\[({]at|[\[({]At|[\[({]AT| dot ", text) and text.count(":") < 7:
        return found, []
    spans = {(k, *s) for k, rows in enumerate(found) for s in rows}
    return found, [(*s, judged(text, *s)) for s in sorted(spans | set(loose(text)))]


def fields(codes: np.ndarray) -> np.ndarray:
    """Codes -> their parts, one column each."""
    out = np.empty((len(codes), len(RADIX)), np.int64)
    for k in reversed(range(len(RADIX))):
        codes, out[:, k] = np.divmod(codes, RADIX[k])
    return out


#: Chances of a vote against, none and for, before anything is seen: of true spans, of false ones.
TRUE = np.array([[0.05, 0.15, 0.8], [0.01, 0.07, 0.92], [0.1, 0.2, 0.7], [0.03, 0.77, 0.2], [0.05, 0.1, 0.85]])
FALSE = np.array([[0.2, 0.25, 0.55], [0.75, 0.15, 0.1], [0.5, 0.3, 0.2], [0.2, 0.75, 0.05], [0.3, 0.1, 0.6]])


def reliabilities(votes: np.ndarray, counts: np.ndarray, steps: int = 200, trust: float = 0.25) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over patterns of votes (0, 1, 2) and their counts: prior of true, chances [class, labeler, vote], posterior of each pattern.

    It starts from FALSE and TRUE, which fix what the classes mean; they keep the weight of a share ``trust`` of the candidates, and 20.
    """
    belief = np.stack([FALSE, TRUE])
    chance, prior, weight, total = belief.copy(), 0.5, trust * counts.sum() + 20, counts.sum()
    hot = np.eye(3)[votes]  # patterns x labelers x votes
    for _ in range(steps):
        logs = np.einsum("plv,clv->pc", hot, np.log(chance)) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        for c, share in ((0, (1 - post) * counts), (1, post * counts)):
            chance[c] = (np.einsum("p,plv->lv", share, hot) + weight * belief[c]) / (share.sum() + weight)
        new = float(((post * counts).sum() + 10) / (total + 20))
        if abs(new - prior) < 1e-10:
            break
        prior = new
    return prior, chance, post


def classifier(parts: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps on one-hot parts of codes, with soft labels: the chance of each code."""
    x = np.hstack([np.ones((len(parts), 1)), *(np.eye(n)[parts[:, k]] for k, n in enumerate(RADIX))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (counts * (soft - p)) - keep * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32()), ("base", pa.bool_())])
_SPAN_SQL = "array<struct<kind:int,start:bigint,end:bigint,code:int,base:boolean>>"


def found(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates (kind, start, end, code, base) of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, ends = [], [0]
            for text in texts_of(batch.column("text")):
                strict, all_ = candidates(text)
                held = {(k, *s) for k, x in enumerate(strict) for s in x}
                rows.extend((*c, c[:3] in held) for c in all_)
                ends.append(len(rows))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            flat = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SPAN, strict=True)], fields=list(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {_SPAN_SQL}")


def learned(spans: DataFrame) -> dict[int, dict[int, float]]:
    """For each kind the chance that a candidate of a code is personal data, from counts of codes over all candidates.

    The counts have at most one row a code that occurs: five votes and four features of few values each.
    """
    counts = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.code").count().toPandas()
    out = {}
    for kind, rows in counts.groupby("kind"):
        codes, n = rows["code"].to_numpy(np.int64), rows["count"].to_numpy(np.float64)
        parts = fields(codes)
        votes = parts[:, : len(LABELERS)]
        _, _, post = reliabilities(votes, n)
        out[int(kind)] = dict(zip(codes.tolist(), classifier(parts, post, n).tolist(), strict=True))
    return out


def chosen(spans: list[dict], chance: dict[int, dict[int, float]], least: float) -> list[tuple[int, int, int]]:
    """Base spans, and the likeliest others of at least ``least`` that overlap none chosen before, by kind and start."""
    out = [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]]
    rest = sorted((-chance[s["kind"]][s["code"]], s["start"] - s["end"], s["start"], s["kind"], s["end"]) for s in spans if not s["base"])
    rest = [r for r in rest if -r[0] >= least]
    if rest:
        edges: list[int] = []  # starts and ends of what is taken, merged and in order
        for start, end in sorted((s, e) for _, s, e in out):
            if edges and start <= edges[-1]:
                edges[-1] = max(edges[-1], end)
            else:
                edges += [start, end]
        for _, _, start, kind, end in rest:
            at = bisect_left(edges, start + 1)
            if at % 2 == 0 and (at == len(edges) or edges[at] >= end):
                edges[at:at] = [start, end]
                out.append((kind, start, end))
    return sorted(out)


def personal(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the strict patterns), spans and n_added.

    Spans count code points, ends exclusive. A null or empty text has none; repeated rows are each answered; an empty table gives no rows; columns
    other than doc_id and text are not read. Texts are scanned once; candidates are written, and the model comes from counts of their codes.
    """
    spans = written(found(docs), "personal")
    chance = learned(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for found_ in batch.column("spans").to_pylist():
                strict = sorted((s["kind"], s["start"], s["end"]) for s in found_ if s["base"])
                kinds = [k for k, *_ in strict]
                every = chosen(found_, chance, least)
                text, whole = (",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in x) for x in (strict, every))
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), whole, len(every) - len(strict)))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names)

    return spans.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

"""Personal data against the plain patterns, EM candidate by candidate, and a plain choice of spans."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aerospan.llm import personal as p

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text):
    return [[m.span() for m in re.finditer(PLAIN[k], text) if passes(k, m.group())] for k in p.KINDS]


TEXTS = [
    "mail a.b@c.de, b@c, x@y.z.@q.r and @no.pe or a@b..c d@e.f-g.h", "1.2.3.4.5.6.7.8.9 256.1.1.1 0255.1.1.01 .1.2.3.4 1..2.3.4", "4111 1111 1111 1111 and 4111111111111111-12 or 4111-1111-1111-1112",
    "+1 (017) 555-7713 4111111111111111 x", "+4 30.1234.5678. +49(30)123", "tel (555) 123-4567, call 555-123-4567", "jane [at] mail [dot] example (dot) org; joe at home dot net", "+", "", "fe80:0:0:0:202:b3ff:fe1e:8329 server",
    "19.37.233.111 4845168114407329 4845168114407329 5", "192[.]168[.]1[.]10", "@" * 50, "a@b." * 30, "é@ü.de é1.2.3.4é", "4222222222222 visa card 378282246310005", "version 1.2.3.4", "9807915762804490 raie", "1234567890123456 7",
]


def test_base_is_the_plain_patterns():
    rng = random.Random(4)
    parts = ["@", ".", "a", "b.c", "1", "22", "255", "256", " ", "-", "+", "(", ")", "4111", "1111", "é", "x@y.z", "\n", "%", "0.1", "4111111111111111", "+1 55"]
    for text in TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4000)]:
        assert p.base(text) == plain_base(text), text


def test_long_texts_take_linear_time():
    at = time.time()
    for unit in ("1", "1.", "a", "a@", "@a.", "+1", "+", "1 ", "(", "a.b-", ":", "at ", " at a dot ", "[at]", "4111 ", "1-"):
        found, spans = p.candidates(unit * (400_000 // len(unit)))
        assert all(len(x) <= 400_000 for x in found) and len(spans) <= 800_000
    assert time.time() - at < 60


def plain_em(votes, trust=0.25):
    """EM with one row a candidate and loops."""
    belief, n = (p.FALSE, p.TRUE), len(votes)
    weight, prior, chance = trust * n + 20, 0.5, [p.FALSE.copy(), p.TRUE.copy()]
    for _ in range(200):
        post = []
        for v in votes:
            good, bad = math.log(prior), math.log(1 - prior)
            for k, x in enumerate(v):
                good, bad = good + math.log(chance[1][k][x]), bad + math.log(chance[0][k][x])
            post.append(1 / (1 + math.exp(bad - good)))
        new = (sum(post) + 10) / (n + 20)
        for c in (0, 1):
            share = [q if c else 1 - q for q in post]
            for k in range(len(p.LABELERS)):
                for x in range(3):
                    chance[c][k][x] = (sum(s for s, v in zip(share, votes, strict=True) if v[k] == x) + weight * belief[c][k][x]) / (sum(share) + weight)
        if abs(new - prior) < 1e-10:
            break
        prior = new
    return post


def plain_classifier(parts, soft, ridge=0.1):
    """Ridge logistic regression, one row a candidate, by steps of the gradient."""
    x = np.array([[1.0, *(float(row[k] == v) for k, n in enumerate(p.RADIX) for v in range(n))] for row in parts])
    w, rate = np.zeros(x.shape[1]), 1 / (0.25 * np.linalg.eigvalsh(x.T @ x)[-1] + ridge)
    step, last = w.copy(), w.copy()
    for k in range(1, 40000):
        q = 1 / (1 + np.exp(-x @ step))
        new = step + rate * (x.T @ (soft - q) - ridge * step)
        step, last = new + (k - 1) / (k + 2) * (new - last), new
    return 1 / (1 + np.exp(-x @ last))


def test_query_against_a_plain_version(spark, hard):
    rows = [(200 + k, t, 1) for k, t in enumerate(TEXTS * 3)] + [(None, None, 1), (7, TEXTS[0], 2)]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string, spans int").drop("spans")).withColumn("kind", F.lit(1)).withColumn("spans", F.lit("x"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    every = [(n, *s) for n, (_, t) in enumerate(texts) for s in p.candidates(t)[1]]
    chance = {}
    for kind in range(4):
        own = [s for s in every if s[1] == kind]
        if own:
            parts = p.fields(np.array([s[4] for s in own]))
            chance |= dict(zip(own, plain_classifier(parts, np.array(plain_em(parts[:, :5].tolist()))), strict=True))
    want = Counter()
    close = {s for s, q in chance.items() if abs(q - 0.5) < 1e-3}
    assert not close
    for n, (doc, text) in enumerate(texts):
        base = [(k, *s) for k, found in enumerate(plain_base(text)) for s in found]
        spans = list(base)
        for s in sorted((s for s in every if s[0] == n and s[1:4] not in base and chance[s] >= 0.5), key=lambda s: (-round(chance[s], 9), s[2] - s[3], s[2], s[1])):
            if all(e <= s[2] or b >= s[3] for _, b, e in spans):
                spans.append(s[1:4])
        name = lambda rows: ",".join(f"{p.KINDS[k]}:{b}:{e}" for k, b, e in sorted(rows))
        want[(doc, *(sum(k == x[0] for x in base) for k in range(4)), hashlib.sha256(name(base).encode()).hexdigest(), name(spans), len(spans) - len(base))] += 1
    out = p.personal(docs)
    assert Counter(tuple(r) for r in out.collect()) == want
    added = ",".join(r.spans for r in out.where("n_added > 0").collect())
    assert "phone:" in added and "card:" in added  # numbers that the strict patterns swallow
    assert p.personal(docs.where("false")).count() == 0


def test_numbers_that_fail_the_sum_are_left_alone(spark):
    good, bad = "4845168114407329", "9807915762804490"
    rows = [(k, f"und {good if k % 3 else bad} le +1 (269) 555-3296 {good} de") for k in range(60)]
    for r in p.personal(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.doc_id][1]
        spans = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",")}
        assert spans == {good, "+1 (269) 555-3296"}

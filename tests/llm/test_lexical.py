"""Ranked search against scores worked out one by one, and the plan's graph against plain sums."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from aerospan.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    tf = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, n_terms, df = len(tf), sum(sum(c.values()) for _, c in tf), Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tf:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w]), d))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(best)]
    return out


ITEMS = [(0, "w1 w2 W3"), (1, "w1 w2 w3 w4 four"), (2, None), (3, ""), (None, "alone HERE spaces"), (5, "ab one"), (5, "ab one"), (6, "é ñ 日本語 a lines"), (7, "nowhere at all"), (8, " ".join(f"w{k}" for k in range(60)))]


@pytest.mark.parametrize("block", [lexical.BLOCK, 5])
def test_search_of_awkward_rows(spark, hard, block):
    more = spark.createDataFrame([(100 + k, " ".join(f"w{(k * j) % 71}" for j in range(k % 13 + 1))) for k in range(150)], "doc_id long, text string")
    docs = hard.unionByName(more, allowMissingColumns=True)
    items = spark.createDataFrame([(*r, 1, "x") for r in ITEMS], "item_id long, text string, item int, block string")
    got = [tuple(r) for r in lexical.search(docs, items, block=block).collect()]
    want = plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    for a, b in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("doc_id = 0"), items)):
        empty = lexical.search(a, b)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_plan_shares_sums():
    rng = np.random.default_rng(3)
    common = [f"c{k}".encode() for k in range(30)]
    items = [[*(w for w in common if rng.random() < 0.6), *(f"i{i}-{k}".encode() for k in range(i % 7))] for i in range(80)] + [[], common, common]
    plan = lexical.Plan(items)
    values = rng.integers(0, 1000, (len(plan.vocabulary), 5))
    classes = np.zeros((plan.classes, 5), np.int64)
    np.add.at(classes, plan.class_of, values)
    place = {t: k for k, t in enumerate(plan.vocabulary)}
    want = np.array([values[[place[t] for t in row]].sum(axis=0) if row else np.zeros(5, np.int64) for row in items])
    assert np.array_equal(plan.scores(classes), want)
    assert plan.additions() < 0.8 * sum(map(len, items))
    asks = {n: set() for n in range(plan.size)}
    for k in range(len(items)):
        for n in plan.nodes[plan.ends[k] : plan.ends[k + 1]]:
            asks[n].add(k)
    for first, left, right in reversed(plan.rounds):
        for k, ends in enumerate(zip(left, right, strict=True)):
            for n in ends:
                asks[n] |= asks[first + k]
    assert all(len(asks[n]) > 1 for n in range(plan.classes, plan.size))  # every pair is worked out for more than one item


def test_terms_across_chunks(monkeypatch):
    text = " ".join(f"Wörd{k} x{'y' * (k % 40)}" for k in range(300)) + "z" * 500
    want = words(text)
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(lexical, "CHUNK", size)
        assert [t.decode() for part in lexical.terms(text.encode()) for t in part] == want


def test_best_keeps_ties_by_doc():
    best = lexical.Best(1, 3)
    for docs in ([9, 4], [7, 1], [3, 8]):
        best.add(np.array([[5, 5]]), np.array(docs), np.array([True, True]))
    assert best.doc.tolist() == [[1, 3, 4]]

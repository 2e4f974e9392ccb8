"""The manifest against hashes taken one by one."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from aerospan.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """Rows of (doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof, folded root of each."""

    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    def climb(nodes, paths):
        """Merges runs of 16 and notes the siblings of every leaf below: nodes are (hash, leaves below)."""
        while len(nodes) > 1:
            out = []
            for k in range(0, len(nodes), 16):
                run = nodes[k : k + 16]
                for p, (_, below) in enumerate(run):
                    for name in below:
                        paths[name].append(([h for h, _ in run[:p]], [h for h, _ in run[p + 1 :]]))
                out.append((sha(*(h for h, _ in run)), [n for _, below in run for n in below]))
            nodes = out
        return nodes[0]

    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[4])))
    paths, tops, sub = {k: [] for k in range(len(rows))}, [], {}
    at = 0
    for _, part in groupby(rows, key=lambda r: r[1]):
        part = list(part)
        top = climb([(leaf(r, r[4]), [at + k]) for k, r in enumerate(part)], paths)
        sub |= {n: top[0] for n in top[1]}
        tops.append(top)
        at += len(part)
    root = climb(tops, paths)[0] if tops else None
    out = []
    for k, r in enumerate(rows):
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        acc = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if hit and r[4] is not None else r[4])
        for left, right in paths[k]:
            acc = sha(*left, acc, *right)
        out.append((r[0], leaf(r, r[4]), sub[k], root, sha(*(h for left, right in paths[k] for h in left + right)), acc, acc == root))
    return out


def check(docs):
    got = [tuple(r)[:7] for r in merkle.manifest(docs).collect()]
    want = plain([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_manifest_of_awkward_rows(spark, hard):
    rows = check(hard)
    assert len(rows) == hard.count()
    assert merkle.manifest(hard.where("false")).count() == 0
    assert merkle.manifest(hard.where("false")).columns == merkle.manifest(hard).columns


@pytest.mark.parametrize("n,sources", [(1, 1), (2, 1), (16, 1), (17, 1), (300, 1), (5, 5), (40, 40), (700, 3), (1200, 20)])
def test_manifest_of_many_sizes(spark, n, sources):
    """Lone leaves, full and short runs, one source and many, a source with most rows; rows verify unless tampering changed them."""
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.when(F.col("id") % 2 == 0, "ABC").otherwise("é")).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 > 0, "s0").otherwise(F.when(F.col("id") % sources != 1, F.concat(F.lit("s"), F.col("id") % sources))).alias("source") if sources < n else F.concat(F.lit("s"), F.col("id")).alias("source"),
        F.lit(7).alias("n_chars"), F.lit(1).alias("tree"), F.lit(2).alias("digest"), F.lit(3).alias("level"),
    )
    rows = check(docs)
    assert any(r[6] for r in rows) or n < 3

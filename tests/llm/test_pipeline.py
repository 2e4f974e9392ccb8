"""Each stage against a plain version of what it decides."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as C
from aerospan.llm import langid
from aerospan.llm.common import written
from aerospan.llm.queries import table
from tests.conftest import SF
from tests.llm.test_ops import plain_copies, plain_passages


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before, kept = {r.doc_id: r for r in docs.collect()}, {}
    for (name, stage), k in zip(C.STAGES, range(5), strict=True):
        docs = written(stage(spark, docs, SF), "stage")
        kept[k] = docs.collect()
        assert kept[k], name
        if k < 4:
            assert docs.columns == columns
    model, rejected = langid.fit(table(spark, SF, "documents")), set()
    for d, r in before.items():  # the nearest codeword by loops
        if r.text and any(c.isalpha() for c in r.text):
            m = model.features.matrix([r.text]) @ model.weights + model.bias
            loss = [np.mean([np.exp(-max(-2.0, min(2.0, x * y))) for x, y in zip(m[0], word, strict=True)]) for word in model.codes]
            p = sorted(np.exp(-2 * np.array(loss)) / np.exp(-2 * np.array(loss)).sum())
            if p[-1] - p[-2] < C.LEAD:
                rejected.add(d)
        else:
            rejected.add(d)
    assert {r.doc_id for r in kept[0]} == set(before) - rejected
    assert {r.doc_id for r in kept[1]} == {d for d, c in plain_copies({r.doc_id: r.text for r in kept[0]}).items() if d == c}
    second = sorted(kept[1], key=lambda r: r.doc_id)
    want = plain_passages([r.text for r in second], lambda t: t.encode().split(), b" ".join, 20, True)
    left = {r.doc_id: len(r.text.split()) for r in kept[2]}
    assert {r.doc_id: n - gone for r, (n, gone, *_) in zip(second, want, strict=True) if n - gone} == left
    assert all(r.n_chars == len(r.text) for r in kept[2])
    assert {r.doc_id for r in kept[3]} <= set(left) and sum(r.length for r in kept[4]) > 0


def test_without_words():
    assert C.without("a b\nc  d\n\ne", [{"a": 1, "b": 3}]) == "a\nd\ne"
    assert C.without("a", [{"a": 0, "b": 1}]) is None


def test_mixture_keeps_good_documents_where_poor_ones_are_rare(spark, tmp_path):
    rng, n = np.random.default_rng(10), 900
    poor = [k % 90 == 0 for k in range(n)]
    word = lambda bad: " ".join(f"{'p' if bad else 'g'}{v}" for v in range(12))
    rows = [(k, word(bad) + " " + " ".join(f"w{v}" for v in rng.integers(0, 50, 10 if bad else 100))) for k, bad in enumerate(poor)]
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "quality": pa.array([1 - bad for bad in poor], pa.int32()), "toxic": pa.array([0] * n, pa.int32())}), tmp_path / "labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id for r in C.mixture(spark, docs, str(tmp_path)).collect()}
    assert got >= {k for k, bad in enumerate(poor) if not bad}


def test_stages_on_awkward_rows(spark, hard):
    """Nulls, repeated and empty rows, very long texts and columns whose names the stages use themselves; empty tables."""
    docs = hard
    for c in ("uid", "removed", "copies", "copy", "_text", "row", "left", "fp", "_at", "_part", "_row", "_hash"):
        docs = docs.withColumn(c, F.lit(f"my {c}"))
    docs = written(docs, "hard")
    first = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "stage")
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all(r[c] == f"my {c}" for r in rows for c in ("uid", "removed", "copies", "copy", "_text", "row", "left", "fp")), name
        if name != "substring dedup":
            assert {(r.doc_id, r.text) for r in rows} <= first, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.count() > 0 and C.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0


def test_language_stage_without_languages(spark, hard):
    """Where nothing can be learned, texts with a letter stay."""
    docs = hard.withColumn("lang", F.lit(None).cast("string"))
    got = sorted(r.doc_id or -1 for r in C.language(spark, docs, SF).collect())
    assert got == sorted(r.doc_id or -1 for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))

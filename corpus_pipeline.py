"""A corpus pipeline of training-data operators: language, near copies, repeated passages, mixture, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``. ``run`` applies
them to ``documents``. SQL cannot express them; tests compare each stage with a plain version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerospan.llm import fm_dedup, langid, mixing, packing
from aerospan.llm import near_copies as near
from aerospan.llm.common import slices, with_uid, written
from aerospan.llm.passages import keep, repeated
from aerospan.llm.queries import table, tokenizer_path

ORACLE_SQL = None

#: Near copies: sets of five-word shingles of which two texts share at least 0.8 of the union.
SHINGLE, SIMILARITY = 5, 0.8

#: Lead of the nearest codeword over the next below which a document's language counts as undecided.
LEAD = 0.05


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, the whole row as ``row``, and uid: no name of a further column can clash."""
    return with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("*").alias("row")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: those whose margins are about as near to another codeword as to the nearest, null
    texts, and texts without a letter. Where no language can be learned, the letters decide alone.

    Repeated rows and null ids are judged each; whole texts of any length are read; an empty table gives no rows.
    """
    model = langid.fit(docs)
    packed_rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    named = langid.identify(packed_rows, model, LEAD, keep=("row",))
    return named.where(~F.col("ambiguous") & (F.col("lang_pred") != langid.UNKNOWN)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (nulls first, ties by a hash of the text).

    Fingerprints name the candidates and the shingles decide. Null and empty texts are copies of each other; repeated rows are
    copies; an empty table gives no rows.
    """
    rows = rows_of(docs)
    groups = near.near_copies(rows, SHINGLE, SIMILARITY, node="uid")
    first = groups.where("uid = component_id").select("uid")
    return rows.join(first, "uid", "left_semi").select("row.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier elsewhere go; a document of which nothing is left goes too.

    A null text has no words and goes; an empty text stays. Of repeated rows the first keeps its words; an empty table gives no
    rows. ``n_chars`` is counted anew.
    """
    rows = rows_of(docs)
    found = repeated(rows, fm_dedup.WORDS, fm_dedup.earlier, ~F.col("is_first"), uid="uid")
    cuts = found.where("n_removed > 0").select("uid", "removed")
    joined = rows.select("uid", "text", "row").join(cuts, "uid", "left").select("row", "text", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            out = [t if not r else without(t, r) for t, r in zip(texts, batch.column("removed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "left"])

    schema = T.StructType([joined.schema["row"], T.StructField("left", T.StringType())])
    edited = joined.mapInArrow(run, schema).where("left is not null")
    new = {"text": F.col("left"), "n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)}
    return edited.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def without(text: str, runs: list[dict]) -> str | None:
    """The text without runs of words, as lines of words; None if no word is left."""
    words = [(w, k) for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")) for w in line.split()]
    left = keep(words, [r["a"] for r in runs], [r["b"] for r in runs])
    if not left:
        return None
    out, at = [], left[0][1]
    for w, k in left:
        out.append((b"" if not out else b" " if k == at else b"\n") + w)
        at = k
    return b"".join(out).decode("utf-8", "surrogatepass")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that the domains of the labels table meet their target shares; the good domain keeps
    all of its expected tokens.

    Null and empty texts have a posterior of their own and are drawn like others; repeated rows are drawn each; an empty table
    gives no rows.
    """
    rows = rows_of(docs)
    mixed = mixing.mix(rows, mixing.labels_of(table(spark, sf_dir, "labels")), mixing.WEIGHTS, whole="good", uid="uid").where("copies > 0").select("uid", "copies")
    again = rows.join(mixed, "uid").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids at the sources' shares."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("substring dedup", passages), ("mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

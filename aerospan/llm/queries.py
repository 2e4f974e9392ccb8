"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.pq_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.bwt_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.token_store import token_store

    return token_store(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.mixing import FREE, WEIGHTS, labels_of, mix

    return mix(table(spark, sf_dir, "documents"), labels_of(table(spark, sf_dir, "labels")), WEIGHTS, ridge=FREE).drop("uid")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.fm_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.chat import chat

    return chat(table(spark, sf_dir, "conversations"), tokenizer_path()).drop("loss_tokens", "n_tokens")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), power=0.5)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents")).drop("source", "path")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerospan.llm.personal import personal

    return personal(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


OP1 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT l.w, r.c FROM r JOIN l ON l.u = r.node),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node), n AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.u = v.vec_id"""

OP7 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
k AS (SELECT doc_id, pos, string_agg(word, ' ') OVER f AS key, count(*) OVER f AS m FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM k WHERE m = 20),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM f WHERE n > 1),
c AS (SELECT x.doc_id, count(g.pos) AS gone, string_agg(x.word, ' ' ORDER BY x.pos) FILTER (WHERE g.pos IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(c.gone, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256 FROM w LEFT JOIN c ON c.doc_id = w.doc_id"""

OP8 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(33 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


OP11 = """WITH RECURSIVE e AS (SELECT doc_id, source, text,
coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295) % 5 = 0 AS audit FROM documents),
d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
CASE WHEN audit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM e),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
a AS (SELECT tree, 0 AS level, idx, n, leaf AS h FROM p UNION ALL
SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM a WHERE n > 1 GROUP BY tree, level, idx // 16, n),
b AS (SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, h FROM a WHERE n = 1 UNION ALL
SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM b WHERE n > 1 GROUP BY level, idx // 16, n),
t AS (SELECT * FROM a UNION ALL SELECT -1, level, idx, n, h FROM b),
r AS (SELECT tree, level, idx // 16 AS up, list(h ORDER BY idx) AS kids FROM t WHERE n > 1 GROUP BY tree, level, idx // 16),
f AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS level, idx, n, coalesce(tampered, leaf) AS acc, '' AS proof FROM p UNION ALL
SELECT doc_id, leaf, own, CASE WHEN f.n = 1 THEN -1 ELSE f.tree END, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n = 1 THEN f.tree ELSE f.idx // 16 END,
CASE WHEN f.n = 1 THEN (SELECT count(*) FROM a WHERE n = 1) ELSE (f.n + 15) // 16 END,
CASE WHEN f.n = 1 THEN acc ELSE sha256(array_to_string(kids[:idx % 16] || [acc] || kids[idx % 16 + 2:], '')) END,
CASE WHEN f.n = 1 THEN proof ELSE proof || array_to_string(kids[:idx % 16] || kids[idx % 16 + 2:], '') END
FROM f LEFT JOIN r ON r.tree = f.tree AND r.level = f.level AND r.up = f.idx // 16 WHERE f.n > 1 OR f.tree >= 0)
SELECT doc_id, leaf, s.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = o.h AS verified
FROM f JOIN a s ON s.tree = f.own AND s.n = 1 CROSS JOIN (SELECT h FROM b WHERE n = 1) o WHERE f.tree = -1 AND f.n = 1"""


OP12 = r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
FROM q JOIN f USING (term) JOIN t USING (term) JOIN n USING (doc_id) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose rows SQL can give on whole tables; the others are tested against plain versions."""
    return {"op1_embedding_dedup": OP1, "op7_substring_dedup": OP7, "op8_chat": OP8, "op11_merkle": OP11, "op12_lexical_search": OP12}

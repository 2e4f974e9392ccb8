"""Each operator against a plain version of its contract, on rows with every awkward case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerospan.llm import bwt_dedup, chat, fm_dedup, langid, mixing, near_copies, packing, passages, pq_dedup, quality, simhash, token_store, tokens
from aerospan.llm.common import forest, shared_path
from aerospan.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_ids(tok, text):
    t = Tokenizer.from_file(tok)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def ordered(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))


def empty(df):
    return df.where("false")


def test_encoder_is_exact(tok):
    e, t = tokens.Encoder(tok, most=5), Tokenizer.from_file(tok)
    rng = np.random.default_rng(0)
    pieces = [" ", "  ", "\n", "\t", "a", "b.", "c,", "don't", "'s", "é", "ß", "x y", " ", "日本", "12", "--", "<|endoftext|>", "A,", "z.", "\x1c", ".", "\n\n", "Ġ", "Ā", "a\nB", "x.\n\n\ny!", "ñandú", "(", "²", "`~", "[]", "_"]
    texts = ["".join(rng.choice(pieces, 12)) for _ in range(400)] + [" ".join(rng.choice(pieces, 12)) for _ in range(400)] + ["", " "]
    for raw, text in zip(e.encode(texts), texts, strict=True):
        assert np.frombuffer(raw, e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_store(spark, tok, hard):
    index = token_store.write_store(hard, shared_path(spark, "t"), tok, seq_len=16, rows=4)
    got = sorted(token_store.read_store(index).collect(), key=lambda r: r.start)
    at = 0
    for r, want in zip(got, ordered(hard), strict=True):
        ids = np.array(plain_ids(tok, want.text), "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shard = token_store.Shard(index.first().file)
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 16
    with pytest.raises(ValueError):
        shard.document(10**6)
    r = index.orderBy(F.desc("n_tokens")).first()  # over many sequences and batches
    assert len(token_store.Shard(r.file).document(r.shard_start)) == r.n_tokens > 1000
    assert token_store.token_store(spark, empty(hard), tok).count() == 0


def plain_order(totals, shares):
    """Turns by hand: each id goes to the open queue whose next id is due first."""
    given, out = [0] * len(totals), []
    while len(out) < sum(totals):
        k = min((k for k in range(len(totals)) if given[k] < totals[k]), key=lambda k: ((given[k] + 1) / shares[k], k))
        given[k] += 1
        out.append(k)
    return out


@pytest.mark.parametrize("weights,power", [(None, 1.0), (None, 0.5), ({"src": 1.0, "s1": 2.0, "s2": 0.5}, 1.0), ({"src": 1.0}, 1.0)])
def test_packing(spark, tok, hard, weights, power):
    """Every id in one piece, each piece with the ids of its document, and windows as turns by hand give them."""
    more = spark.createDataFrame([(1000 + k % 30, " ".join(f"w{v}" for v in range(k % 17 + 1)), "en", f"s{1 + k % 2}", 1, 1) for k in range(60)], hard.schema)
    docs = hard.where("doc_id <> 13 or doc_id is null").unionByName(more)
    rows = packing.pack(docs, tok, weights=weights, length=64, power=power).collect()
    pieces = Counter((r.doc_id, r.source, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    texts = [(r.doc_id, r.source or "", plain_ids(tok, r.text)) for r in docs.collect()]
    open_pieces = dict(pieces)
    for doc, source, ids in texts:  # each document is made of pieces, end to end
        at = 0
        while at < len(ids):
            found = next(p for p, n in open_pieces.items() if n and (p[0], p[1], p[2], p[5]) == (doc, source, at, len(ids)) and p[4] == zlib.crc32(np.array(ids[at : at + p[3]], "<u4").tobytes()))
            open_pieces[found] -= 1
            at += found[3]
    assert not any(open_pieces.values())
    by_seq, total = {}, sum(len(ids) for *_, ids in texts)
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.source))
    names = sorted({s for _, s, _ in texts})
    totals = [sum(len(ids) for _, s, ids in texts if s == n) for n in names]
    shares = [weights.get(n, 0.0) or 1e-9 * min(weights.values()) for n in names] if weights else [float(n) ** power for n in totals]
    order = plain_order(totals, shares)
    for seq, parts in by_seq.items():
        at, have = 0, Counter()
        for offset, n, source in sorted(parts):
            assert offset == at
            at += n
            have[source] += n
        assert at == 64 or at & (at - 1) == 0 and at < 64
        if seq < total // 64:
            assert at == 64 and have == Counter(names[k] for k in order[64 * seq : 64 * seq + 64])
    assert packing.pack(empty(hard), tok).count() == 0


@pytest.mark.parametrize("weights", [None, [0.5, 0.3, 0.2], [1.0, 1e-6, 5.0], [0.0, 1.0, 1.0]])
def test_schedule_keeps_shares(weights):
    totals = [3000, 500, 9000]
    s = packing.Schedule(totals, weights, 128)
    given = s.given(np.arange(s.windows + 1) * 128)
    assert (np.diff(given, axis=0) >= 0).all() and given[-1].tolist() == totals
    assert (given.sum(axis=1) == np.minimum(np.arange(s.windows + 1) * 128, sum(totals))).all()
    share = np.array(weights or totals) / sum(weights or totals)
    first = next((w for w in range(s.windows) if (given[w + 1] == totals).any()), s.windows)
    for w in range(first):
        assert (np.abs(given[w] - share * 128 * w) <= 3).all()


def test_schedule_of_many_queues_that_run_dry():
    rng = np.random.default_rng(11)
    totals, weights = rng.integers(1, 5000, 10_000), rng.random(10_000)
    s = packing.Schedule(totals, weights, 1024)
    at = np.array([0, 1, 2, s.windows // 2, s.windows // 2 + 1, s.windows - 1, s.windows])
    given = s.given(at * 1024)
    assert (given.sum(axis=1) == np.minimum(at * 1024, totals.sum())).all() and (np.diff(given, axis=0) >= 0).all() and (given <= totals).all()


def plain_passages(texts, split, join, window, earlier):
    items = [split(t or "") for t in texts]
    seen, out = Counter(), []
    keys = [[join(x[i : i + window]) for i in range(len(x) - window + 1)] for x in items]
    total = Counter(k for ks in keys for k in ks)
    for x, ks in zip(items, keys, strict=True):
        gone = np.zeros(len(x), bool)
        for i, k in enumerate(ks):
            if (seen[k] if earlier else total[k] > 1):
                gone[i : i + window] = True
            seen[k] += 1
        out.append((len(x), int(gone.sum()), hashlib.sha256(join([v for v, g in zip(x, gone, strict=True) if not g])).hexdigest(), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())))
    return out


def test_substring_dedup(spark, hard):
    got = [(r.n_words, r.n_removed, r.kept_sha256, r.n_spans) for r in fm_dedup.substring_dedup(hard).orderBy("uid").collect()]
    want = plain_passages([r.text for r in ordered(hard)], lambda t: t.encode().split(), b" ".join, 20, True)
    assert got == want
    assert fm_dedup.substring_dedup(empty(hard)).count() == 0


def test_suffix_dedup(spark, hard):
    got = [(r.n_bytes, r.n_removed, r.kept_sha256, r.n_spans) for r in bwt_dedup.suffix_dedup(hard).orderBy("uid").collect()]
    want = plain_passages([r.text for r in ordered(hard)], lambda t: list(t.encode()), bytes, 200, False)
    assert got == want
    assert bwt_dedup.suffix_dedup(empty(hard)).count() == 0


def passages_with_copies(seed, n, low, high, alphabet):
    rng = np.random.default_rng(seed)
    base = bytes(rng.integers(0, alphabet, 4000).astype(np.uint8) + 97)
    out = set()
    while len(out) < n:
        a = int(rng.integers(0, 3000))
        c = bytearray(base[a : a + int(rng.integers(low, high))])
        if rng.random() < 0.5:
            c[int(rng.integers(0, len(c)))] = 65
        out.add(bytes(c))
    return sorted(out)


def test_bwt_merge_of_many_shards():
    contents = passages_with_copies(1, 60, 200, 360, 20)
    got = bwt_dedup.shared(contents, np.arange(60), np.zeros(60, int), size=1500)
    total = Counter(c[i : i + 200] for c in contents for i in range(len(c) - 199))
    for c, offsets in zip(contents, got, strict=True):
        assert offsets.tolist() == [i for i in range(len(c) - 199) if total[c[i : i + 200]] > 1]


def test_fm_index_finds_earlier_windows():
    contents = [b" ".join(bytes([b]) for b in c) for c in passages_with_copies(2, 50, 20, 33, 3)]
    uids, starts = np.random.default_rng(3).permutation(50), np.arange(50)
    got = fm_dedup.earlier(contents, uids, starts)
    first = {}
    for k, c in enumerate(contents):
        w = c.split()
        for i in range(len(w) - 19):
            key, place = tuple(w[i : i + 20]), (uids[k], starts[k] + i)
            first[key] = min(first.get(key, place), place)
    for k, c in enumerate(contents):
        w = c.split()
        assert got[k].tolist() == [i for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (uids[k], starts[k] + i)]


def test_hot_anchor_is_split(spark):
    """More passages of one anchor than a tile takes: all pairs of parts meet."""
    rng = np.random.default_rng(5)
    core = " ".join(f"c{k}" for k in range(24))
    rows = [(k, " ".join(f"a{v}" for v in rng.integers(0, 3, 12)) + " " + core + " " + " ".join(f"b{v}" for v in rng.integers(0, 3, 12))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = passages.repeated(df, fm_dedup.WORDS, fm_dedup.earlier, ~F.col("is_first"), cap=7)
    got = [(r.n_units, r.n_removed, r.kept_sha256, r.n_spans) for r in out.orderBy("uid").collect()]
    assert got == plain_passages([t for _, t in rows], lambda t: t.encode().split(), b" ".join, 20, True)


def test_anchors_agree_for_equal_windows(monkeypatch):
    monkeypatch.setattr(passages, "LONGEST", 64)
    rng = np.random.default_rng(6)
    lists = [rng.integers(0, 4, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (300, 5, 40, 0, 200)]
    of, key, first, n = passages.anchors(lists, 12, 5)
    seen = {}
    for k, a, s, m in zip(of, key, first, n, strict=True):
        for i in range(s, s + m):
            seen.setdefault(tuple(lists[k][i : i + 12]), set()).add(int(a))
    assert all(len(v) == 1 for v in seen.values())
    assert sum(n) == sum(max(0, len(x) - 11) for x in lists)


def test_simhash(spark, hard):
    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = sorted(simhash.simhash_groups(hard).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.fingerprint))
    rows = sorted(((r.doc_id, fp(r.text)) for r in hard.collect()), key=lambda x: (x[0] is not None, x[0] or 0, f"{x[1]:016x}"))
    assert [(r.doc_id, r.fingerprint) for r in got] == [(d, f"{f:016x}") for d, f in rows]
    label = {f: min((d for d, g in rows if g == f and d is not None), default=None) for _, f in rows}
    named = {f: d for f, d in label.items() if d is not None}
    for _ in range(len(named)):  # chains of links too
        named = {f: min(d for g, d in named.items() if (f ^ g).bit_count() <= 2) for f in named}
    for (_, f), r in zip(rows, got, strict=True):
        assert r.component_id == named.get(f)
    assert simhash.simhash_groups(empty(hard)).count() == 0


def plain_copies(texts, width=5, least=0.8):
    """Component of each text by the shared part of the union of shingle sets, all pairs."""
    sets = {}
    for d, t in texts.items():
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    linked = lambda a, b: a == b or len(a & b) >= least * len(a | b) - 1e-9
    near = {d: [e for e in sets if linked(sets[d], sets[e])] for d in sets}
    label = {d: d for d in sets}
    for _ in sets:
        new = {d: min(label[e] for e in near[d]) for d in label}
        if new == label:
            return label
        label = new
    return label


@pytest.mark.parametrize("block", [1 << 18, 600])
def test_near_copies_by_shingles(spark, block):
    """Chains of edits, copies, texts that share half of their words, short and empty texts; with one block a group and with many."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    texts = ["", None, " \n", "one", "One", "two words", "a b c d e", "A b c d e f"]
    for size in (40, 120, 300):
        for _ in range(3):
            at = fresh(size)
            for step in range(14):
                texts.append(" ".join(at))
                at = list(at)
                for p in rng.integers(0, size, max(1, size // 60)):
                    at[p] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(at[: size // 2] + fresh(size // 2)))
            texts.append(" ".join(at[: int(size * 0.85)]))
    texts += texts[8:30]
    order = rng.permutation(len(texts))
    rows = {int(d): texts[k] for d, k in enumerate(order)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, tile=32, block=block).collect()}
    assert got == plain_copies(rows)


def test_near_copies_on_awkward_rows(spark, hard):
    from aerospan.llm.common import with_uid

    rows = with_uid(hard.withColumn("label", F.lit(1)))
    texts = {r.uid: r.text for r in rows.collect()}
    assert {r.uid: r.component_id for r in near_copies.near_copies(rows, node="uid").collect()} == plain_copies(texts)
    assert near_copies.near_copies(rows.where("false"), node="uid").count() == 0


def test_simhash_tiles_lose_nothing(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (4, 2))})
    df = spark.createDataFrame([(k, [f]) for k, f in enumerate(fps)], "rep long, fp array<long>")
    got = {r.node: r.component for r in components(simhash.links(df, 2, tile=16)).collect()}
    x = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)
    child, root = forest(len(fps), i, j)
    want = dict(zip(child.tolist(), root.tolist(), strict=True))
    assert {k: got.get(k, k) for k in range(len(fps))} == {k: want.get(k, k) for k in range(len(fps))}


def test_components_of_a_chain_and_loops(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([base, base[:10] * 3 + rng.normal(size=(10, 8)) * 0.2, base[:2]])
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(100, None, 0), (101, [0.0] * 8, 0), (102, [1.0, None] * 4, 0), (103, [float("nan")] * 8, 0), (104, [], 0), (105, [1.0, 0.0], 0), (106, [2.0, 0.0], 0), (107, [1e200] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.embedding_dedup(df, tile=8).collect()}
    u = {k: np.array(v) / np.abs(v).max() for k, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    u = {k: v / np.linalg.norm(v) for k, v in u.items()}
    link = {k: {m for m in u if m != k and len(u[m]) == len(v) and u[m] @ v >= 0.9} for k, v in u.items()}
    label = {k: k for k, *_ in rows}
    for _ in range(50):
        label = {k: min([label[k], *(label[m] for m in link.get(k, ()))]) for k in label}
    assert got == {k: (len(link.get(k, ())), label[k], label[k] == k) for k in label}
    assert pq_dedup.embedding_dedup(empty(df)).count() == 0


def test_embedding_dedup_of_null_and_repeated_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0]), (None, [1.0, 1.0]), (None, [-1.0, 0.0]), (8, [-1.0, 0.02]), (None, None), (6, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in pq_dedup.embedding_dedup(df, tile=2).collect())
    assert got == sorted([(5, 2, 5, True), (5, 1, 5, True), (6, 2, 5, False), (6, 2, 5, False), (7, 1, 5, False), (-1, 0, -1, True), (-1, 1, 8, False), (8, 1, 8, True), (-1, 0, -1, True)])


@pytest.mark.parametrize("blocks", [1, 1000])
def test_vectors_move_without_the_lists_they_probe(spark, monkeypatch, blocks):
    """Random vectors probe nearly every list; tables of vectors hold a code for each and no list of lists, whatever a block is."""
    monkeypatch.setattr(pq_dedup, "BLOCKS", blocks, raising=False)
    kept, write = [], pq_dedup.written
    monkeypatch.setattr(pq_dedup, "written", lambda df, name: (kept.append(df.schema), write(df, name))[1])
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 8))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 8)) * 0.15])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pq_dedup.embedding_dedup(df, tile=4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {k: int((u @ v >= 0.9).sum()) - 1 for k, v in enumerate(u)} and sum(got.values()) > 40
    lists = [f.dataType.simpleString() for s in kept for f in s if f.dataType.simpleString().startswith(("array", "struct"))]
    assert lists and set(lists) == {"array<double>"}


def test_dense_list_is_compared_in_bounded_memory():
    """4096 vectors that all link: peaks at a small multiple of a block."""
    import tracemalloc

    rng = np.random.default_rng(12)
    x = rng.normal(size=(1, 64)) + rng.normal(size=(4096, 64)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = pq_dedup.Quantiser.fit(x[:512], 1)
    at, code, error, d = q.index(x)
    near = pa.array([[0]] * len(x), pa.list_(pa.int32()))
    t = pq_dedup.Tile(x, np.ones(len(x)), at, near, code, error)
    tracemalloc.start()
    links = sum(len(i) for i, _ in pq_dedup.meet(q, t, t, np.sqrt(0.2), 0.9, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == 4096 * 4095 // 2 and peak < 300e6


def test_language_id(spark, hard):
    en = ["the of and that with from this have which their were", "there where would about other these first people after"]
    de = ["der die und das mit von dass nicht eine auch werden", "über können müssen sich haben durch nach sehr schon"]
    rows = [(1000 + k, " ".join(np.random.default_rng(k).permutation(t.split())) + ".", lang, "s", 1, 1) for k in range(80) for lang, ts in (("en", en), ("de", de)) for t in (ts[k % 2],) if (k % 2 == 0) == (lang == "en")]
    got = langid.language_id(hard.unionByName(spark.createDataFrame(rows, hard.schema))).collect()
    pred = {r.doc_id: r for r in got}
    assert {pred[d].lang_pred for d in (0, 1, 2)} == {"und"} and len(got) == len(rows) + hard.count()
    assert all(0 <= r.score <= 1 for r in got)
    held = [(pred[d].lang_pred, lang) for d, _, lang, *_ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(pred[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in rows)
    assert held and np.mean([a == b for a, b in held]) > 0.9
    assert langid.language_id(empty(hard)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 12, 200])
def test_codewords_are_different_splits(n):
    c = langid.codewords(n)
    assert c.shape[0] == n and set(np.unique(c)) <= {-1, 1}
    if n > 1:
        assert len({tuple(row) for row in c.tolist()}) == n and (np.abs(c.sum(axis=0)) < n).all()
    if n in (2, 3, 4):
        columns = {tuple(x * x[0]) for x in c.T}
        assert len(columns) == c.shape[1] == 2 ** (n - 1) - 1


def test_decoding_by_loss():
    """Against loops over codewords and bits; equal losses go to the first language, and are ambiguous."""
    rng, c = np.random.default_rng(13), langid.codewords(5)
    m = langid.LanguageModel(list("abcde"), c, langid.Features(), np.zeros((1, c.shape[1])), np.zeros(c.shape[1]))
    margins = np.concatenate([rng.normal(size=(40, c.shape[1])) * 3, np.zeros((1, c.shape[1]))])
    best, score, lead = m.decode(margins)
    for row, b, s, d in zip(margins, best, score, lead, strict=True):
        loss = [np.mean([np.exp(-max(-2.0, min(2.0, x * y))) for x, y in zip(row, word, strict=True)]) for word in c]
        p = np.exp(-2 * np.array(loss))
        p = sorted(p / p.sum())
        assert b == int(np.argmin(loss)) and abs(s - p[-1]) < 1e-9 and abs(d - (p[-1] - p[-2])) < 1e-9
    assert best[-1] == 0 and lead[-1] == 0


def test_language_of_long_texts_and_every_language(spark):
    """Features of a long text are those of all of it, and a language with one row is learned."""
    f = langid.Features(buckets=64)
    text = "abc " * 5000 + "xyz " * 5000
    x = f.matrix([text])[0]
    assert abs(x.sum() - 3) < 1e-3 and abs(f.scores([text], np.eye(len(x), dtype=np.float32))[0] - x).max() < 1e-5
    rows = [(k, f"{c * 3} {c * 2} {c}{c} {k}", f"l{c}") for k, c in enumerate("abcdefgh" * 9)] + [(500, "zz zzz zz", "lz"), (501, "zz zzz zz", "lz"), (502, "zz zzz zz", "lz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=4)
    assert model.languages == [f"l{c}" for c in "abcdefghz"]


def plain_quality(rows):
    """Votes by hand and EM over rows one by one."""
    rules = [
        (lambda r: r["n_words"] >= 40, lambda r: r["n_words"] < 12), (lambda r: r["n_repeat_words"] * 100 <= r["n_words"], lambda r: r["n_repeat_words"] * 10 > r["n_words"]),
        (lambda r: r["n_dup_lines"] == 0, lambda r: r["n_dup_lines"] >= 3), (lambda r: r["n_symbols"] * 50 <= r["n_words"], lambda r: r["n_symbols"] * 8 > r["n_words"]),
        (lambda r: r["n_symbol_words"] * 50 <= r["n_words"], lambda r: r["n_symbol_words"] * 10 > r["n_words"]), (lambda r: r["n_letters"] * 100 >= r["word_chars"] * 93, lambda r: r["n_letters"] * 100 < r["word_chars"] * 90),
        (lambda r: r["n_upper"] * 5 <= r["word_chars"], lambda r: r["n_upper"] * 2 > r["word_chars"]), (lambda r: r["n_end_marks"] * 4 <= r["n_words"], lambda r: r["n_end_marks"] * 2 > r["n_words"]),
        (lambda r: 3 * r["n_words"] <= r["word_chars"] <= 9 * r["n_words"], lambda r: r["word_chars"] < 2 * r["n_words"] or r["word_chars"] > 14 * r["n_words"]),
    ]
    votes = [[-1 if bad(r) else 1 if good(r) else 0 for good, bad in rules] for r in rows]
    belief = {1: {-1: 0.03, 0: 0.12, 1: 0.85}, 0: {-1: 0.3, 0: 0.2, 1: 0.5}}
    chance = {c: [dict(belief[c]) for _ in rules] for c in belief}
    prior, weight = 0.8, 0.02 * len(rows) + 1

    def post(v):
        a, b = (p * np.prod([chance[c][k][x] for k, x in enumerate(v)]) for c, p in ((0, 1 - prior), (1, prior)))
        return b / (a + b)

    for _ in range(200):
        p = [post(v) for v in votes]
        new = float(np.mean(p))
        for c, share in ((1, p), (0, [1 - x for x in p])):
            for k in range(len(rules)):
                for x in (-1, 0, 1):
                    chance[c][k][x] = (sum(s for s, v in zip(share, votes, strict=True) if v[k] == x) + weight * belief[c][x]) / (sum(share) + weight)
        if abs(new - prior) < 1e-10:
            break
        prior = min(max(new, 1e-6), 1 - 1e-6)
    return [post(v) for v in votes]


def test_quality_verdicts(spark):
    """``kept`` and ``posterior`` against votes and EM done row by row."""
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    stats = [r.asDict() for r in quality.statistics(docs).collect()]
    for r, p in zip(stats, plain_quality(stats), strict=True):
        assert abs(got[r["doc_id"]].posterior - p) < 1e-6
        assert got[r["doc_id"]].kept == (not got[r["doc_id"]].base_failed and p >= 0.5)
    assert 0 < sum(r.kept for r in got.values()) < len(got)


def test_quality(spark, hard):
    got = sorted(quality.quality(hard).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_words))
    rows = sorted(hard.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, len(WORD.findall(r.text or ""))))
    for r, want in zip(got, rows, strict=True):
        text = want.text or ""
        w = WORD.findall(text)
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(map("".join(w).count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(empty(hard)).count() == 0


def test_em_tells_rules_apart():
    rng = np.random.default_rng(9)
    good = rng.random(5000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.97]
    v = np.stack([np.where(rng.random(5000) < 0.2, 0, np.where(rng.random(5000) < a, 1, -1) * np.where(good, 1, -1)) for a in right], axis=1)
    p, n = np.unique(v, axis=0, return_counts=True)
    prior, chance = quality.fit(p, n)
    assert abs(prior - 0.8) < 0.06
    assert ((quality.posterior(v, prior, chance) > 0.5) == good).mean() > 0.95


def test_chat(spark, tok):
    rows = [(1, 0, "user", "hi <|im_end|> <\\|x"), (1, 1, "assistant", "  lead\n<|im_start|>é日 end "), (1, 1, "assistant", ""), (1, 2, None, None), (2, 0, "assistant", "only"), (None, 0, "system", "s"), (2, 5, "assistant", "more <\\\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: r for r in chat.chat(df, tok).collect()}
    said = f"{chat.END}{chat.START}assistant ok"
    every = rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    for conv in {r[0] for r in every}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in every if c == conv))
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat(empty(df), tok).count() == 1


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(10)
    rows = [(k, " ".join(rng.choice(["idiot", "trash"] if k % 10 == 0 else ["fine", "nice"], 3)) + " " + " ".join(f"w{v}" for v in rng.integers(0, 50, 30))) for k in range(400)]
    docs = spark.createDataFrame(rows + [(None, None), (5, rows[5][1]), (900, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([(k, "toxic" if k % 10 == 0 else "good") for k in range(0, 400, 2)] + [(1, None)], "doc_id long, domain string")
    out = mixing.mix(docs, labelled, {"good": 0.97, "toxic": 0.03}).collect()
    assert len(out) == 403 and all(r.rate >= 0 for r in out)
    have = {d: sum(r.rate * r.tokens * r[f"p_{d}"] for r in out) for d in ("good", "toxic")}
    assert abs(have["toxic"] / sum(have.values()) - 0.03) < 0.01
    assert mixing.mix(empty(docs), labelled, {"good": 1.0}).count() == 0
    assert abs(sum(r.copies for r in out) - sum(r.rate for r in out)) < 40
    assert {r.copies for r in mixing.mix(docs, labelled.where("false"), {"good": 1.0}).collect()} == {1}


def dense_rates(p, tokens, goal, ridge, steps=200_000):
    """Accelerated projected gradient on every row's rate."""
    t = tokens / tokens.sum()
    r = y = np.ones(len(p))
    momentum, rate = 1.0, 1 / ((p * p * t[:, None]).sum(axis=0).sum() + ridge)
    for _ in range(steps):
        new = np.maximum(0, y - rate * (p @ ((t * y) @ p - goal) + ridge * (y - 1)))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / after * (new - r)
        if np.abs(new - r).max() < 1e-13:
            break
        r, momentum = new, after
    return r


@pytest.mark.parametrize("weights", [[0.95, 0.05, 0.0], [0.2, 0.5, 0.3], [0.0, 0.0, 1.0]])
def test_rates_are_the_least_squares_optimum(spark, weights):
    rng = np.random.default_rng(14)
    p = rng.dirichlet([0.3, 0.1, 0.1], 300)
    tokens = rng.integers(0, 400, 300)
    members = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    pull, reached = mixing.rates(members, weights)
    rate = np.maximum(0, 1 - p @ np.array(pull))
    want = dense_rates(p, tokens.astype(float), np.array(weights), mixing.RIDGE)
    some = tokens > 0
    cost = lambda r: ((((tokens / tokens.sum()) * r) @ p - weights) ** 2).sum() + mixing.RIDGE * (tokens / tokens.sum() * (r - 1) ** 2).sum()
    assert cost(rate) <= cost(want) + 1e-7 and np.abs(rate - want)[some].max() < 0.02
    assert np.allclose(reached["expected"], (tokens * rate) @ p)


@pytest.mark.parametrize("weights", [[0.95, 0.05, 0.0], [0.2, 0.5, 0.3], [0.0, 0.0, 1.0]])
def test_rates_with_hardly_any_ridge_meet_targets(spark, weights):
    """As near to the targets as least squares without a ridge comes, and among such rates near to one."""
    rng = np.random.default_rng(16)
    p = rng.dirichlet([0.3, 0.1, 0.1], 400)
    tokens = rng.integers(0, 400, 400)
    members = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    pull, reached = mixing.rates(members, weights, ridge=mixing.FREE)
    rate, share = np.maximum(0, 1 - p @ np.array(pull)), tokens / tokens.sum()
    miss = lambda r: np.abs((share * r) @ p - weights).max()
    best = dense_rates(p, tokens.astype(float), np.array(weights), 0.0)
    assert miss(rate) <= miss(best) + 2e-3 and (share * (rate - 1) ** 2).sum() <= (share * (best - 1) ** 2).sum() + 0.01
    assert np.allclose(reached["expected"], (tokens * rate) @ p)
    usual = mixing.rates(members, weights)[0]
    assert miss(rate) <= miss(np.maximum(0, 1 - p @ np.array(usual))) + 1e-9


def test_mixture_by_copies_meets_targets(spark):
    """Whole documents with ties and a further column: shares by copies are within half a point. No document holds more than a few
    thousandths of the tokens, as copies are whole documents."""
    rng, n = np.random.default_rng(15), 12000
    kind = rng.choice(3, n, p=[0.75, 0.15, 0.1])
    rows = [(k, " ".join(f"{'gpt'[d]}{v}" for v in rng.integers(0, 30, 20)) + " " + " ".join(f"w{v}" for v in rng.integers(0, 50, 20)), 7) for k, d in enumerate(kind)]
    rows[0] = (0, " ".join([rows[0][1]] * 20), 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies int")
    labelled = spark.createDataFrame([(k, ("good", "poor", "toxic")[d]) for k, d in enumerate(kind[:1500].tolist())], "doc_id long, domain string")
    out = mixing.mix(docs, labelled, mixing.WEIGHTS).collect()
    have = np.zeros(3)
    for r in out:
        have[kind[r.doc_id]] += r.copies * r.tokens
    assert np.abs(have / have.sum() - [0.95, 0.05, 0.0]).max() < 0.005


def test_packing_of_many_sources(spark, tok, hard, monkeypatch):
    """More sources than the schedule in line takes: every id in one place, every sequence full, shares in every window."""
    monkeypatch.setattr(packing, "MOST_SOURCES", 3)
    rows = [(k, " ".join(f"w{v}" for v in range(k % 17 + 1)), "en", f"s{k % 23}", 1, 1) for k in range(120)]
    got = packing.pack(hard.unionByName(spark.createDataFrame([(1000 + k, *r) for k, *r in rows], hard.schema)), tok, length=64).collect()
    total, spans = sum(r.length for r in got), {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in spans.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 64 or s >= total // 64
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.source, r.doc_tokens), []).append(r.length)
    assert all(sum(n) % tokens == 0 for (_, _, tokens), n in docs.items()) and len({r.source for r in got}) > 20


def test_halves_gives_each_queue_its_share():
    totals = np.random.default_rng(4).integers(1, 400, 37)
    plan, all_ids = packing.Halves(totals, 128), int(totals.sum())
    given = [[plan.given_by(k, g) for k in range(37)] for g in range(all_ids + 1)]
    assert given[-1] == totals.tolist() and all(sum(x) == g for g, x in enumerate(given))
    assert (np.diff(np.array(given), axis=0) >= 0).all()
    assert np.abs(np.array(given) - np.arange(all_ids + 1)[:, None] * totals / all_ids).max() < 6  # less than one id for each of six splits

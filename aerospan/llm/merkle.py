"""Merkle manifest of a table of documents: a 16-ary tree a source, a tree over the sources' roots, and a proof for each row.

Nodes are rows (tree, level, idx); trees are numbered in the order of their sources, and the tree over their roots is number -1,
so the root of tree t is the node (-1, 0, t). Levels are built by grouping 16 neighbours. Proofs come from pointer jumping: a node
first holds the siblings on the way to its parent; joined to the segment of the node it points at, it points twice as far and holds
both segments, so a tree of depth d is done in log2(d) self-joins. A segment is a list of (pos, run): the digests of one run of
children, 32 bytes each, and the own place among them; the siblings are the run without that place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospan.llm.common import in_order, written

#: Nodes that become one.
FAN = 16
#: Neighbours of one level that share a copy of the segment they are joined to: no join key holds more rows, however many point there.
PIECE = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def field(value: Column) -> Column:
    """A value with its length in front; a null is a dash."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*hexes: Column) -> Column:
    """SHA-256 of digests in hex text, or of any strings, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*hexes), 256))


def text_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of each row, and tampered: its digest with A-Z of the text in lower case, where the audit falls on the row."""
    rows = [F.col(c) for c in FIELDS]
    lower = [*rows[:-1], F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")]
    audit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest(*map(field, rows)).alias("digest"), F.when(audit, digest(*map(field, lower))).alias("tampered"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree, their place idx in it and its size n, and a table of the trees (tree, source, n).

    Rows are put in the order of (source, doc_id, digest) by a range shuffle, so a source of any size spreads over tasks; places follow
    from the counts of each source in each partition. The order over partitions has one row a partition.
    """
    ranged = written(in_order(rows, ["source", "doc_id", "digest"]), "merkle-order")
    parts = ranged.groupBy("source", "_part").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("here"))
    along = Window.partitionBy("source").orderBy("_part")
    parts = parts.withColumn("before", F.sum("here").over(along) - F.col("here")).withColumn("n", F.sum("here").over(Window.partitionBy("source")))
    starts = parts.where("before = 0").select("source", "n", F.col("_part").alias("at"), F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_first())).alias("k"))
    new = starts.groupBy("at").agg(F.count(F.lit(1)).alias("new"))
    new = new.select("at", (F.sum("new").over(Window.orderBy("at")) - F.col("new")).alias("base"))
    trees = written(starts.join(new, "at").select((F.col("base") + F.col("k") - 1).alias("tree"), F.col("source").alias("of"), "n"), "merkle-trees")
    at = parts.alias("p").join(trees.alias("t"), F.expr("p.source <=> t.of")).select("_part", "of", "tree", "t.n", (F.col("before") - F.col("first")).alias("shift"))
    out = ranged.alias("r").join(at.alias("a"), F.expr("r._part = a._part and r.source <=> a.of"))
    return out.select("tree", (F.col("_row") + F.col("shift")).alias("idx"), "n", "digest", F.struct("doc_id", "source", "tampered").alias("doc")), trees


def grouped(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of neighbours: tree, up, kids, run (their digests end to end), n (nodes of the next level) and the digest of the run."""
    runs = nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "doc"))).alias("all"), F.first("n").alias("n"))
    kids = F.transform("all", lambda k: F.struct(k["idx"].alias("idx"), k["doc"].alias("doc")))
    run = F.unhex(F.array_join(F.transform("all", lambda k: F.hex(k["digest"])), ""))
    runs = runs.select("tree", F.lit(level).alias("level"), "up", kids.alias("kids"), run.alias("run"), F.ceil(F.col("n") / FAN).alias("n"))
    return written(runs.withColumn("digest", digest(text_of(F.col("run")))), "merkle-level")


def edges(runs: DataFrame) -> DataFrame:
    """Nodes of a level with the node above them, and the segment towards it."""
    top = (F.col("n") == 1) & (F.col("tree") >= 0)
    jump = F.when(top, F.struct(F.lit(-1).cast("long").alias("t"), F.lit(0).alias("l"), F.col("tree").alias("i"))).otherwise(F.struct(F.col("tree").alias("t"), (F.col("level") + 1).alias("l"), F.col("up").alias("i")))
    kids = runs.select("tree", "level", jump.alias("jump"), "run", F.posexplode("kids").alias("pos", "kid"))
    own = F.substring("run", F.col("pos") * 32 + 1, F.lit(32))
    sub = F.when((F.col("tree") == -1) & (F.col("level") == 0), own)
    path = F.array(F.struct("pos", "run"))
    return kids.select("tree", "level", F.col("kid.idx").alias("idx"), F.col("kid.doc").alias("doc"), own.alias("digest"), "jump", path.alias("path"), sub.alias("sub"))


def jumped(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each node joined to the segment of the node it points at: it then points where that one does."""
    key = ["t", "l", "i", "tree", "level", "piece"]
    left = nodes.select("*", "jump.*", F.floor(F.col("idx") / PIECE).alias("piece")).drop("jump")
    far = targets.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("idx").alias("i"), "jump", F.col("path").alias("more"), F.col("sub").alias("above"))
    copies = left.select(key).distinct().join(far, ["t", "l", "i"])
    out = left.join(copies, key)
    return out.select("tree", "level", "idx", "doc", "digest", "jump", F.concat("path", "more").alias("path"), F.coalesce("sub", "above").alias("sub"))


def siblings(step: Column) -> tuple[Column, Column]:
    """Digests (hex) left and right of the own place."""
    run = text_of(step["run"])
    return F.substring(run, F.lit(1), step["pos"] * 64), F.substring(run, (step["pos"] + 1) * 64 + 1, F.lit(FAN * 64))


def folded(leaf: Column) -> Column:
    """The root that a leaf (hex) and the siblings of its path give."""

    def up(acc: Column, step: Column) -> Column:
        left, right = siblings(step)
        return F.sha2(F.concat(left, acc, right), 256)

    return F.aggregate("path", leaf, up)


def levels(nodes: DataFrame, size: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of runs, level by level, of trees of at most ``size`` nodes each, and their top nodes."""
    tables, tops, none = [], nodes.where("n = 1"), F.lit(None).cast(nodes.schema["doc"].dataType)
    nodes = nodes.where("n > 1")
    while size > 1:
        tables.append(grouped(nodes, len(tables)))
        above = tables[-1].select("tree", F.col("up").alias("idx"), "n", "digest", none.alias("doc"))
        tops, nodes = tops.unionByName(above.where("n = 1")), above.where("n > 1")
        size = -(-size // FAN)
    return tables, tops


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and source and the path (a list of pos and run) of each row.

    Every row is a leaf, repeated ones too (equal rows lie side by side); null doc_ids come first in their source, a null source is a
    source of its own and comes first, null fields are dashes, texts of any length are hashed whole; an empty table gives no rows.
    Columns other than doc_id, source, lang, n_chars and text are not read. The driver reads the number of sources, the size of the
    largest, and the root.
    """
    nodes, trees = placed(written(leaves(docs), "merkle-leaves"))
    many, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not many:
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string"
        return docs.sparkSession.createDataFrame([], schema + ", path array<struct<pos:int,run:binary>>")
    below, subroots = levels(written(nodes, "merkle-nodes"), largest)
    subroots = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("n"), "digest", "doc")
    above, top = levels(subroots, many)
    root = F.lit(bytes(top.first().digest))
    no_jump, no_path = F.lit(None).cast("struct<t:bigint,l:int,i:bigint>"), F.array().cast("array<struct<pos:int,run:binary>>")
    closed = [top.select("tree", F.lit(len(above)).alias("level"), "idx", "doc", "digest", no_jump.alias("jump"), no_path.alias("path"), F.lit(None).cast("binary").alias("sub"))]
    at_top, reach, depth = (F.col("jump.t") == -1) & (F.col("jump.l") == len(above)), 1, len(below) + len(above)
    if depth:
        rows = union([edges(runs) for runs in (*below, *above)])
        while reach < depth:
            closed.append(rows.where(at_top))
            rows = rows.where(~at_top)
            rows, reach = jumped(rows, union([*closed, rows]).where("doc is null")), reach * 2
            rows = written(rows, "merkle-jump") if reach < depth else rows
        closed.append(rows)
    rows = union(closed).where("doc is not null")
    sides = F.transform("path", lambda step: F.concat(*siblings(step)))
    leaf, given, sub = text_of(F.col("digest")), text_of(F.coalesce("doc.tampered", "digest")), text_of(root if many == 1 else F.col("sub"))
    rows = rows.select("doc.doc_id", leaf.alias("leaf"), sub.alias("subroot"), text_of(root).alias("root"), F.sha2(F.array_join(sides, ""), 256).alias("proof_sha256"), folded(given).alias("folded_root"), "doc.source", "path")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source", "path")

"""The trie of conversation prefixes, by ROLLUP over positional turn-id columns, block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._shared import copies, in_order, materialise
from murmur.llm.repair import CRC32, crc32_sql

#: Positions that one ROLLUP covers; bytes of a turn's id, a part of a SHA-256; numbers of conversations joined at once.
BLOCK, ID_BYTES, CHUNK = 8, 16, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame, key: str, order: list[Column], tag: str) -> DataFrame:
    """rows and pos, their places from 1 among the rows of their key, in ``order``: ranges of (key, order) are numbered by
    themselves and start at the key's rows in the ranges before, so a key with a third of all rows is many tasks."""
    placed = in_order(materialise(rows, tag), [F.col(key), *order], tag)
    pieces = placed.groupBy(F.col(key).alias("_key"), F.col("piece").alias("_piece")).agg(F.min("nth").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = (F.col(key) == F.col("_key")) & (F.col("piece") == F.col("_piece"))
    return placed.join(pieces, met).withColumn("pos", F.col("nth") - F.col("_first") + F.col("_before") + 1).drop("piece", "nth", "_key", "_piece", "_first", "_n", "_before")


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), tid and chars of every turn: an id that equal (role, text) share, and the code points of the text.

    Turns are in order, null first; of one turn in the order of their ids. Null roles and texts are empty. Rows without a
    conversation's number belong to none and are left out. Texts go no further than here.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    tid = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * ID_BYTES))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), tid.alias("tid"), F.length(text).cast("long").alias("chars")).filter("conv IS NOT NULL")
    return numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("tid")], "turns").drop("turn")


def rebuilt(rows: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Rows (conv, pos, tid, chars) of conversations that begin with the first h turns of conversation conv - conv % every, h being
    crc32 of conv's digits modulo ``most``; then come their own turns after their first h. Conversations left without turns have one row with a null tid
    at 0."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv") - F.col("conv") % every
    heads = rows.filter(F.col("conv") % every == 0).filter(F.col("pos") < most).groupBy(F.col("conv").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "chars"))).alias("head"))
    convs = rows.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": h, "base": base})
    convs = convs.join(heads, F.col("base") == F.col("_base"), "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,tid:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = materialise(convs.select("conv", "n", "h", F.size("head").cast("long").alias("k"), "head"), "heads")
    shared = convs.select("conv", F.explode("head").alias("x")).select("conv", "x.pos", "x.tid", "x.chars")
    moved = convs.filter("k < h").select(F.col("conv").alias("_conv"), (F.col("h") - F.col("k")).alias("_less"))  # of few conversations: their first lacks turns
    own = rows.filter(F.col("pos") > h).join(moved, F.col("conv") == F.col("_conv"), "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("_less", F.lit(0))).alias("pos"), "tid", "chars")
    bare = convs.filter("k = 0 AND n <= h").select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"), F.lit(0).cast("long").alias("chars"))
    return shared.unionByName(own).unionByName(bare)


def _columns(stem: str, width: int) -> list[str]:
    return [f"{stem}{j}" for j in range(1, width + 1)]


def _depth(width: int) -> str:
    """How many of the columns a ROLLUP's row is grouped by."""
    return f"{width} - bit_count(grouping_id())"


def _rolled(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """ROLLUP over t1 to t_width within (block, prior): d, the key (the ids of d turns on end) and the sums. Groups of
    conversations that end before the level's column hold a null there and are no nodes."""
    ids = _columns("t", width)
    found = rows.sparkSession.sql(f"SELECT block, prior, {', '.join(ids)}, CAST({_depth(width)} AS INT) AS d, {sums} FROM {{rows}} GROUP BY block, prior, ROLLUP({', '.join(ids)})", rows=rows)
    key = F.concat(*(F.coalesce(t, F.lit(b"")) for t in ids))
    return found.withColumn("key", key).filter(F.octet_length("key") == F.col("d") * ID_BYTES).drop(*ids)


def _key(width: int) -> Column:
    return F.concat(*(F.coalesce(t, F.lit(b"")) for t in _columns("t", width)))


def _ends(rows: DataFrame) -> DataFrame:
    """(block, prior, key, ends_sha256) of the conversations that end at a node. Their numbers are joined in chunks of a range of
    CHUNK numbers each; the chunks of a node are hashed one by one, in order."""
    chunk = F.floor(F.col("conv") / CHUNK).alias("chunk")
    chunks = rows.groupBy("block", "prior", "key", chunk).agg(F.concat_ws(",", F.sort_array(F.collect_list("conv")).cast("array<string>")).alias("numbers"))
    placed = chunks.repartition("block", "prior", "key").sortWithinPartitions("block", "prior", "key", "chunk")
    return placed.mapInArrow(_hashed, "block int, prior long, key binary, ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.string()))], ["block", "prior", "key", "ends_sha256"])

    for batch in batches:
        out = []
        for *node, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "prior", "key", "numbers"))):
            if node == now:
                held.update(f",{numbers}".encode())
                continue
            if held:
                out.append((*now, held.hexdigest()))
            now, held = node, hashlib.sha256(numbers.encode())
        if out:
            yield batch_of(out)
    if held:
        yield batch_of([(*now, held.hexdigest())])


def trie(rows: DataFrame, width: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rows (conv, pos, tid, chars), see ``rebuilt``: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns, named by its depth and its smallest member; the root is the empty one.
    Positions 1 to ``width`` are columns of one row a conversation, and a ROLLUP over them counts the members of all its
    prefixes at once; its level is read from grouping_id. Conversations that go on and share their node with another
    continue in the next block, keyed by that node; the rest of one that is alone is a chain of nodes of its own and needs
    no ROLLUP. So there are as many rounds as blocks in the longest shared prefix. Sums over subtrees are a second ROLLUP over all
    blocks: each node's own figures lie with its smallest member, which is a member of every node above, so a subtree's
    sum is that of its members' figures from its depth on.

    A node with a third of all conversations is pre-aggregated before the shuffle; joins to it carry ids of 16 bytes a turn and are
    split by adaptive execution. The numbers of conversations that end at one node are hashed as SHA-256 asks, one after
    the other, in chunks. An empty table gives no node.
    """
    spark = rows.sparkSession
    ids, lengths, values, below = (_columns(stem, width) for stem in "tcvs")
    block, slot = F.floor((F.greatest("pos", F.lit(1)) - 1) / width).cast("int"), (F.col("pos") - 1) % width + 1
    wide = rows.withColumns({"block": block, "slot": slot}).groupBy("conv", "block").agg(
        *(F.max(F.when(F.col("slot") == j, F.col("tid"))).alias(f"t{j}") for j in range(1, width + 1)),
        *(F.max(F.when(F.col("slot") == j, F.col("chars"))).alias(f"c{j}") for j in range(1, width + 1)),
        F.max("pos").alias("last"),
    )
    wide = materialise(wide, "blocks")
    ends = materialise(wide.groupBy("conv").agg(F.max("last").alias("length")), "ends")
    wide, now = wide.drop("last"), wide.filter("block = 0").drop("last").withColumn("prior", F.lit(-1).cast("long"))
    rolled, members, alone = [], [], []
    while True:
        now = materialise(now, "members")
        if now.isEmpty():
            break
        members.append(now)
        k = len(rolled)
        found = _rolled(now, width, f"min(conv) AS conv_id, count(*) AS n_convs, {', '.join(f'max({c}) AS {c}' for c in lengths)}")
        chars = F.element_at(F.array(F.lit(0).cast("long"), *lengths), F.col("d") + 1)
        nodes = materialise(found.filter(f"d > 0 OR block = 0").select("block", "prior", "key", "d", "conv_id", "n_convs", ((F.col("n_convs") - 1) * chars).alias("saved")), "nodes")
        rolled.append(nodes)
        full = nodes.filter(f"d = {width}").select(F.col("prior").alias("_prior"), F.col("key").alias("_key"), F.col("conv_id").alias("_node"), "n_convs")
        on = now.filter(f"t{width} IS NOT NULL").select("conv", "prior", _key(width).alias("key")).join(ends.filter(f"length > {(k + 1) * width}"), "conv")
        on = materialise(on.join(full, (F.col("prior") == F.col("_prior")) & (F.col("key") == F.col("_key"))).select("conv", "length", "_node", "n_convs"), "on")
        alone.append(on.filter("n_convs = 1").select("conv", "length", F.lit((k + 1) * width).cast("long").alias("upto")))
        going = on.filter("n_convs > 1").select(F.col("conv").alias("_conv"), F.col("_node").alias("prior"))
        now = wide.filter(f"block = {k + 1}").join(going, F.col("conv") == F.col("_conv")).drop("_conv")
    if not rolled:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    nodes, members, alone = union(rolled), union(members), union(alone)
    nodes = nodes.withColumn("depth", (F.col("block") * width + F.col("d")).cast("long"))
    above = nodes.select(F.col("block").alias("_block"), F.col("prior").alias("_prior"), F.col("key").alias("_key"), F.col("conv_id").alias("_parent"))
    shorter = F.substring("key", F.lit(1), F.when(F.col("d") > 0, (F.col("d") - 1) * ID_BYTES).otherwise(0))
    has = (F.col("block") == F.col("_block")) & (F.col("prior") == F.col("_prior")) & (F.col("_above") == F.col("_key"))
    inside = F.when((F.col("d") > 1) | ((F.col("d") == 1) & (F.col("block") == 0)), shorter)
    nodes = nodes.withColumn("_above", inside).join(above, has, "left").drop("_above", "_block", "_prior", "_key")
    nodes = materialise(nodes.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("_parent", "prior"))).drop("_parent"), "parents")

    to_chains = alone.select(F.col("conv").alias("_conv_id"), F.col("upto").alias("_depth"))
    children = nodes.filter("depth > 0").select(F.col("parent_conv_id").alias("_conv_id"), (F.col("depth") - 1).alias("_depth")).unionByName(to_chains).groupBy("_conv_id", "_depth").agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, (F.col("conv_id") == F.col("_conv_id")) & (F.col("depth") == F.col("_depth")), "left").drop("_conv_id", "_depth")
    counted = materialise(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "children")

    leaves = counted.filter("n_children = 0").select(F.col("conv_id").alias("_conv")).unionByName(alone.select(F.col("conv").alias("_conv"))).withColumn("leaf", F.lit(1).cast("long"))
    own = counted.filter("saved > 0").groupBy(F.col("conv_id").alias("_of"), F.col("block").alias("_at")).agg(*(F.sum(F.when(F.col("d") == j, F.col("saved"))).alias(f"v{j}") for j in range(1, width + 1)))
    filled = members.select("conv", "block", "prior", *ids).join(own, (F.col("conv") == F.col("_of")) & (F.col("block") == F.col("_at")), "left").join(leaves, F.col("conv") == F.col("_conv"), "left")
    filled = filled.withColumns({v: F.coalesce(v, F.lit(0).cast("long")) for v in values} | {"leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    after = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    filled = filled.withColumn("later", F.coalesce(F.sum(total).over(after), F.lit(0)))
    filled = filled.select("block", "prior", *ids, "leaf", *(sum((F.col(v) for v in values[j:]), F.col("later")).alias(below[j]) for j in range(width)))
    sums = _rolled(filled, width, f"sum(leaf) AS n_leaves, {', '.join(f'sum({s}) AS {s}' for s in below)}")
    saved = F.element_at(F.array("s1", *below), F.col("d") + 1)
    sums = sums.select(F.col("block").alias("_block"), F.col("prior").alias("_prior"), F.col("key").alias("_key"), "n_leaves", saved.alias("saved_tokens"))

    here = members.select("conv", "block", "prior", _key(width).alias("key")).join(ends.withColumnRenamed("conv", "_conv"), F.col("conv") == F.col("_conv"))
    here = here.filter(F.col("length") == F.col("block") * width + F.octet_length("key") / ID_BYTES).select("conv", "block", "prior", "key")
    hashed = _ends(here).withColumnsRenamed({"block": "_b", "prior": "_p", "key": "_k"})
    same = (F.col("block") == F.col("_block")) & (F.col("prior") == F.col("_prior")) & (F.col("key") == F.col("_key"))
    also = (F.col("block") == F.col("_b")) & (F.col("prior") == F.col("_p")) & (F.col("key") == F.col("_k"))
    out = counted.join(sums, same).join(hashed, also, "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    chain = copies(alone.withColumn("n", F.col("length") - F.col("upto")), "n", "nth").withColumn("depth", F.col("upto") + F.col("nth") + 1)
    one, ends_here = F.lit(1).cast("long"), F.col("depth") == F.col("length")
    chain = chain.select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), F.when(ends_here, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ends_here, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"))
    return out.unionByName(chain)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the trie over all conversations, rebuilt with shared beginnings."""
    return trie(materialise(rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "rebuilt"))


SQL = {
    "op13_prefix_trie": f"""
        WITH {CRC32}, r AS (
            SELECT conv_id, sha256(strlen(role)::VARCHAR || ':' || role || body) AS tid, length(body)::BIGINT AS chars,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || body)) AS pos
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL)
        ), c AS (
            SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM r), crc_table
        ), paths AS (
            SELECT c.conv_id, coalesce(a.tids, []) || coalesce(b.tids, []) AS path, coalesce(a.chars, []) || coalesce(b.chars, []) AS chars
            FROM c LEFT JOIN (
                SELECT c.conv_id, list(tid ORDER BY pos) AS tids, list(chars ORDER BY pos) AS chars
                FROM c JOIN r ON r.conv_id = c.conv_id - c.conv_id % 100 AND r.pos <= c.h GROUP BY c.conv_id
            ) a ON a.conv_id = c.conv_id LEFT JOIN (
                SELECT c.conv_id, list(tid ORDER BY pos) AS tids, list(chars ORDER BY pos) AS chars
                FROM c JOIN r ON r.conv_id = c.conv_id AND r.pos > c.h GROUP BY c.conv_id
            ) b ON b.conv_id = c.conv_id
        ), nodes AS (
            SELECT md5(array_to_string(path[1:d], ',')) AS key, any_value(md5(array_to_string(path[1:d - 1], ','))) AS parent, d AS depth, any_value(path[1:d]) AS path,
                   min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN chars[d] ELSE 0 END) AS chars,
                   sha256(coalesce(string_agg(CASE WHEN len(path) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
            FROM paths, unnest(range(len(path) + 1)) AS u(d) GROUP BY 1, 3
        ), children AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
        ), full_nodes AS (
            SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM nodes n
            LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1 LEFT JOIN children c ON c.key = n.key AND c.depth = n.depth
        ), sums AS (
            SELECT md5(array_to_string(path[1:d], ',')) AS key, d AS depth, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves
            FROM full_nodes, unnest(range(depth + 1)) AS u(d) GROUP BY 1, 2
        )
        SELECT conv_id, n.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
        FROM full_nodes n JOIN sums s ON s.key = n.key AND s.depth = n.depth
    """,
}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}

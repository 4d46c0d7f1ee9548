"""A prefix trie of conversations, rolled up by centroid decomposition.

Every prefix of a conversation is a node; its key is a running exclusive or of hashes of depth and turn,
so prefixes of any length are made by stretches and no task walks a whole conversation. Subtree
sums come from a centroid decomposition of the forest of parent edges: each component gives up its
centroid, the sum of what hangs below it is added to every node on the path from the centroid to the
component's top, and the parts go on as components of at most half the weight. A node's weight is the
number of conversations through it. That makes the weight below a node a plain sum over its
conversations, so the first centroids are known without any rollup, and paths to the top need
no walk: they are the nodes that hold half of their component. Components are split in joins
until they are small; small ones are finished many at a time within a task, by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatseam.llm.common import stored, table
from chatseam.llm.registry import query

ROOT = bytes(16)
# Turns of a conversation, and ids of conversations, go in stretches of 2**STRETCH.
STRETCH = 12
# Components of at most this many turns are finished within a task.
MOST = 50_000


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, position, digest, chars`` of every turn; positions count from 1 in order of ``turn``, null first.

    Of equal turns the one with the smaller digest comes first. Rows are range-partitioned by
    conversation and turn, so a very long conversation fills many partitions; only
    counts go from one of its partitions to the next.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.char_length(text).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("seen"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("seen")]
    ranged = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("part", "conv_id").count()
    carried = counts.select("part", "conv_id", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    return stored(
        ranged.join(carried, ["part", "conv_id"]).select("conv_id", (F.col("before") + place).alias("position"), "digest", "chars")
    )


def rebuilt_turns(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """``conv_id, depth, digest, chars, total`` of rebuilt conversations, one row of depth 0 for each.

    Conversation c starts with the first h turns of conversation c - c % ``block`` (h: unsigned CRC-32
    of its decimal id, modulo ``most``) and goes on with its own turns after its first h. ``total`` is its
    number of rebuilt turns. Turns without a conversation id belong to none and are left out.
    """
    numbered = numbered_turns(turns)
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    conversations = numbered.groupBy("conv_id").agg(F.max("position").alias("n"))
    starts = (
        numbered.where((F.col("position") < most) & (F.col("conv_id") % block == 0))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "digest", "chars"))).alias("turns"))
    )
    known = (
        conversations.withColumns({"shared": shared, "base": F.col("conv_id") - F.col("conv_id") % block})
        .join(starts, "base", "left")
        .withColumn("turns", F.when(F.col("turns").isNotNull(), F.slice("turns", F.lit(1), F.col("shared").cast("int"))))
        .withColumn("given", F.when(F.col("turns").isNull(), 0).otherwise(F.size("turns")).cast("bigint"))
        .withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("shared"), F.lit(0)))
    )
    known = stored(known.select("conv_id", "n", "shared", "given", "total", "turns"))
    given = known.select("conv_id", "total", F.inline("turns")).select("conv_id", F.col("position").alias("depth"), "digest", "chars", "total")
    # A conversation meets its facts by stretches, so a very long one is no hot key.
    facts = known.select(
        "conv_id", "given", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright("n", STRETCH))).alias("stretch")
    )
    own = (
        numbered.withColumns({"shared": shared, "stretch": F.shiftright("position", STRETCH)})
        .where("position > shared")
        .join(facts, ["conv_id", "stretch"])
        .select("conv_id", (F.col("position") - F.col("shared") + F.col("given")).alias("depth"), "digest", "chars", "total")
    )
    tops = known.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("chars"), "total"
    )
    return tops.unionByName(given).unionByName(own)


def prefix_paths(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, chars, total``: the node of every prefix of every conversation.

    Keys have 128 bits, independent of each other unless texts are made to collide.
    """
    own = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(salt), "depth", "digest")).otherwise(F.lit(0)) for salt in ("a", "b")]
    rows = rebuilt.withColumns({"h1": own[0], "h2": own[1], "stretch": F.shiftright("depth", STRETCH)})
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("conv_id", "stretch")
        .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        .select("conv_id", "stretch", *[F.coalesce(F.bit_xor(h).over(earlier), F.lit(0)).alias(f"before_{h}") for h in ("h1", "h2")])
    )
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keys = rows.join(before, ["conv_id", "stretch"]).select(
        "conv_id", "depth", "chars", "total", "h1", "h2",
        *[F.col(f"before_{h}").bitwiseXOR(F.bit_xor(h).over(within)).alias(f"k{h}") for h in ("h1", "h2")],
    )

    def key(first, second):
        return F.unhex(F.concat(*[F.lpad(F.hex(part), 16, "0") for part in (first, second)]))

    node = key(F.col("kh1"), F.col("kh2"))
    parent = key(F.col("kh1").bitwiseXOR(F.col("h1")), F.col("kh2").bitwiseXOR(F.col("h2")))
    return stored(keys.select("conv_id", "depth", node.alias("node"), F.when(F.col("depth") > 0, parent).alias("parent"), "chars", "total"))


def trie_nodes(paths: DataFrame) -> DataFrame:
    """``node, parent, depth, conv_id, parent_conv_id, n_convs, n_children, chars, below``, one row a node.

    ``conv_id`` is the smallest member. ``below`` is the number of turns (and conversations, at the
    root) at or below the node, counted in every conversation. Rows of a node are combined before
    they are shuffled; children of a node with very many are split by the skew join.
    """
    nodes = stored(
        paths.groupBy("node").agg(
            F.max("parent").alias("parent"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("chars").alias("chars"),
            F.sum(F.col("total") - F.col("depth") + 1).alias("below"),
        )
    )
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return stored(
        nodes.join(parents, "parent", "left")
        .join(children, "node", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    )


def small_components(
    component: np.ndarray, parent: np.ndarray, depth: np.ndarray, below: np.ndarray, values: Sequence[np.ndarray], sums: Sequence[np.ndarray]
) -> None:
    """Finish components in place: add to ``sums`` the subtree sums of ``values`` within each component.

    ``component`` is the row of a node's top, ``parent`` that of its parent or -1 for tops.
    """
    rows, top = np.arange(len(parent)), component.copy()
    parent, below, alive = parent.copy(), below.copy(), np.ones(len(parent), bool)
    while alive.any():
        half = alive & (2 * below >= below[top])
        deepest = np.full(len(rows), -1, np.int64)
        np.maximum.at(deepest, top[half], depth[half])
        centre = half & (depth == deepest[top])
        chosen = np.full(len(rows), -1, np.int64)
        chosen[top[centre]] = rows[centre]
        # Cut the centroid off from its parent and its children, and find the new tops by doubling.
        cut = centre | (centre[parent] & (parent >= 0))
        parent = np.where(cut, -1, parent)
        new = np.where(parent >= 0, parent, rows)
        while not np.array_equal(following := new[new], new):
            new = following
        under = alive & ((new != top) | centre)
        path = half & ~centre
        for value, total in zip(values, sums, strict=True):
            held = np.zeros(len(rows), np.int64)
            np.add.at(held, top[under], value[under])
            total[path | centre] += held[top[path | centre]]
        below[path] -= below[chosen[top[path]]]
        alive &= ~centre
        top = new


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: Sequence[str], most: int = MOST) -> DataFrame:
    """``node`` and the sum of each of ``values`` (longs) over the node's subtree, the node included.

    Components above ``most`` turns are split in joins, one round for each halving of the
    largest, at the same time in all of them; ``paths`` says which child of a centroid a node lies
    below. Joins on the component meet a hot key in the first rounds: its other side is one row, and the
    skew join splits it. Tables of earlier rounds are read again until the end.
    """
    # As a table, or the planner would turn joins on the one first top into products with one row.
    start = stored(
        nodes.select(
            "node", "parent", "depth", F.col("conv_id").alias("member"), "below", F.lit(ROOT).alias("top"),
            *values, *[F.lit(0).cast("bigint").alias(f"sum_{name}") for name in values],
        )
    )
    columns, finished, small = start.columns, [], []
    lookup = paths.select(F.col("conv_id").alias("member"), F.col("depth").alias("at"), F.col("node").alias("child"), F.col("parent").alias("over"))
    state = start
    while True:
        large = state.groupBy("top").agg(F.max("below").alias("weight")).where(F.col("weight") > most)
        if large.isEmpty():
            small.append(state)
            break
        small.append(state.join(large, "top", "left_anti").select(*columns))
        split = state.join(large, "top")
        half = F.col("below") * 2 >= F.col("weight")
        centres = split.where(half).groupBy("top").agg(F.max_by(F.struct("node", "depth", "below"), "depth").alias("c"))
        met = split.join(centres, "top").withColumn("at", F.when(F.col("depth") > F.col("c.depth"), F.col("c.depth") + 1))
        under = F.coalesce(F.col("over") == F.col("c.node"), F.lit(False))
        parted = stored(
            met.join(lookup, ["member", "at"], "left").select(
                *columns, "c", (under | (F.col("node") == F.col("c.node"))).alias("under"),
                (half & (F.col("depth") <= F.col("c.depth"))).alias("path"), F.when(under, F.col("child")).otherwise(F.col("top")).alias("next"),
            )
        )
        held = parted.where("under").groupBy("top").agg(*[F.sum(name).alias(f"held_{name}") for name in values])
        after = stored(
            parted.join(held, "top").select(
                "node", "parent", "depth", "member", F.when(F.col("path"), F.col("below") - F.col("c.below")).otherwise(F.col("below")).alias("below"),
                F.col("next").alias("top"), *values,
                *[(F.col(f"sum_{name}") + F.when(F.col("path"), F.col(f"held_{name}")).otherwise(0)).alias(f"sum_{name}") for name in values],
                (F.col("node") == F.col("c.node")).alias("centre"),
            )
        )
        finished.append(after.where("centre").select(*columns))
        state = after.where("not centre").select(*columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", *[f"sum_{name}" for name in values]]

        def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            keys = rows.column("node").to_pylist()
            place = {key: at for at, key in enumerate(keys)}
            top = np.array([place[key] for key in rows.column("top").to_pylist()], np.int64)
            parent = np.array([place.get(key, -1) for key in rows.column("parent").to_pylist()], np.int64)
            parent[top == np.arange(len(keys))] = -1
            numbers = {name: rows.column(name).to_numpy().astype(np.int64) for name in rows.column_names if name not in ("node", "parent", "top")}
            sums = [numbers[f"sum_{name}"] for name in values]
            small_components(top, parent, numbers["depth"], numbers["below"], [numbers[name] for name in values], sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array(x) for x in sums]], names)

        held, size = [], 0
        for batch in batches:
            if size >= most and batch.num_rows:
                # Components come one after the other; flush before the last one that is still open.
                rows = pa.Table.from_batches(held).combine_chunks()
                tops = rows.column("top").to_pylist()
                end = next((at for at in range(len(tops), 0, -1) if tops[at - 1] != tops[-1]), 0)
                if end:
                    yield from solved(rows.slice(0, end).to_batches())
                    held = rows.slice(end).to_batches()
                    size = len(tops) - end
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from solved(held)

    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    schema = "node binary, " + ", ".join(f"sum_{name} long" for name in values)
    sums = (
        rest.drop("member").repartition("top").sortWithinPartitions("top").mapInArrow(finish, schema)
    )
    for more in finished:
        sums = sums.unionByName(more.select("node", *[f"sum_{name}" for name in values]))
    return sums


def member_digests(paths: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of nodes where conversations end: of their ids, ascending, joined by commas.

    Ids are joined within stretches first. A digest is sequential, so a node's stretches are streamed
    through one task in order, but a row stands for up to 4,096 ids and none are kept.
    """
    joined = (
        paths.where("depth = total")
        .groupBy("node", F.shiftright("conv_id", STRETCH).alias("stretch"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            nodes, digests = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    nodes.append(last)
                    digests.append(state.hexdigest())
                last, state = node, sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    streamed = joined.repartition("node").sortWithinPartitions("node", "stretch")
    return streamed.select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, block: int = 100, most: int = MOST) -> DataFrame:
    """One row a node of the trie of rebuilt conversations, see :func:`rebuilt_turns`.

    ``node, parent``: keys. ``conv_id, parent_conv_id``: smallest members. ``depth, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``. Null role or text counts as empty, null turns come first,
    equal turns are ordered by a digest of role and text and repeated rows are turns of their own.
    Rows with a null ``conv_id`` are left out. Texts are hashed whole where they are read and travel no further.
    An empty table has no conversation and so no node, not even a root. Other columns are not read.
    """
    paths = prefix_paths(rebuilt_turns(turns, block))
    nodes = trie_nodes(paths).withColumns(
        {
            "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"),
            "saved": (F.col("n_convs") - 1) * F.col("chars"),
        }
    )
    return (
        nodes.join(subtree_sums(nodes, paths, ["leaves", "saved"], most), "node")
        .join(member_digests(paths), "node", "left")
        .select(
            "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM (
    SELECT conv_id, n, list_reduce(
      list_prepend(4294967295::BIGINT, [ascii(s[i])::BIGINT for i in range(1, length(s) + 1)]),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
    FROM (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS s FROM t GROUP BY conv_id))),
c AS (SELECT i.*, least(i.h, coalesce(b.n, 0)) AS given FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
r AS (
  SELECT c.conv_id, 0 AS depth, '' AS turn, 0 AS chars FROM c
  UNION ALL SELECT c.conv_id, t.pos, md5(t.role || '|' || md5(t.text)), length(t.text) FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.given
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.given, md5(t.role || '|' || md5(t.text)), length(t.text) FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (
  SELECT conv_id, depth, chars, string_agg(turn, ' ') OVER w AS node, max(depth) OVER (PARTITION BY conv_id) AS total FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total), '') AS ends
  FROM p GROUP BY node, depth),
e AS (
  SELECT n.*, up.node AS parent, up.conv_id AS parent_conv_id FROM n
  LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n up ON up.node = p.node AND up.depth = p.depth),
k AS (SELECT parent, count(*) AS n_children FROM e WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT e.*, coalesce(k.n_children, 0) AS n_children FROM e LEFT JOIN k ON k.parent = e.node),
s AS (
  SELECT p.node, p.depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node, p.depth)
SELECT f.conv_id::BIGINT AS conv_id, f.depth::BIGINT AS depth, f.parent_conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
  f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.node = f.node AND s.depth = f.depth
"""


@query("op12_trie", _TRIE_SQL)
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")

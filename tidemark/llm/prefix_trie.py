"""Prefix trie of conversations: ternary search trees over turn ids, one per range shard, merged at the shards' edges.

A turn is named by a dictionary: equal (role, text) have one id. Every conversation is rebuilt as a sequence of ids, and the
sequences, sorted with their conv_ids, are cut into shards of `SHARD` turns. Sorting keeps conversations with a common prefix
together, so a trie node lies in one shard unless it is a prefix of the shard's first or last sequence. A shard inserts its sequences into a
ternary search tree, the middle one first, then the middles of what is left on both sides, which keeps the binary searches
among siblings balanced. One pass over the nodes from the last made to the first, without recursion, adds up members, leaves and
savings. Nodes inside the shard are final; the nodes on its first and last path, the boundary, are merged by key (a digest of
the prefix) with those of other shards: members add up, and what lies under a boundary node is the sum of what its shards
found plus the merged boundary nodes below it, each counted in the first shard that has it.

Nothing is keyed by a prefix alone but the boundary, some dozen rows a shard, so a first turn or a whole conversation that a third of all
rows share costs no more than others. The ids of members that end at a shared node are hashed by a task that streams one string a shard.

Defined cases: turns are taken by `turn`, NULL first, ties by the SHA-256 of role and text; NULL role or text counts as empty;
rows without a conv_id take no part; a rebuilt conversation may have no turn and then ends at the root; other columns are left
out; an empty table gives an empty result. A conversation is one row, of some 16 bytes a turn, while it is rebuilt and inserted.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Turns in a shard; a partition with more is cut into several shards.
SHARD = 1 << 14
#: Conversations of one family share their first turns, at most `MOST_HEAD` - 1.
FAMILY, MOST_HEAD = 5, 9
#: A turn with more than this share of all rows is looked up in a broadcast dictionary of at most `1 / HOT` rows.
HOT = 0.001
ROOT = bytes(16)
NODES = (
    "edge boolean, shard bigint, side string, depth bigint, key binary, above binary, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends string"
)
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of (role, text), size (bytes of the text) of every row with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.sha2(named.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("size"))


def encoded(rows: DataFrame) -> DataFrame:
    """`rows` (staged) with id, the number of their digest in the dictionary."""
    counts = rows.groupBy("digest").agg(F.count("*").alias("n"))
    dictionary = staged(counts.withColumn("id", F.monotonically_increasing_id()))
    often = dictionary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * HOT
    hot = F.broadcast(dictionary.where(F.col("n") > often).select("digest", "id"))
    met = rows.join(hot, "digest", "left")
    rest = met.where("id IS NULL").drop("id").join(dictionary.where(F.col("n") <= often).select("digest", "id"), "digest")
    return met.where("id IS NOT NULL").unionByName(rest)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and sizes of every rebuilt conversation: the family's first turns, then its own after as many."""
    rows = encoded(staged(turns(conversations))).withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    own = (
        rows.repartition("family").groupBy("family", "conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "size"))).alias("all"))
        .select("family", "conv_id", F.transform("all", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("own"))
    )
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, MOST_HEAD - 1))).over(Window.partitionBy("family"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")
    nothing = F.slice("own", 1, 0)
    both = own.withColumns({"head": F.coalesce(head, nothing), "h": taken}).select("conv_id", F.concat(
        F.slice("head", F.lit(1), F.col("h")),
        F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))),
    ).alias("all"))
    return both.select("conv_id", F.col("all.id").alias("ids"), F.col("all.size").alias("sizes"))


class Trie:
    """A ternary search tree: `low` and `high` lead to siblings, `child` to the tree of the next turn's ids. Node 0 is the root."""

    def __init__(self) -> None:
        self.id, self.low, self.high, self.child, self.up, self.depth, self.size = (array("q") for _ in range(7))
        self.new(0, 0, -1, 0)

    def new(self, turn: int, size: int, up: int, depth: int) -> int:
        for column, value in zip(
            (self.id, self.low, self.high, self.child, self.up, self.depth, self.size), (turn, -1, -1, -1, up, depth, size), strict=True
        ):
            column.append(value)
        return len(self.id) - 1

    def path(self, ids: list[int], sizes: list[int]) -> array:
        """The nodes of a sequence, root first; those that are missing are made."""
        known, low, high, child = self.id, self.low, self.high, self.child
        node, path = 0, array("q", [0])
        for turn, size in zip(ids, sizes, strict=True):
            links, at, here = child, node, child[node]
            while here >= 0 and known[here] != turn:
                links = low if turn < known[here] else high
                at, here = here, links[here]
            if here < 0:
                here = links[at] = self.new(turn, size, node, len(path))
            node = here
            path.append(node)
        return path


def middles(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle first, then the middles of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        fresh = []
        for low, high in spans:
            if low < high:
                middle = (low + high) // 2
                yield middle
                fresh += [(low, middle), (middle + 1, high)]
        spans = fresh


def shard_nodes(shard: int, found: list[tuple[list[int], list[int], list[int]]]) -> pa.RecordBatch:
    """The nodes of a shard's distinct sequences (ids, sizes, ascending conv_ids), which are sorted."""
    trie, ends = Trie(), {}
    paths = {}
    for i in middles(len(found)):
        ids, sizes, convs = found[i]
        path = trie.path(ids, sizes)
        ends[path[-1]] = convs
        if i in (0, len(found) - 1):
            paths[i] = path
    n = len(trie.id)
    members, children, leaves, saved = (array("q", bytes(8 * n)) for _ in range(4))
    first = array("q", [2**63 - 1]) * n
    for node, convs in ends.items():
        members[node], first[node] = len(convs), convs[0]
    side, key = {}, {}
    for i, name in ((0, "first"), (len(found) - 1, "last")):
        digest = ROOT
        for node in paths[i]:
            if node:
                digest = hashlib.blake2b(digest + trie.id[node].to_bytes(8, "little", signed=True), digest_size=16).digest()
            side[node] = "both" if side.get(node, name) != name or len(found) == 1 else name
            key[node] = digest
    for node in range(n - 1, -1, -1):  # a node is made after its parent
        up = trie.up[node]
        if node not in side:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * trie.size[node]
        if up >= 0:
            members[up] += members[node]
            first[up] = min(first[up], first[node])
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            children[up] += node not in side
    columns = []
    for node in range(n):
        up, edge = trie.up[node], node in side
        listed = ",".join(map(str, ends[node])) if node in ends else ""
        columns.append((
            edge, shard, side.get(node), trie.depth[node], key.get(node), key.get(up), first[node],
            None if up in side or up < 0 else first[up], members[node], children[node], leaves[node], saved[node], trie.size[node],
            listed if edge else hashlib.sha256(listed.encode()).hexdigest(),
        ))
    kinds = [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    names = [c.strip().split(" ")[0] for c in NODES.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns, strict=True), kinds, strict=True)], names=names)


def sharded(limit: int):
    """A function that gives the nodes of a partition of sorted sequences (ids, sizes, conv_id), shard by shard of `limit` turns or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, found = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for ids, sizes, conv_id in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                again = bool(found) and found[-1][0] == ids
                if again and len(found[-1][2]) < limit:
                    found[-1][2].append(conv_id)
                    continue
                if found and (again or held + len(ids) > 2 * limit):
                    yield shard_nodes(shard, found)
                    shard, held, found = shard + 1, 0, []
                found.append((ids, sizes, [conv_id]))
                held += len(ids) + 1
        if found:
            yield shard_nodes(shard, found)

    return run


def hashed_ends(edge: DataFrame) -> DataFrame:
    """key and ends_sha256 of the boundary nodes at which members end; a task streams the lists of a node, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done = []
            for key, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(listed.encode())
                else:
                    digest.update(b"," + listed.encode())
            yield packed(done)
        if last is not None:
            yield packed([(last, digest.hexdigest())])

    def packed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])

    lists = edge.where("ends <> ''").select("key", "ends", "shard")
    return lists.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(run, "key binary, ends_sha256 string")


def merged(edge: DataFrame) -> DataFrame:
    """The boundary nodes of all shards, one row per key, with their totals; `edge` is read several times."""
    totals = edge.groupBy("key").agg(
        F.min("above").alias("above"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("inner_leaves"), F.sum("saved_tokens").alias("inner_saved"),
        F.max("size").alias("size"), F.min("shard").alias("first_shard"))
    below = totals.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("outer"))
    nodes = staged(totals.join(below, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0))))
    own = nodes.select(
        "key", "first_shard", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("cost"))
    placed = edge.select("shard", "side", "depth", "key").join(own, "key")
    mine = {c: F.when(F.col("shard") == F.col("first_shard"), F.col(c)).otherwise(0) for c in ("leaf", "cost")}
    placed = placed.withColumns(mine)
    path = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    apart = Window.partitionBy("shard")

    def under(c: str):  # a node on both paths has both their ends under it
        ends = F.sum(F.when(F.col("side") != "both", F.col(c)).otherwise(0)).over(apart)
        return F.sum(c).over(path) + F.when(F.col("side") == "both", ends).otherwise(0)

    sums = placed.select("key", under("leaf").alias("leaf"), under("cost").alias("cost")).groupBy("key").agg(
        F.sum("leaf").alias("leaf"), F.sum("cost").alias("cost"))
    return nodes.join(sums, "key").join(hashed_ends(edge), "key", "left").select(
        "key", "above", "conv_id", "depth", "n_convs", "n_children", (F.col("inner_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("inner_saved") + F.col("cost")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    sequences = staged(rebuilt(conversations))
    held = sequences.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    ranged = sequences.select("ids", "sizes", "conv_id").repartitionByRange(max(1, -(-held // shard)), "ids", "conv_id")
    nodes = staged(ranged.sortWithinPartitions("ids", "conv_id").mapInArrow(sharded(shard), NODES))
    edge = nodes.where("edge")
    shared = staged(merged(edge))
    parents = shared.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    values = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    outer = shared.join(parents, "above", "left").select(*values)
    # nodes right under the boundary find their parent among their own shard's boundary rows
    inner = nodes.where("NOT edge").withColumnRenamed("ends", "ends_sha256")
    above = edge.select("shard", F.col("key").alias("above")).join(parents, "above")
    under = inner.where("above IS NOT NULL").drop("parent_conv_id").join(above, ["shard", "above"]).select(*values)
    return outer.unionByName(under).unionByName(inner.where("above IS NULL").select(*values))


SQL = """
    WITH t AS (SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT c, turn, sha256(strlen(r) || ':' || r || x) AS k, strlen(x)::BIGINT AS b FROM t),
    o AS (SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM k),
    bits AS (SELECT c, c - c % 5 AS f, n, c::VARCHAR AS s FROM (SELECT c, count(*) AS n FROM o GROUP BY c)),
    convs AS (SELECT c, f, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(8 * length(s)),
            lambda i: (ascii(s[i // 8 + 1]) >> (i % 8)::INT)::BIGINT & 1),
        lambda a, bit: xor(a >> 1, 3988292384 * (xor(a, bit) & 1))), 4294967295) % 9 AS h FROM bits),
    heads AS (SELECT v.c, v.h, v.n, coalesce(least(v.h, w.n), 0) AS taken, v.f FROM convs v LEFT JOIN convs w ON w.c = v.f),
    turns AS (SELECT v.c, o.pos AS d, o.k, o.b FROM heads v JOIN o ON o.c = v.f AND o.pos <= v.h
        UNION ALL SELECT v.c, o.pos - v.h + v.taken, o.k, o.b FROM heads v JOIN o ON o.c = v.c AND o.pos > v.h),
    paths AS (SELECT c, 0 AS d, '' AS node, 0 AS b FROM heads UNION ALL
        SELECT c, d, sha256(array_to_string(list(k) OVER (PARTITION BY c ORDER BY d), ' ')), b FROM turns),
    last AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
    nodes AS (SELECT node, min(c) AS c, min(d) AS d, count(*) AS n, min(b) AS b FROM paths GROUP BY node),
    kids AS (SELECT p.node, count(*) AS kids FROM nodes v JOIN paths p ON p.c = v.c AND p.d = v.d - 1 GROUP BY p.node),
    named AS (SELECT v.*, coalesce(kids, 0) AS kids FROM nodes v LEFT JOIN kids ON kids.node = v.node),
    sums AS (SELECT p.node, count(*) FILTER (v.kids = 0) AS leaves, sum((v.n - 1) * v.b) AS saved
        FROM named v JOIN paths p ON p.c = v.c AND p.d <= v.d GROUP BY p.node),
    ends AS (SELECT p.node, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS ends
        FROM paths p JOIN last l ON l.c = p.c AND l.d = p.d GROUP BY p.node)
    SELECT v.c AS conv_id, v.d::BIGINT AS depth, u.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, s.leaves AS n_leaves,
        s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
    FROM named v JOIN sums s ON s.node = v.node LEFT JOIN ends e ON e.node = v.node
    LEFT JOIN paths p ON p.c = v.c AND p.d = v.d - 1 LEFT JOIN nodes u ON u.node = p.node"""

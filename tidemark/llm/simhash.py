"""SimHash near-duplicates with BK-trees.

A fingerprint has 64 bits of a text's word shingles. Distinct fingerprints go into shards: the 64 bits are cut into blocks,
and two fingerprints that differ in at most `radius` bits agree in all but `radius` of the blocks, so every linked pair
meets in a shard named by some choice of agreeing blocks. The number of blocks follows the number of fingerprints, so that
a shard stays small; no choice loses a pair. A shard that is crowded all the same is cut into chunks, and every pair of
its chunks becomes a cell of its own.

Each shard (or cell) holds a BK-tree: a node's children are keyed by their Hamming distance to it, and a search at
distance d from a node follows only the edges d - radius to d + radius. All trees of a batch of shards are built and
searched at once, level by level, in numpy arrays. Links met while a tree is built already join its fingerprints, and a search
leaves out subtrees that are wholly in the searcher's own component: groups of many near copies are not paired out.
A shard emits one link per fingerprint at most; components are joined by alternating large and small stars, each
round a written table.

`one_of_each` keeps a row of each component. Near fingerprints do not make texts similar, and small edits move more than the
radius's bits, so `one_of_similar` drops a row only if whole sets of shingles join it to one that stays: it compares what near
fingerprints join, then looks among the rows that are left in shards named by smallest shingles, with a BK-tree of wide radius each.

The trees go to the searches by hash partitioning, not as one broadcast variable: together they are as large as the corpus.

Defined cases: a text without words (NULL, empty, blank) has fingerprint 0 and is linked like any other; rows of one doc_id
each keep their fingerprint; a NULL doc_id is never a component's name (NULL if nothing else is in the component);
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged, through_arrow
from tidemark.llm.hashing import mixed

BITS = 64
#: Fingerprints a shard should hold on average, at most; the number of blocks is chosen by it.
SHARD = 1024
#: A shard with more is cut into cells of two chunks of this size.
CELL = 4096
#: Fingerprints whose trees are built and searched at once in a task.
FOREST = 1 << 16
#: Shingles hashed at once.
STEP = 1 << 16
#: Shards of similar texts: bands a text is in, and smallest shingles that name one.
BANDS, ROWS = 20, 5
#: A shard of similar texts with more is cut into cells of two chunks of this size.
PAIRED = 256
#: Radius of the trees in a shard of similar texts: fingerprints of sets of 0.8 are further apart once in 900,000 pairs at most.
WIDE = 28
#: Column with the number of a row.
ROW = "simhash_row"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashed(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of a text, in order, repeats included, some at a time."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(words) - width + 1)].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        pairs = zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in pairs], "<u8")


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bits set in over half of the shingles' hashes; shingles are `width` words, or all words if fewer."""
    return majority(hashed(text, width))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingles' hashes."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a long (two's complement)."""

    def start():
        def compute(texts: pa.Array) -> list[pa.Array]:
            values = np.array([fingerprint(t, width) for t in texts.to_pylist()], np.uint64)
            return [pa.array(values.view(np.int64))]

        return compute

    return through_arrow(docs, ["doc_id"], "fp bigint", start)


def n_blocks(n: int, radius: int) -> int:
    """The fewest blocks that leave about SHARD fingerprints in a shard."""
    blocks = radius + 1
    while n >> (BITS * (blocks - radius) // blocks) > SHARD and blocks < 2 * radius + 4:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of blocks that must agree."""
    limits = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << limits[i + 1]) - (1 << limits[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


class Forest:
    """The BK-trees of many shards. `shard` is sorted; fingerprints of a shard are distinct.

    With `join` off, links do not join fingerprints while a tree is built, and a search finds every one.
    """

    def __init__(self, shard: np.ndarray, fps: np.ndarray, radius: int, join: bool = True):
        self.fps, self.radius, n = fps, radius, len(fps)
        group = np.concatenate([[0], np.cumsum(shard[1:] != shard[:-1])]) if n else np.zeros(0, np.int64)
        self.root = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else group
        self.root_of = self.root[group] if n else group
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        met_a, met_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        items = np.arange(n)
        while len(items):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            node = items[first][np.cumsum(first) - 1]  # the first item of a group is its node
            self.levels.append(items[first])
            rest = ~first
            items, node = items[rest], node[rest]
            d = np.bitwise_count(fps[items] ^ fps[node]).astype(np.int64)
            near = (d <= radius) & join
            met_a.append(items[near])
            met_b.append(node[near])
            self.parent[items], self.edge[items] = node, d
            order = np.lexsort((items, d, node))
            items, group = items[order], (node * (BITS + 1) + d)[order]
        self.children = np.lexsort((self.edge, self.parent))
        self.children = self.children[self.parent[self.children] >= 0]
        self.keys = self.parent[self.children] * (BITS + 1) + self.edge[self.children]
        self.label = joined(n, np.concatenate(met_a), np.concatenate(met_b))
        self.whole = self.label.copy()  # the component of a node's whole subtree, or -1
        for level in reversed(self.levels[1:]):
            up = self.parent[level]
            self.whole[up[self.whole[level] != self.whole[up]]] = -1
            # a parent marked by one child stays marked: -1 never equals a child's component

    def links(self, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius, in two components as far as building the trees has joined them."""
        todo = [(at, self.root_of[at]) for at in np.array_split(np.arange(len(self.fps)), max(1, len(self.fps) // block + 1))]
        while todo:
            seeker, node = todo.pop()
            open_ = self.whole[node] != self.label[seeker]
            seeker, node = seeker[open_], node[open_]
            if not len(seeker):
                continue
            d = np.bitwise_count(self.fps[seeker] ^ self.fps[node]).astype(np.int64)
            near = (d <= self.radius) & (self.label[seeker] != self.label[node])
            if near.any():
                yield seeker[near], node[near]
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(d - self.radius, 0), "left")
            high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + self.radius, BITS), "right")
            n = high - low
            seeker = np.repeat(seeker, n)
            child = self.children[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(seeker))]
            for at in range(0, len(seeker), block):
                todo.append((seeker[at : at + block], child[at : at + block]))

    def components(self) -> np.ndarray:
        found = [(np.arange(len(self.fps)), self.label), *self.links()]
        return joined(len(self.fps), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, for links a - b among 0 .. n - 1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:  # follow to the root
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (before == label).all():
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def celled(keyed: DataFrame, member: str, size: int) -> DataFrame:
    """`keyed` with the column cell instead of shard: a shard of over `size` rows becomes a cell for each two of its chunks."""
    crowded = (
        keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > size)
        .select("shard", F.ceil(F.col("n") / size).cast("int").alias("chunks"))
    )
    mine = F.pmod(F.xxhash64(member), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != mine)
    cells = F.when(F.col("chunks").isNull(), F.array(F.col("shard"))).otherwise(
        F.transform(others, lambda k: F.xxhash64("shard", F.least(k, mine), F.greatest(k, mine)))
    )
    kept = [c for c in keyed.columns if c != "shard"]
    return keyed.join(crowded, "shard", "left").select(*kept, F.explode(cells).alias("cell"))


def shard_links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between distinct fingerprints of `fps` (column fp) that join all that are within the radius."""
    n = fps.count()
    chosen = masks(n_blocks(n, radius), radius)
    keyed = fps.select("fp", F.explode(F.array([
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(chosen)
    ])).alias("shard"))
    dealt = celled(keyed, "fp", CELL)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if len(cell) >= FOREST:
                cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
                if cut:
                    yield found(cell[:cut], fp[:cut])
                    cell, fp = cell[cut:], fp[cut:]
        if len(cell):
            yield found(cell, fp)

    def found(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label = Forest(cell, fp.view(np.uint64), radius).components()
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["a", "b"])

    tasks = max(1, n * len(chosen) // FOREST)
    return dealt.select("cell", "fp").repartition(tasks, "cell").sortWithinPartitions("cell", "fp").mapInArrow(search, "a bigint, b bigint")


def star_forest(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link that is not its component's smallest one."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        middle = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
        if middle.limit(1).count() == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())


def rooted(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, first_id, root): the smallest doc_id of each distinct fingerprint of (doc_id, fp) and its component's root."""
    fps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    stars = star_forest(shard_links(fps.select("fp"), radius))
    return fps.join(stars, fps.fp == stars.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component_id): the smallest doc_id that can be reached from each distinct fingerprint of (doc_id, fp)."""
    found = rooted(prints, radius)
    named = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return found.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = staged(fingerprints(docs, width))
    found = prints.join(components(prints, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 5) -> DataFrame:
    """The rows of `docs`, whole, one of each component: the one with the smallest doc_id, NULL last, then of the smallest text.

    Components are told apart by their root fingerprint and rows by their own number, so repeated or missing doc_ids lose none.
    """
    rows = staged(docs.withColumn(ROW, F.monotonically_increasing_id()))
    prints = staged(fingerprints(rows.select(F.col(ROW).alias("doc_id"), "text"), width))
    order = rows.select(ROW, F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"), ROW
    ).alias("order"))
    placed = prints.withColumnRenamed("doc_id", ROW).join(rooted(prints, radius).select("fp", "root"), "fp").join(order, ROW)
    kept = placed.groupBy("root").agg(F.min("order").alias("order")).select(f"order.{ROW}")
    return rows.join(kept.hint("shuffle_hash"), ROW, "left_semi").select(*docs.columns)


class Sketcher:
    """Names of the shards a text is in: hashes of `ROWS` smallest shingles each, by `BANDS` x `ROWS` orders; one per task."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.flips = rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
        self.factors = rng.integers(0, 2**62, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
        for at in range(0, len(grams), 256):  # a block of all orders stays in the processor's cache
            least = np.minimum(least, ((grams[None, at : at + 256] ^ self.flips) * self.factors).min(1))
        names = np.zeros(BANDS, np.uint64)
        for row in range(ROWS):
            names = mixed(names * np.uint64(0x9E3779B97F4A7C15) + least[row::ROWS])
        return names.view(np.int64)


def gram_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    parts = list(hashed(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sketched(docs: DataFrame, key: str, width: int) -> DataFrame:
    """`key`, fp, digest (16 bytes) and bands of every row's set of shingles; repeats in a text do not count."""

    def sketch():
        import xxhash

        sketcher = Sketcher()

        def compute(texts: pa.Array) -> list[pa.Array]:
            fps, digests, names = np.zeros(len(texts), np.uint64), [], []
            for i, text in enumerate(texts):
                grams = gram_set(text.as_py(), width)
                fps[i] = majority([grams[at : at + STEP] for at in range(0, len(grams), STEP)])
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                names.append(sketcher.bands(grams) if len(grams) else [])
            return [pa.array(fps.view(np.int64)), pa.array(digests, pa.binary()), pa.array(names, pa.list_(pa.int64()))]

        return compute

    return through_arrow(docs, [key], "fp bigint, digest binary, bands array<bigint>", sketch)


def similar_links(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = WIDE) -> DataFrame:
    """(a, b) links between doc_ids of `docs` that join all whose sets of shingles have a Jaccard similarity of `least` or more.

    Texts this similar are some 10 bits apart, so blocks of bits cannot name shards. Shards are named by smallest shingles
    instead. In a shard a BK-tree finds the fingerprints within the radius, and every link found is checked on the whole sets
    of shingles. Of shards with the same members one is searched. Only documents that share a shard are read again. doc_id
    tells rows apart; a row without one, or without words, takes no part.

    What a pair may be missed by, whose similarity is just 0.8 (far less above), if no third text joins it:
    - 20 bands of 5: (1 - 0.8^5)^20, one pair in 2,800;
    - radius 28: a bit of two fingerprints over distinct shingles differs with a chance of arccos(8/9) / pi = 0.151 in long
      texts and of 0.1875 at most (4 of 5 shingles), so over 28 of 64 do in one pair in 10^8, one in 900,000 at most.
    """
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("key"), "text")
    sketches = staged(sketched(known, "key", width).withColumn("node", F.col("key")))
    return checked_links(known, band_cells(sketches), least, width, radius)


def band_cells(sketches: DataFrame) -> DataFrame:
    """(key, node, fp, cell) of rows (key, node, fp, bands) that share a band."""
    named = sketches.select("key", "node", "fp", F.posexplode("bands").alias("band", "name"))
    named = named.select("key", "node", "fp", F.xxhash64("band", "name").alias("shard"))
    members = named.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    searched = members.groupBy("n", "who").agg(F.min("shard").alias("shard")).select("shard")
    return celled(named.join(searched, "shard", "left_semi"), "node", PAIRED)


def near_cells(sketches: DataFrame, radius: int) -> DataFrame:
    """(key, node, fp, cell) of rows (key, node, fp) whose fingerprints are joined within `radius`.

    A large component is cut into chunks, and its first node is in each: rows grow with the members, not with their pairs.
    """
    stars = staged(star_forest(shard_links(sketches.select("fp").distinct(), radius)))
    rooted = staged(sketches.select("key", "node", "fp").join(stars, sketches.fp == stars.node, "left").select(
        "key", sketches.node, "fp", F.coalesce("root", "fp").alias("root")))
    crowds = rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    crowds = crowds.select("root", "first", F.ceil(F.col("n") / PAIRED).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    chunks = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(mine))
    dealt = rooted.join(crowds, "root").select("key", "node", "fp", "root", F.explode(chunks).alias("chunk"))
    return dealt.select("key", "node", "fp", F.xxhash64("root", "chunk").alias("cell"))


def checked_links(docs: DataFrame, cells: DataFrame, least: float, width: int, radius: int) -> DataFrame:
    """(a, b) links between nodes of `cells` (key, node, fp, cell) that join all of a cell whose sets of shingles are similar
    enough; `docs` (key, text) are read again for the sets."""
    dealt = staged(cells)

    def grams():
        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([gram_set(t.as_py(), width).tobytes() for t in texts], pa.binary())]

        return compute

    again = docs.join(dealt.select("key").distinct(), "key", "left_semi")
    sets = through_arrow(again, ["key"], "grams binary", grams)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            for name, *row in zip(*(batch.column(i) for i in range(4)), strict=True):
                if name.as_py() != cell:
                    yield from found(rows)
                    cell, rows = name.as_py(), []
                rows.append((row[0].as_py(), row[1].as_py(), np.frombuffer(row[2].as_py(), np.uint64)))
        yield from found(rows)

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        nodes, fps = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).view(np.uint64)
        a, b = verified(fps, [r[2] for r in rows], least, radius)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    met = dealt.join(sets.hint("shuffle_hash"), "key").select("cell", "node", "fp", "grams")
    tasks = max(1, dealt.count() // PAIRED)
    return met.repartition(tasks, "cell").sortWithinPartitions("cell", "node").mapInArrow(search, "a bigint, b bigint")


def verified(fps: np.ndarray, sets: list[np.ndarray], least: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that join all of a shard whose sets are similar enough; pairs joined already are not compared."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts, label = ends - sizes, np.arange(len(sets))
    names = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    marked, links = np.zeros(len(names), bool), []
    for a, b in Forest(np.zeros(len(fps), np.int64), fps, radius, join=False).links():
        likely = (a < b) & (np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]))
        order = np.lexsort((b[likely], a[likely]))
        a, b = a[likely][order], b[likely][order]
        for mine in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1):
            if not len(mine):
                continue
            i, others = int(a[mine[0]]), b[mine]
            others = others[label[others] != label[i]]
            if not len(others):
                continue
            own = names[starts[i] : ends[i]]
            marked[own] = True
            if len(others) < 8:
                shared = np.array([np.count_nonzero(marked[names[starts[j] : ends[j]]]) for j in others])
            else:  # one pass over all sets
                upto = np.concatenate([[0], np.cumsum(marked[names])])
                shared = upto[ends[others]] - upto[starts[others]]
            marked[own] = False
            for j in others[shared >= least * (sizes[i] + sizes[others] - shared)].tolist():
                if label[i] != label[j]:
                    links.append((i, j))
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def one_of_similar(docs: DataFrame, least: float = 0.8, radius: int = 4, width: int = 5) -> DataFrame:
    """The rows of `docs`, whole, but for those that a chain of similar texts (`least` or more) joins to a row before them.

    Rows are taken by doc_id, NULL last, then shorter texts first. Texts with the same shingles leave one row. Among the
    rest, fingerprints within `radius` only say what to compare: a row goes if whole sets of shingles join it to one that stays.
    Then the rows that are left are searched for similar texts (`checked_links` of `band_cells`), and one of each group stays.
    Rows are told apart by their own number, so a repeated or missing doc_id changes nothing but the order.
    """
    rows = staged(docs.withColumn(ROW, F.monotonically_increasing_id()))
    texts = rows.select(F.col(ROW).alias("key"), "text")
    sketches = sketched(texts, "key", width)
    named = rows.select(F.col(ROW).alias("key"), "doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    ordered = staged(named.join(sketches, "key")).orderBy(F.col("doc_id").asc_nulls_last(), "size", "h", "key")
    numbered = staged(ordered.select("key", "fp", "digest", "bands", F.monotonically_increasing_id().alias("node")))
    first = numbered.groupBy("digest").agg(F.min("node").alias("node")).select("node")
    distinct = staged(numbered.drop("digest").join(first, "node", "left_semi"))
    left = distinct
    for cells in (lambda d: near_cells(d, radius), band_cells):
        gone = star_forest(checked_links(texts, cells(left), least, width, WIDE)).select("node")
        left = staged(left.join(gone, "node", "left_anti"))
    kept = left.select(F.col("key").alias(ROW))
    return rows.join(kept.hint("shuffle_hash"), ROW, "left_semi").select(*docs.columns)

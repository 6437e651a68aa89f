"""Removal of repeated passages by a suffix sort whose comparisons go by prefix hashes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller doc_id. Suffixes are compared on prefix
polynomial hashes: the hash of any substring is a difference of two running sums, so binary search finds how far two suffixes agree in
log(length) looks, and the next byte tells their order. A mergesort by such comparisons puts equal strings side by side. Neighbours are
then compared byte by byte; if a collision of hashes misled the sort, it is done again with other hashes.

Not every suffix goes through one sort. Each string of `LENGTH` bytes has an anchor, the substring of `GRAM` bytes in it with the smallest hash, so
equal strings have equal anchors at equal places, and the strings of a document that share an anchor are one stretch of text. Texts are packed
into chunks of about `CHUNK` bytes, and then

1. every chunk names its anchors (4 bytes each) to shards by hash; the shards say which ones another chunk has as well;
2. chunks send the distinct stretches round anchors of several documents, with the smallest doc_id, to shards by anchor; a shard sorts the stretches of
   each anchor, and where they differ all their strings, and answers which ones start in a smaller document;
3. chunks take the answers, cover the bytes and hash what is left.

Copies inside a chunk send one stretch, so a passage that a third of all documents share arrives once a chunk. Anchors with over `HOT` occurrences,
such as a frequent line in many surroundings, send single strings to shards by the hash of the string, so they do not meet in one place.

Defined cases: a NULL text is empty; texts shorter than `LENGTH` keep everything; rows of one doc_id do not remove each other's
bytes; a NULL doc_id counts as larger than all others; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.hashing import Tables, mixed, raw_texts

LENGTH, GRAM = 50, 24
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Bytes hashed at once; their hashes stay in the processor's cache.
STEP = 1 << 16
#: Occurrences, over all chunks, from which an anchor's strings are dealt one by one.
HOT = 1 << 16
#: Bytes of text for each shard of anchor names, and of stretches.
NAMED, SORTED = 32 << 20, 16 << 20
#: Bytes of stretches sorted at once; the stretches of one anchor stay together.
BATCH = 1 << 19
#: Times a bucket is cut finer by its next bytes before the mergesort.
CUTS = 16
#: The first 0 to 8 bytes of a word.
FIRST = np.array([(1 << 64) - (1 << (64 - 8 * n)) for n in range(9)], np.uint64)
LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)


class Hashed:
    """Prefix polynomial hashes of some bytes."""

    def __init__(self, data: np.ndarray, tables: Tables):
        powers, self.inverses = tables.upto(len(data) + 1)
        self.data, self.sums = data, np.zeros(len(data) + 1, np.uint64)
        np.cumsum(tables.values[data] * powers[: len(data)], out=self.sums[1:])

    @cached_property
    def words(self) -> np.ndarray:
        """The eight bytes from each place on, as a number that goes by their order; zeros follow the last byte."""
        return np.ndarray(len(self.data) + 1, ">u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))

    def __call__(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.inverses[starts]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at `x` and `y` have in common, `most` at most, by binary search."""
        same = most.copy()
        seek = np.flatnonzero(self(x, most) != self(y, most))
        x, y, low, high = x[seek], y[seek], np.zeros(len(seek), np.int64), most[seek]
        while len(seek):  # low bytes agree, high bytes do not
            middle = (low + high) // 2
            agree = self(x, middle) == self(y, middle)
            low, high = np.where(agree, middle, low), np.where(agree, high, middle)
            going = high - low > 1
            if not going.all():
                same[seek[~going]] = low[~going]
                seek, x, y, low, high = seek[going], x[going], y[going], low[going], high[going]
        return same

    def after(self, x: np.ndarray, y: np.ndarray, x_length: np.ndarray, y_length: np.ndarray) -> np.ndarray:
        """1 where the suffix at x is larger than that at y, 0 where equal, -1 where smaller."""
        most = np.minimum(x_length, y_length)
        same = self.common(x, y, most)
        inside = same < most
        ends = len(self.data) - 1
        apart = self.data[np.minimum(x + same, ends)].astype(np.int64) - self.data[np.minimum(y + same, ends)]
        return np.sign(np.where(inside, apart, x_length - y_length))


def changes(values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def alike(text: Hashed, starts: np.ndarray, lengths: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): suffixes of one bucket and one hash side by side, buckets in order, and True for the first of each."""
    place = np.cumsum(changes(bucket)).astype(np.uint64)
    bits = np.uint64(len(place) and int(place[-1]).bit_length())
    whole = mixed(text(starts, lengths) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = place << (np.uint64(64) - bits) | whole >> bits
    order = np.argsort(key)
    return order, changes(key[order])


def cut_finer(text: Hashed, starts: np.ndarray, lengths: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes by bucket, those of a bucket of several by the bytes that follow what all of it has in common, and so on.

    `new` is True where one is known to differ from the one before it. Up to `CUTS` times; pairs are left to the mergesort.
    """
    order, new = np.arange(len(starts)), changes(bucket)
    for _ in range(CUTS):
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(order)))
        heads, sizes = heads[sizes > 2], sizes[sizes > 2]
        if not len(heads):
            break
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(heads - begin, sizes) + np.arange(int(sizes.sum()))
        item, first = order[at], np.repeat(order[heads], sizes)
        same = text.common(starts[first], starts[item], np.minimum(lengths[first], lengths[item]))
        same = np.repeat(np.minimum.reduceat(same, begin), sizes)
        wide = (61 - len(heads).bit_length()) // 8  # bytes that fit beside the bucket and their number
        left = np.minimum(lengths[item] - same, wide)
        word = text.words[starts[item] + same].astype(np.uint64) & FIRST[left]
        key = np.repeat(np.arange(len(heads)), sizes).astype(np.uint64) << np.uint64(8 * wide + 3)
        key |= word >> np.uint64(64 - 8 * wide) << np.uint64(3) | left.astype(np.uint64)
        by = np.argsort(key)
        order[at] = item[by]
        new[at] |= changes(key[by])
    return order, new


def merged_order(text: Hashed, starts: np.ndarray, lengths: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The suffixes in order inside each bucket (`bucket` ascends): a mergesort of what the next bytes leave together, all runs of one width in one pass."""
    n = len(starts)
    order, new = cut_finer(text, starts, lengths, bucket)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    first, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    width = 1
    while n and width < sizes.max():
        at = np.flatnonzero(size > width)
        place = at - first[at]
        run, left = place // width, place // width % 2 == 0
        end = first[at] + size[at]
        other = first[at] + np.where(left, run + 1, run - 1) * width
        low, high = np.minimum(other, end), np.minimum(other + width, end)
        other = low.copy()
        item = order[at]
        seek = np.flatnonzero(low < high)
        while len(seek):  # how many of the other run go before
            middle = (low[seek] + high[seek]) // 2
            rival = order[middle]
            order_of = text.after(starts[item[seek]], starts[rival], lengths[item[seek]], lengths[rival])
            passed = np.where(left[seek], order_of > 0, order_of >= 0)
            low[seek[passed]], high[seek[~passed]] = middle[passed] + 1, middle[~passed]
            seek = seek[low[seek] < high[seek]]
        fresh = order.copy()
        fresh[first[at] + run // 2 * 2 * width + place % width + low - other] = item
        order, width = fresh, 2 * width
    return order


@lru_cache(maxsize=2)
def tables_of(seed: int) -> Tables:
    return Tables(seed)


def suffix_sorted(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes in order inside each bucket, and True where one differs from the one before it. Bytes confirm both."""
    for seed in range(17, 1017):
        text = Hashed(data, tables_of(seed))
        order, new = alike(text, starts, lengths, bucket)
        heads = np.flatnonzero(new)
        sizes, firsts = np.diff(np.append(heads, len(order))), order[heads]
        by = merged_order(text, starts[firsts], lengths[firsts], bucket[firsts])
        order = order[np.repeat(heads[by] - (np.cumsum(sizes[by]) - sizes[by]), sizes[by]) + np.arange(len(order))]
        x, y = order[:-1], order[1:]
        near = bucket[x] == bucket[y]
        x, y = x[near], y[near]
        most = np.minimum(lengths[x], lengths[y])
        same = text.common(starts[x], starts[y], most)
        if all(confirmed(text, starts[x[at : at + STEP]], starts[y[at : at + STEP]], lengths[x[at : at + STEP]], lengths[y[at : at + STEP]],
                         same[at : at + STEP]) for at in range(0, len(x), STEP)):
            new = np.ones(len(order), bool)
            new[1:][near] = (same < most) | (lengths[x] != lengths[y])
            return order, new
    raise RuntimeError("hashes collide for every seed")


def confirmed(text: Hashed, x: np.ndarray, y: np.ndarray, x_length: np.ndarray, y_length: np.ndarray, same: np.ndarray) -> bool:
    """Whether the suffixes at x and y have just `same` bytes in common and x is not the larger one."""
    on = np.flatnonzero(same > 0)
    for i in range(0, int(same.max(initial=0)), 8):
        on = on[same[on] > i]
        if ((text.words[x[on] + i] ^ text.words[y[on] + i]).astype(np.uint64) & FIRST[np.minimum(same[on] - i, 8)]).any():
            return False
    inside = same < np.minimum(x_length, y_length)
    return bool((text.data[(x + same)[inside]] < text.data[(y + same)[inside]]).all() and (x_length <= y_length)[~inside].all())


def least_docs(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, offsets: np.ndarray, counts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each string of each stretch, one after the other, the smallest doc_id among equal strings.

    A stretch has `counts` strings; its anchor is `offsets` after its start. Stretches of one anchor are one bucket (ascending).
    """
    order, new = suffix_sorted(data, starts, counts + (length - 1), bucket)
    label = np.empty(len(order), np.int64)
    label[order] = np.cumsum(new) - 1
    rep = order[new]  # the first of each class of equal stretches
    least = np.full(len(rep), LAST, np.int64)
    np.minimum.at(least, label, docs)
    several = np.bincount(bucket[rep], minlength=int(bucket[-1]) + 1 if len(bucket) else 0)[bucket[rep]] > 1
    ends = np.cumsum(counts[rep])
    found = np.repeat(least, counts[rep])
    item = np.repeat(np.arange(len(rep)), counts[rep])
    j = np.arange(len(item)) - np.repeat(ends - counts[rep], counts[rep])
    item_on = np.flatnonzero(several[item])  # strings of anchors with different stretches
    if len(item_on):
        c, k = item[item_on], j[item_on]
        place = offsets[rep][c] - k  # of the anchor in the string
        by = np.lexsort((place, bucket[rep][c]))
        item_on, c, k, place = item_on[by], c[by], k[by], place[by]
        group = np.cumsum(np.concatenate([[False], (bucket[rep][c][1:] != bucket[rep][c][:-1]) | (place[1:] != place[:-1])]))
        inner, fresh = suffix_sorted(data, starts[rep][c] + k, np.full(len(c), length), group)
        heads = np.flatnonzero(fresh)
        value = np.minimum.reduceat(found[item_on[inner]], heads)
        found[item_on[inner]] = np.repeat(value, np.diff(np.append(heads, len(inner))))
    begin = (ends - counts[rep])[label]
    return found[np.repeat(begin, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)]


class Rules:
    """The lengths everything depends on."""

    def __init__(self, length: int, gram: int, hot: int, names: int, sorts: int):
        self.length, self.gram, self.hot, self.names, self.sorts = length, gram, hot, names, sorts


class Survey:
    """The stretches of a chunk and the names of their anchors."""

    def __init__(self, data: bytes, lengths: list[int], rules: Rules, tables: Tables):
        self.rules, self.raw = rules, data
        self.data, self.limits = np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
        parts = [self.part(at, tables) for at in range(0, max(0, len(self.data) - rules.length + 1), STEP)]
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        self.low, self.count, self.at, gram = joined
        name = (gram >> np.uint64(32)) % np.uint64(rules.names) << np.uint64(32) | gram & np.uint64(0xFFFFFFFF)
        self.names, self.name, self.n = np.unique(name, return_inverse=True, return_counts=True)
        self.doc = np.searchsorted(self.limits, self.low, side="right") - 1

    def part(self, begin: int, tables: Tables) -> tuple[np.ndarray, ...]:
        """low, count, at, gram of the stretches whose strings start in `begin` .. `begin` + STEP."""
        length, gram = self.rules.length, self.rules.gram
        data = self.data[begin : begin + STEP + length - 1]
        text = Hashed(data, tables)
        n = len(data) - gram + 1
        h = mixed((text.sums[gram:] - text.sums[:n]) * text.inverses[:n])
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # the smallest hash, the first of equal ones
        wide, span = 1, length - gram + 1
        while 2 * wide <= span:
            least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
        if wide < span:
            least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
        at = (least & _PLACE).astype(np.int64)
        for end in self.limits[np.searchsorted(self.limits, begin) : np.searchsorted(self.limits, begin + len(data))].tolist():
            at[max(0, end - begin - length + 1) : max(0, end - begin)] = -1  # strings that do not lie in one text
        heads = np.flatnonzero(changes(at))
        counts, at = np.diff(np.append(heads, len(at))), at[heads]
        whole = at >= 0
        return heads[whole] + begin, counts[whole], at[whole] + begin, h[at[whole]]

    def shards(self) -> Iterator[tuple[int, slice]]:
        """The shards of anchor names and the places of their names."""
        shard = (self.names >> np.uint64(32)).astype(np.int64)
        limits = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(limits, limits[1:], strict=False):
            if a < b:
                yield int(shard[a]), slice(a, b)


class Stretches:
    """The distinct stretches of a chunk that several documents may share, in order of the shard that sorts them."""

    def __init__(self, survey: Survey, ids: list[int | None], answers: list):
        rules, raw = survey.rules, survey.raw
        self.length = rules.length
        told = {a["shard"]: a for a in answers or []}
        shared, hot = np.zeros(len(survey.names), bool), np.zeros(len(survey.names), bool)
        for shard, places in survey.shards():
            n = places.stop - places.start
            shared[places] = np.unpackbits(np.frombuffer(told[shard]["shared"], np.uint8), count=n)
            if told[shard]["hot"]:
                hot[places] = np.unpackbits(np.frombuffer(told[shard]["hot"], np.uint8), count=n)
        lowest, highest = np.full(len(survey.names), len(ids)), np.zeros(len(survey.names), np.int64)
        np.minimum.at(lowest, survey.name, survey.doc)
        np.maximum.at(highest, survey.name, survey.doc)
        keep = (shared | (lowest < highest))[survey.name]
        single = keep & hot[survey.name]
        keep &= ~single
        # the members: where each starts, its strings, the name of its anchor, its anchor's place
        reach = survey.count[single]
        start = np.repeat(survey.low[single], reach) + np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        self.start = np.concatenate([survey.low[keep], start])
        self.count = np.concatenate([survey.count[keep], np.ones(len(start), np.int64)])
        self.doc = np.concatenate([survey.doc[keep], np.repeat(survey.doc[single], reach)])
        offset = np.concatenate([(survey.at - survey.low)[keep], np.zeros(len(start), np.int64)])
        anchors = survey.names[survey.name[keep]]
        self.order_id = np.array([LAST if i is None else i for i in ids], np.int64)[self.doc]
        known: dict[bytes, int] = {}
        ends = self.start + self.count + rules.length - 1
        self.label = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(self.start.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.zeros(len(known), np.int64)
        first[self.label[::-1]] = np.arange(len(self.label))[::-1]
        self.texts = list(known)
        whole = np.array([int.from_bytes(hashlib.blake2b(self.texts[i], digest_size=8).digest(), "little") for i in self.label[len(anchors):].tolist()], np.uint64)
        self.name = np.concatenate([mixed(anchors), whole])[first]
        self.offsets, self.counts = offset[first], self.count[first]
        self.least = np.full(len(known), LAST, np.int64)
        np.minimum.at(self.least, self.label, self.order_id)
        self.shard = (self.name % np.uint64(rules.sorts)).astype(np.int64)
        self.order = np.lexsort((self.name, self.shard))

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """The shards and the stretches (numbers) each gets."""
        shard = self.shard[self.order]
        if len(shard):
            yield from ((int(shard[p[0]]), self.order[p]) for p in np.split(np.arange(len(shard)), np.flatnonzero(shard[1:] != shard[:-1]) + 1))

    def covered(self, answers: list, n: int) -> np.ndarray:
        """True for the bytes to remove, of `n`."""
        told = {a["shard"]: a["bits"] for a in answers or []}
        begin, total = np.zeros(len(self.texts), np.int64), 0
        bits = []
        for shard, which in self.parts():
            size = int(self.counts[which].sum())
            bits.append(np.unpackbits(np.frombuffer(told[shard], np.uint8), count=size))
            begin[which] = total + np.cumsum(self.counts[which]) - self.counts[which]
            total += size
        bits = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
        later = self.order_id > self.least[self.label]  # a smaller document of this very chunk has the whole stretch
        ends = np.cumsum(self.count)
        each, first = np.arange(int(self.count.sum())), ends - self.count
        gone = np.repeat(later, self.count) | bits[each + np.repeat(begin[self.label] - first, self.count)].astype(bool)
        starts = np.zeros(n + 1, bool)
        starts[(each + np.repeat(self.start - first, self.count))[gone]] = True
        at = np.flatnonzero(starts)
        apart = np.diff(at) > self.length
        edges = np.zeros(n + 1, np.int8)
        if len(at):
            edges[at[np.append(True, apart)]] = 1
            edges[at[np.append(apart, True)] + self.length] = -1
        return np.cumsum(edges[:n], dtype=np.int8).astype(bool)


def packed(size: int):
    """A function that packs rows (doc_id, text) into chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            data, limits = raw_texts(batch.column(1))
            limits = limits.tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), limits[:-1], limits[1:], strict=True):
                ids.append(doc_id)
                texts.append(data[a:b].tobytes())
                held += b - a
                if held >= size:
                    yield made(number, ids, texts, held)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield made(number, ids, texts, held)

    def made(number: int, ids: list, texts: list[bytes], held: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())),
            pa.array([held], pa.int64()), pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()),
        ], names=["chunk", "ids", "lengths", "size", "data"])

    return run


def by_row(fn):
    """A function over batches that calls `fn` with each row (a dict) and hands out the rows it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            for i in range(batch.num_rows):
                yield from fn({k: batch.column(k)[i].as_py() for k in batch.schema.names}, tables)

    return run


def surveyed(row: dict, rules: Rules, tables: Tables) -> Survey:
    data = pa.decompress(row["data"], row["size"], "zstd", asbytes=True) if row["size"] else b""
    return Survey(data, row["lengths"], rules, tables)


def anchor_names(rules: Rules):
    def fn(row: dict, tables: Tables) -> Iterator[pa.RecordBatch]:
        survey = surveyed(row, rules, tables)
        found = [(shard, row["chunk"], survey.names[p].astype("<u4").tobytes(), np.ceil(np.log2(survey.n[p])).astype(np.uint8).tobytes())
                 for shard, p in survey.shards()]
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "chunk", "names", "sizes"), f, strict=True)) for f in found], pa.schema(
            [("shard", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()), ("sizes", pa.binary())]))

    return by_row(fn)


def by_shard(fn):
    """A function over rows sorted by shard that calls `fn` with the rows (dicts) of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard and rows:
                    yield fn(rows)
                    rows = []
                shard = row["shard"]
                rows.append(row)
        if rows:
            yield fn(rows)

    return run


def shared_names(hot: int):
    """Answers to the chunks of one shard of names: which ones another chunk has too, and which are frequent."""

    def fn(rows: list[dict]) -> pa.RecordBatch:
        names = np.concatenate([np.frombuffer(r["names"], "<u4") for r in rows])
        _, of, chunks = np.unique(names, return_inverse=True, return_counts=True)
        times = np.zeros(len(chunks), np.int64)
        np.add.at(times, of, 1 << np.concatenate([np.frombuffer(r["sizes"], np.uint8) for r in rows]).astype(np.int64))
        shared, often, at, out = (chunks > 1)[of], (times > hot)[of], 0, []
        for r in rows:
            mine = slice(at, at + len(r["sizes"]))
            at = mine.stop
            out.append({"chunk": r["chunk"], "shard": r["shard"], "shared": np.packbits(shared[mine]).tobytes(),
                        "hot": np.packbits(often[mine]).tobytes() if often[mine].any() else b""})
        return pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())]))

    return by_shard(fn)


def sent(rules: Rules):
    """The stretches a chunk sends to the shards that sort them."""

    def fn(row: dict, tables: Tables) -> Iterator[pa.RecordBatch]:
        stretches = Stretches(surveyed(row, rules, tables), row["ids"], row["names"])
        for shard, which in stretches.parts():
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "chunk": row["chunk"], "name": stretches.name[which].tobytes(), "offset": stretches.offsets[which].astype("<u2").tobytes(),
                "count": stretches.counts[which].astype("<u2").tobytes(), "doc": stretches.least[which].tobytes(),
                "data": pa.compress(b"".join([stretches.texts[i] for i in which.tolist()]), "zstd", asbytes=True),
            }], pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("name", "offset", "count", "doc", "data"))]))

    return by_row(fn)


def earlier(length: int):
    """Answers to the chunks of one shard: for each string of their stretches, whether it starts in a smaller document."""

    def fn(rows: list[dict]) -> pa.RecordBatch:
        read = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows]).astype(kind[1:])
        name, offset, count, doc = read("name", "<u8"), read("offset", "<u2").astype(np.int64), read("count", "<u2").astype(np.int64), read("doc", "<i8")
        sizes = [len(r["doc"]) // 8 for r in rows]
        limits = np.concatenate([[0], np.cumsum(sizes)])
        texts = []
        for r, a, b in zip(rows, limits[:-1], limits[1:], strict=True):
            texts.append(np.frombuffer(pa.decompress(r["data"], int((count[a:b] + length - 1).sum()), "zstd", asbytes=True), np.uint8))
        data, size = np.concatenate(texts), count + length - 1
        start = np.cumsum(size) - size
        order = np.argsort(name, kind="stable")
        new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        bits = np.zeros(int(count.sum()), bool)
        begin = np.cumsum(count) - count
        held, heads = np.cumsum(size[order]), np.flatnonzero(new)
        at = 0
        while at < len(order):  # whole buckets of about BATCH bytes
            upto = int(np.searchsorted(held, (held[at - 1] if at else 0) + BATCH, side="right"))
            place = int(np.searchsorted(heads, upto, side="right")) - 1
            stop = len(order) if upto >= len(order) else int(heads[place]) if heads[place] > at else int(np.append(heads, len(order))[place + 1])
            which = order[at:stop]
            mine = size[which]
            moved = np.cumsum(mine) - mine
            inner = np.arange(int(mine.sum())) - np.repeat(moved, mine)
            least = least_docs(data[np.repeat(start[which], mine) + inner], moved, np.cumsum(new[at:stop]) - 1, offset[which], count[which], doc[which], length)
            within = np.arange(len(least)) - np.repeat(np.cumsum(count[which]) - count[which], count[which])
            bits[np.repeat(begin[which], count[which]) + within] = least < np.repeat(doc[which], count[which])
            at = stop
        out, ends = [], np.append(begin, len(bits))
        for r, a, b in zip(rows, limits[:-1], limits[1:], strict=True):
            out.append({"chunk": r["chunk"], "shard": r["shard"], "bits": np.packbits(bits[ends[a] : ends[b]]).tobytes()})
        return pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("bits", pa.binary())]))

    return by_shard(fn)


def cleaned(rules: Rules, with_text: bool):
    """The rows of a chunk's documents."""

    def fn(row: dict, tables: Tables) -> Iterator[pa.RecordBatch]:
        survey = surveyed(row, rules, tables)
        stretches = Stretches(survey, row["ids"], row["names"])
        gone = stretches.covered(row["strings"], len(survey.data))
        out = []
        for doc_id, a, b in zip(row["ids"], survey.limits[:-1].tolist(), survey.limits[1:].tolist(), strict=True):
            cut = gone[a:b]
            kept = survey.data[a:b][~cut].tobytes()
            out.append({
                "doc_id": doc_id, "n_bytes": b - a, "n_removed": b - a - len(kept),
                "n_spans": int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(len(cut) > 0 and cut[0]), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                **({"kept": kept} if with_text else {}),
            })
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        for at in range(0, len(out), 2000):
            yield pa.RecordBatch.from_pylist(out[at : at + 2000], pa.schema([*kinds, *([("kept", pa.binary())] if with_text else [])]))

    return by_row(fn)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, hot: int = HOT, named: int = NAMED, sorted_: int = SORTED,
    with_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with `with_text` the bytes kept as well."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = staged(rows.mapInArrow(packed(chunk), "chunk bigint, ids array<bigint>, lengths array<bigint>, size bigint, data binary"))
    size, n = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    rules = Rules(length, gram, hot, max(1, size // named), max(1, size // sorted_))
    tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, n // 8)))

    def answered(answers: DataFrame, name: str) -> DataFrame:
        fields = [c for c in answers.columns if c != "chunk"]
        return staged(answers.groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias(name)))

    def told(*answers: DataFrame) -> DataFrame:
        known = chunks.repartition(tasks, "chunk")
        for a in answers:
            known = known.join(a.repartition(tasks, "chunk").hint("shuffle_hash"), "chunk", "left")
        return known

    def dealt(parts: DataFrame, shards: int) -> DataFrame:
        parted = max(1, min(shards, 4 * tasks))
        return parts.repartitionById(parted, (F.col("shard") % parted).cast("int")).sortWithinPartitions("shard", "chunk")

    asked = chunks.select("chunk", "lengths", "size", "data").mapInArrow(anchor_names(rules), "shard bigint, chunk bigint, names binary, sizes binary")
    names = answered(dealt(asked, rules.names).mapInArrow(shared_names(hot), "chunk bigint, shard bigint, shared binary, hot binary"), "names")
    stretches = told(names).mapInArrow(sent(rules), "shard bigint, chunk bigint, name binary, offset binary, count binary, doc binary, data binary")
    strings = answered(dealt(stretches, rules.sorts).mapInArrow(earlier(length), "chunk bigint, shard bigint, bits binary"), "strings")
    columns = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return told(names, strings).mapInArrow(cleaned(rules, with_text), columns)


SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {LAST}) AS id, hex(encode(coalesce(text, ''))) AS t FROM documents),
    n AS (SELECT *, length(t) // 2 AS n_bytes FROM d),
    s AS (SELECT rid, id, i, substr(t, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT rid, id, t, unnest(range(n_bytes - {LENGTH - 1})) AS i FROM n)),
    gone AS (SELECT rid, i FROM s QUALIFY min(id) OVER (PARTITION BY s) < id),
    runs AS (SELECT rid, i, i > lag(i) OVER (PARTITION BY rid ORDER BY i) + {LENGTH} AS apart FROM gone),
    spans AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT rid, i,
        sum(coalesce(apart, TRUE)::INT) OVER (PARTITION BY rid ORDER BY i) AS span FROM runs) GROUP BY rid, span),
    cuts AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM spans),
    kept AS (SELECT n.rid, string_agg(substr(t, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k, sum(b - a) AS gone, count(*) AS spans, max(b) AS done
        FROM n JOIN cuts ON cuts.rid = n.rid GROUP BY n.rid)
    SELECT doc_id, n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
        sha256(unhex(coalesce(k, '') || substr(t, 2 * coalesce(done, 0) + 1))) AS kept_sha256
    FROM n LEFT JOIN kept ON kept.rid = n.rid"""

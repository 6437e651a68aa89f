import hashlib
import zlib

import pyarrow.parquet as pq
import pytest

from tests.conftest import SF
from tests.llm.test_llm_queries import sql
from tidemark.llm.prefix_trie import Trie, middles, prefix_trie
from tools.check import differences


def plain(path):
    """The nodes, by prefixes as tuples."""
    rows = [r for r in pq.read_table(f"{path}/conversations.parquet").to_pylist() if r["conv_id"] is not None]
    convs = {}
    for r in rows:
        role, text = r["role"] or "", r["text"] or ""
        tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        convs.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"] or 0), tie, (role, text)))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c in sorted(built):
        ends.setdefault(built[c], []).append(c)
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    found = {p: [0, 0, 0] for p in members}  # children, leaves, saved
    for p in sorted(members, key=len, reverse=True):
        node = found[p]
        node[1] = node[1] or 1
        node[2] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            up = found[p[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + node[1], up[2] + node[2]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), *found[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items())


@pytest.mark.parametrize("shard", [1 << 14, 40, 1])
def test_equals_prefixes_in_shards_of_any_size(spark, edge, shard):
    rows = prefix_trie(spark.read.parquet(f"{edge}/conversations.parquet"), shard).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in rows) == plain(edge)


def test_plain_version_equals_sql(spark):
    table = sql(SF, "op11_prefix_trie")
    got = prefix_trie(spark.read.parquet(f"{SF}/conversations.parquet"), 8).toPandas()
    assert differences(got, table) == ""


def test_searches_among_siblings_are_balanced():
    trie, n = Trie(), 1 << 10
    for i in middles(n):
        trie.path([i], [1])

    def height(node):
        level, deep = [node], 0
        while level:
            level, deep = [k for x in level for k in (trie.low[x], trie.high[x]) if k >= 0], deep + 1
        return deep

    assert len(trie.id) == n + 1 and height(trie.child[0]) <= 11
    assert sorted(middles(17)) == list(range(17))

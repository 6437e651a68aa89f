import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF
from tests.llm.test_llm_queries import key
from tidemark.llm import suffix_dedup
from tidemark.llm.hashing import Tables
from tidemark.llm.suffix_dedup import LAST, Hashed, Rules, Survey, least_docs, suffix_sorted, without_repeats


def plain(rows, length):
    """Every string of every text in a dictionary."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    order = lambda d: LAST if d is None else d
    least = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            least[t[i : i + length]] = min(order(d), least.get(t[i : i + length], LAST))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < order(d):
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((d, len(t), int(gone.sum()), int(np.count_nonzero(gone[:-1] & ~np.roll(gone, 1)[:-1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def few_letters(seed, n=120):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 30))) for _ in range(12)]
    rows = [(rng.randint(0, n), "".join(rng.choice([*pool, rng.choice("abcdé")]) for _ in range(rng.randint(0, 6)))) for _ in range(n)]
    return rows + [(None, pool[0] * 3), (None, pool[0] * 3 + "x"), (5, None), (6, ""), (7, "a" * 200), (8, "a" * 100), (9, "ab" * 90)]


@pytest.mark.parametrize(("chunk", "hot", "shards"), [(1 << 20, 1 << 16, 1 << 20), (60, 1 << 16, 40), (60, 3, 40), (1, 0, 200)])
def test_equals_a_dictionary_of_all_strings(spark, chunk, hot, shards):
    rows = few_letters(chunk + hot)
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = without_repeats(docs, 9, 4, chunk, hot, shards, shards).collect()
    assert sorted(map(tuple, got), key=key) == plain(rows, 9)


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_production_lengths(spark, edge, where):
    path = f"{SF if where == 'sf' else edge}/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    for chunk in (1 << 23, 1 << 14):
        got = without_repeats(spark.read.parquet(path), chunk=chunk, with_text=True).collect()
        assert sorted((tuple(r[:5]) for r in got), key=key) == plain(rows, 50)
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_stretches_do_not_depend_on_where_texts_are_cut(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 5, 9, 300, 8, 77)]
    rules = Rules(9, 4, 10, 3, 3)

    def strings(step):
        monkeypatch.setattr(suffix_dedup, "STEP", step)
        survey = Survey(b"".join(texts), [len(t) for t in texts], rules, Tables())
        return [(p, int(a), int(n)) for low, k, a, n in zip(survey.low, survey.count, survey.at, survey.names[survey.name], strict=True)
                for p in range(low, low + k)]

    expected = strings(1 << 20)
    assert strings(16) == expected and len(expected) == sum(max(0, len(t) - 8) for t in texts)


def test_sort_is_right_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts, lengths, bucket = np.arange(2900), rng.integers(1, 60, 2900), np.sort(rng.integers(0, 40, 2900))
    raw = data.tobytes()
    suffix = lambda i: raw[starts[i] : starts[i] + lengths[i]]
    expected = sorted(range(2900), key=lambda i: (bucket[i], suffix(i)))
    seeds = []

    class Weak(Tables):
        def __init__(self, seed=11):
            super().__init__(seed)
            seeds.append(seed)
            if len(seeds) == 1:
                self.values[:] = 7  # every byte hashes alike

    monkeypatch.setattr(suffix_dedup, "Tables", Weak)
    suffix_dedup.tables_of.cache_clear()
    order, new = suffix_sorted(data, starts, lengths, bucket)
    suffix_dedup.tables_of.cache_clear()
    assert len(seeds) == 2
    assert [suffix(i) for i in order] == [suffix(i) for i in expected]
    assert new.tolist() == [True] + [bucket[a] != bucket[b] or suffix(a) != suffix(b) for a, b in zip(order, order[1:], strict=False)]


def test_looks_at_a_suffix_do_not_grow_with_its_bucket(monkeypatch):
    looks, look = [], Hashed.__call__
    monkeypatch.setattr(Hashed, "__call__", lambda self, starts, lengths: looks.append(len(starts)) or look(self, starts, lengths))

    def per_suffix(n):  # strings round one frequent phrase, all of them in one bucket
        rng = np.random.default_rng(n)
        data = rng.integers(97, 123, (n, 60)).astype(np.uint8)
        data[:, 20:44] = np.frombuffer(b"a phrase of twenty-four.", np.uint8)
        starts = np.arange(n) * 60 + rng.integers(0, 20, n)
        looks.clear()
        order, new = suffix_sorted(data.ravel(), starts, np.full(n, 40), np.zeros(n, np.int64))
        raw = data.tobytes()
        suffixes = [raw[starts[i] : starts[i] + 40] for i in order]
        assert suffixes == sorted(suffixes) and new.sum() == len(set(suffixes))
        return sum(looks) / n

    few, many = per_suffix(500), per_suffix(16_000)
    assert many < 2 * few


def test_suffixes_that_end_in_the_bytes_that_follow():
    texts = [b"", b"\0", b"a", b"a\0", b"a\0\0", b"a\0b", b"ab", b"a" * 8, b"a" * 9, b"a" * 7 + b"\0", b"a" * 7, b"\xff" * 9, b"\xff" * 8, b"b"] * 2
    lengths = np.array([len(t) for t in texts])
    order, new = suffix_sorted(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths, np.zeros(len(texts), np.int64))
    assert [texts[i] for i in order] == sorted(texts)
    assert new.tolist() == [True, False] * 14


def test_strings_of_stretches_that_differ():
    text = np.frombuffer(b"xxABCDEyyABCDEyzABCDEy", np.uint8)
    # anchor ABC; stretches xxABCDEy, yyABCDEy, yzABCDEy of strings of 5 bytes
    least = least_docs(text, np.array([0, 7, 14]), np.zeros(3, np.int64), np.array([2, 2, 2]), np.array([4, 4, 4]), np.array([3, 1, 2]), 5)
    assert least.tolist() == [3, 3, 1, 1, 1, 1, 1, 1, 2, 2, 1, 1]

import gzip
import json
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, hashing, language, mixing, quality, quality_rules, samples, simhash, token_counts, topk, toxicity, warc,
)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))


ALPHABET = ["a", "b", "the ", " ", "  ", "\n", " \n", "\n ", "é", "中", "▁", "𓀀", "\t", "hello", "<s>", "</s>", "-", "1", "2024", "ﬁ", "　"]


def test_splices_and_segments_give_the_library_s_counts(counter):
    rng = random.Random(1)
    whole = counter.processor
    assert counter.proven
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 200)))
        if rng.random() < 0.2:
            text = text.replace(" ", "")
        n = len(whole.encode(text))
        assert counter.count(text) == n
        assert not text or token_counts.count_long(whole, text, rng.choice([8, 20, 50]), rng.choice([2, 4, 16])) == n


def test_parts_of_texts_give_the_library_s_ids(monkeypatch):
    rng = random.Random(2)
    encoding = byte_bpe.open_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "_RUN", re.compile(f"[{byte_bpe._SPACE}]{{3,}}"))
    for _ in range(5000):
        text = "".join(rng.choice([*ALPHABET, "'s", "'", "     ", "\x1c", "\x85", "<|endoftext|>"]) for _ in range(rng.randint(0, 60)))
        ids = byte_bpe.ids_of(encoding, text, rng.choice([1, 3, 10]))
        assert ids == encoding.encode_ordinary(text) and encoding.decode_bytes(ids) == text.encode()


def test_very_long_white_space_is_encoded():
    encoding = byte_bpe.open_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "a" + " " * 3_000_000 + "x" + "\n" * 100_000
    assert encoding.decode_bytes(byte_bpe.ids_of(encoding, text)) == text.encode()


def test_hashed_words_are_the_words():
    tables = hashing.Tables()
    texts = ["a bb  a\tbb", None, "", "  x", "y ", "z", "Q q"]
    import pyarrow as pa

    [(rows, [(data, limits)])] = list(hashing.runs(pa.array(texts), tables.space))
    words = hashing.Words(data, limits, tables)
    found = [(int(t), bytes(data[a:b]).decode()) for t, a, b in zip(words.texts, words.starts, words.ends, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    lowered = words.span_hash(words.sums(tables.lowered), words.starts, words.ends)
    assert lowered[0] == lowered[2] != lowered[1] == lowered[3] and lowered[-1] == lowered[-2]
    long = pa.array(["ab cd " * 500_000, "s"])
    assert sum(len(hashing.Words(d, at, tables).texts) for _, cuts in hashing.runs(long, tables.space) for d, at in cuts) == 1_000_001


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 2**63, rng.integers(1, 9), dtype=np.uint64)
        prints = base[rng.integers(0, len(base), n)]
        for _ in range(int(rng.integers(0, 7))):
            prints = prints ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        prints = np.unique(prints)
        shard = np.sort(rng.integers(0, 3, len(prints)))
        near = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4) & (shard[:, None] == shard[None, :])
        assert (simhash.Forest(shard, prints, 4).components() == simhash.joined(len(prints), *np.nonzero(near))).all()


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_some_choice_of_blocks_agrees(blocks):
    rng = random.Random(blocks)
    masks = simhash.masks(blocks, 4)
    assert len(masks) == math.comb(blocks, 4)
    for _ in range(500):
        changed = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not changed & m for m in masks)


def test_crowded_shards_and_more_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    prints = np.unique(np.uint64(12345678901234567) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
                       ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ rng.integers(0, 2**62, 400, dtype=np.uint64) * np.uint64(0))
    prints = np.concatenate([prints, rng.integers(0, 2**63, 200, dtype=np.uint64)])
    rows = [(i, int(p)) for i, p in enumerate(prints.view(np.int64).tolist())]
    label = simhash.joined(len(prints), *np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4))
    docs = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    for cell, shard in ((16, 1024), (4096, 2)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "SHARD", shard)
        got = {r["fp"]: r["component_id"] for r in simhash.components(docs).collect()}
        assert [got[p] for _, p in rows] == label.tolist()


def test_one_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    rows = [(3, a), (1, a), (1, a), (2, b), (None, b), (None, "x y"), (None, "x y"), (5, None), (6, ""), (7, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("kept"))
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "x y"), (5, None), (7, "alone")], key=str)


def gram_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar_groups(texts, least=0.8):
    """The first member of each one's group, by all pairs."""
    sets = [gram_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j]))
             and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return simhash.joined(len(sets), *np.array(pairs, np.int64).reshape(-1, 2).T)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"w{rng.randint(0, 10**6)}"
    return words


@pytest.mark.parametrize("paired", [256, 8])
def test_similar_texts_are_found_whole(spark, monkeypatch, paired):
    rng = random.Random(8)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    texts = []
    for group in range(12):  # copies with a few words changed, some under and some over the similarity
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([40, 200, 900]))]
        texts += [" ".join(edited(rng, base, max(1, round(len(base) * rng.choice([0.002, 0.01, 0.02, 0.04]))))) for _ in range(8)]
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts += [" ".join(edited(rng, base, 2)).upper() for _ in range(60)]  # a crowded group
    texts += [None, "", "one word", "one word", "two words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("node", F.lit("kept"))
    links = [(r["a"], r["b"]) for r in simhash.similar_links(docs).collect()]
    label = simhash.joined(len(texts), *np.array(links).T)
    assert label.tolist() == similar_groups(texts).tolist()
    out = simhash.one_of_similar(docs)
    assert out.columns == docs.columns
    first = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    left = sorted(first)
    expected = {left[i] for i in similar_groups([texts[i] for i in left])}
    assert {r["doc_id"] for r in out.collect()} == expected


def test_thresholds_are_ordered_and_grades_recovered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 600)
    rows = [np.array([2 + g, 50 + int(rng.integers(0, 40))], "<i4") for g in grades]
    model = quality._fitted(rows, [np.array([5.0, 1.0], "<f4")] * 600, grades, 4, 12, 0.05, 1e-4)
    assert (np.diff(model.thresholds) > 0).all()
    sums = np.array([model.weights[r] @ [5.0, 1.0] for r in rows])
    expected = model.tails(sums).sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9
    nothing = quality._fitted([], [], np.zeros(0, int), 4, 12, 0.05, 1e-4)
    assert (np.diff(nothing.thresholds) > 0).all() and not nothing.weights.any()


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(2)
    targets = rng.integers(0, 2, 800).astype(float)
    rows = [np.unique(np.concatenate([[7] if t else [], rng.integers(100, 3000, 20)])).astype("<i4") for t in targets]
    model = toxicity.fitted(rows, targets, 3, 0.3, 1.0, 6.0, 0.1)
    assert model.coordinates.tolist() == [7] and model.weights[0] > 2
    assert len(toxicity.fitted([], [], 3, 0.3, 1.0, 6.0, 0.1).weights) == 0


def test_several_centroids_and_rejection(spark):
    rng = random.Random(3)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["kvazi", "zxwq", "pqj"]}
    rows = [(i, " ".join(rng.choices(words[k], k=20)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs, per_language=2, least_similarity=0.2)
    assert sorted(set(model.languages)) == ["aa", "bb"]
    odd = spark.createDataFrame([(1, "lorem dolor"), (2, "zxwq"), (3, "語語語"), (4, "12 !"), (5, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.predict(odd, model).collect()}
    assert got[1] == ("aa", False) and got[2] == ("bb", False) and got[3][1] and got[4] == ("und", True) and got[5] == ("und", True)
    assert sorted(r["doc_id"] for r in language.accepted(odd, model).collect()) == [1, 2]


def test_threshold_algorithm_equals_sorting(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-9, 10, (700, 12))
    v[:, 3] = 0
    v[300:340] = v[0]
    lists = topk.Lists(rng.permutation(700), v)
    for q, own in ((lists.v[5], lists.ids[5]), (np.zeros(12, int), 3), (lists.v[0], lists.ids[0]), (-lists.v[9], -1)):
        score = lists.v @ q
        order = [i for i in np.lexsort((lists.ids, -score)) if lists.ids[i] != own][:20]
        ids, scores = lists.top(q, own, 20)
        assert ids.tolist() == lists.ids[order].tolist() and scores.tolist() == score[order].tolist()
    rows = [(i, [float(x) / 64 for x in r]) for i, r in enumerate(v.tolist())]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    few = sorted(map(tuple, topk.top_k(frame, "vec_id % 50 = 0", 5, rows=100, queries=4).collect()))
    assert few == sorted(map(tuple, topk.top_k(frame, "vec_id % 50 = 0", 5).collect())) and len(few) == 70


def test_archives_are_normalised(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "p" * (90 + i)) for i in range(40)] + [(99, "u", "p" * 120)],
                                  "page_id bigint, url string, html string").repartition(2)
    streams = warc.write(warc.with_revisits(pages), str(tmp_path / "raw")).collect()
    raw = [open(r["archive"], "rb").read() for r in streams]
    for data in raw:  # one member each
        stream = warc.zlib.decompressobj(wbits=31)
        stream.decompress(data)
        assert stream.eof and not stream.unused_data
    frame = spark.createDataFrame([(r["archive"],) for r in streams], "archive string")
    done = warc.normalise(frame, str(tmp_path / "own")).collect()
    assert sum(r["records"] for r in done) == 41
    for r in done:
        data = open(r["archive"], "rb").read()
        places = [json.loads(line) for line in open(r["index"])]
        members = [gzip.decompress(data[p["offset"] : p["offset"] + p["length"]]) for p in places]
        assert b"".join(members) == gzip.decompress(data) and all(m.startswith(b"WARC/1.1\r\n") for m in members)
    archives = spark.createDataFrame([(r["archive"], r["index"]) for r in done], "archive string, index string")
    got = {r["page_id"]: r for r in warc.read(archives, str(tmp_path / "own")).collect()}
    assert got[99]["refers_to"] == 30 and got[99]["payload_bytes"] == 120 and got[30]["payload"] == bytearray(b"p" * 120)


def test_records_come_whole_from_any_pieces():
    made = [warc.record(i, "u", b"\r\n\r\nWARC" * i, "0" * 64, 8 * i, None) for i in range(6)]
    data = b"".join(made)
    for size in (1, 7, 100, len(data)):
        assert [w for _, w in warc.records_of(iter(data[i : i + size] for i in range(0, len(data), size)))] == made
    with pytest.raises(ValueError):
        list(warc.records_of(iter([data[:-3]])))


def test_em_trusts_rules_that_agree():
    rng = random.Random(7)
    patterns = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        right = (0.99, 0.97, 0.9, 0.6) if good else (0.8, 0.5, 0.3, 0.4)  # the last rule errs on 40 % of good documents
        vote = tuple((1 if (rng.random() < r) == good else -1) if rng.random() < 0.9 else 0 for r in right)
        patterns[vote] = patterns.get(vote, 0) + 1
    share, good, poor = quality_rules.estimated(sorted(patterns.items()), 4, rounds=100)
    assert 0.75 < share < 0.85
    assert good == [pytest.approx(r, abs=0.03) for r in (0.99, 0.97, 0.9, 0.6)]
    assert poor == [pytest.approx(r, abs=0.05) for r in (0.8, 0.5, 0.3, 0.4)]
    assert quality_rules.weight(-1, good[3], poor[3]) > -0.2  # a bad vote of a rule that errs often says next to nothing
    share, good, poor = quality_rules.estimated([], 4)
    assert share == pytest.approx(0.8) and good == [pytest.approx(0.95)] * 4


def test_rules_are_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f a b c d e")], "doc_id bigint, text string")
    plan = quality_rules.counts(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ObjectHash", plan)
    row = quality_rules.counts(docs).first()
    assert (row["n_words"], row["n_repeat_words"]) == (11, 10)


def test_targets_are_capped_and_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, None: 90}
    rows = [(s, n, float(i % 3 + 1)) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size bigint, weight double")).collect()}
    assert got["a"] == 30 and got["c"] == 0 and got[None] == 270 and got["b"] == pytest.approx(800)


def test_rows_are_repeated_as_taken(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(200)] + [(None, "n n", "a"), (3, "", None)],
                                 "doc_id bigint, text string, source string").withColumn("copies", F.lit(9))
    plan = mixing.mixed(docs)
    out = mixing.drawn_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    words = out.select(F.size(F.split(F.btrim("text"), " "))).groupBy().sum().first()[0]
    assert abs(words - plan.agg(F.sum("taken")).first()[0]) <= 3


def test_texts_that_only_share_a_passage_stay(spark):
    rng = random.Random(11)
    texts = []
    for similarity in (0.55, 0.65, 0.72):  # a text of 200 shingles with so much of one passage in it
        shared = round(200 * 2 * similarity / (1 + similarity)) + 4
        passage = [f"p{rng.randint(0, 10**6)}" for _ in range(shared)]
        texts += [" ".join(passage + [f"w{rng.randint(0, 10**9)}" for _ in range(204 - shared)]) for _ in range(1000)]
    footer = " ".join(f"f{i}" for i in range(40))
    bodies = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(200)) for _ in range(2)]
    texts += [f"{body} " + " ".join([footer] * 30) for body in bodies]  # near fingerprints by repeats alone
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    left = {r["doc_id"] for r in simhash.one_of_similar(docs).collect()}
    assert left == set(range(len(texts)))


def test_near_copies_that_repeat_a_passage_are_found(spark):
    rng = random.Random(12)
    texts = []
    for i in range(80):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:200] + words[160:200] * (8 if i % 2 else 20) + words[200:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r["a"], r["b"]) for r in simhash.similar_links(docs).collect()} == {(i, i + 1) for i in range(0, 160, 2)}
    assert {r["doc_id"] for r in simhash.one_of_similar(docs).collect()} == set(range(0, 160, 2))


def test_radius_misses_one_pair_in_900_000_at_most():
    def chance(n, most):  # of at most `most` of n bits set
        return sum(math.comb(n, k) for k in range(min(n, most) + 1)) / 2**n if most >= 0 else 0.0

    worst = 0.0
    for a in range(1, 61):
        for b in range(a, a * 5 // 4 + 1):
            shared = -(-4 * (a + b) // 9)  # the least that makes 0.8
            if shared <= a:
                low = [(chance(a - shared, a // 2 - c), chance(b - shared, b // 2 - c)) for c in range(shared + 1)]
                worst = max(worst, sum(math.comb(shared, c) / 2**shared * (u + v - 2 * u * v) for c, (u, v) in enumerate(low)))
    assert worst == pytest.approx(0.1875)
    missed = sum(math.comb(64, k) * worst**k * (1 - worst) ** (64 - k) for k in range(simhash.WIDE + 1, 65))
    assert missed < 1 / 900_000


@pytest.mark.parametrize("keep", [simhash.one_of_each, simhash.one_of_similar])
def test_repeated_and_missing_ids_lose_and_keep_no_text(spark, keep):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(2000)]
    near = " ".join(words), " ".join([*words[:-1], "end"])
    assert 0 < (simhash.fingerprint(near[0], 5) ^ simhash.fingerprint(near[1], 5)).bit_count() <= 4
    rows = [(1, "one text of its own here"), (1, "quite another text under the same id"), (None, near[0]), (None, near[1]), (2, "x y")]
    out = keep(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 1, 2]
    assert {r["text"] for r in out if r["doc_id"] == 1} == {rows[0][1], rows[1][1]}


def test_many_rows_of_one_id_are_drawn_one_by_one(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(["w"] * n)
    rows = [(None, words(20), "a")] * 500 + [(7, words(20), "b")] * 300 + [(7, words(30), "b")] * 200
    rows += [(i, words(rng.randint(1, 90)), "c") for i in range(400)]
    plan = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).toPandas()
    per = plan.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) <= 20).all()
    again = mixing.mixed(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string").repartition(2)).toPandas()
    key = ["source", "size", "copies"]
    assert plan.groupby(key).size().to_dict() == again.groupby(key).size().to_dict()


def test_inclusion_follows_size(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 400)), "ab"[i % 2]) for i in range(4000)], "doc_id bigint, text string, source string")
    plan = mixing.mixed(docs, weights=(1, 5)).toPandas()
    for _, rows in plan.groupby("source"):
        base = rows.copies.min()
        expected, extra = (rows.inclusion * rows["size"]).sum(), (rows.copies > base)
        assert expected == pytest.approx(rows.target.iloc[0] - base * rows["size"].sum(), rel=1e-4)
        assert extra[rows.inclusion >= 1].all()
        free = rows[rows.inclusion < 1]
        small, large = free[free["size"] < free["size"].median()], free[free["size"] >= free["size"].median()]
        for part in (small, large):  # shares drawn are the inclusions
            assert (part.copies > base).mean() == pytest.approx(part.inclusion.mean(), abs=0.06)
        assert small.inclusion.mean() < large.inclusion.mean()


def test_rejection_at_the_production_threshold(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    noise = [(i, " ".join(letters() for _ in range(n))) for i, n in enumerate([5, 20, 100, 1000] * 50)]
    found = {r["doc_id"]: r["rejected"] for r in language.predict(spark.createDataFrame(noise, "doc_id bigint, text string"), model).collect()}
    assert all(found[i] for i in found if i % 4) and np.mean([found[i] for i in found if i % 4 == 0]) > 0.85
    assert language.predict(docs, model).where("rejected").count() == 0
    without = language.fit(docs.where("lang <> 'de'"))
    german = language.predict(docs.where("lang = 'de'"), without)
    assert german.where("rejected").count() > 0.9 * german.count()


def test_segments_without_spaces_are_not_remembered():
    counter = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(30):
        counter.count("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(8000)) + " a word")
    assert sum(map(len, counter.known)) < 100


def test_long_texts_of_any_script_are_cut():
    text = " ".join(["слово", "число9", "ηλιος"] * 30_000)
    assert max(map(len, byte_bpe.parts(text, 1000))) < 1100
    encoding = byte_bpe.open_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert byte_bpe.ids_of(encoding, text[:20_000], 500) == encoding.encode_ordinary(text[:20_000])


def test_samples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "w" * (10 if i % 2 else 3000)) for i in range(100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    take = lambda rows, size: samples.labelled(docs, labels, F.col("quality"), rows, size).toPandas()
    learnt = take(1000, 1 << 28)
    assert len(learnt) == len(take(len(learnt), 1 << 28)) > 60
    small = take(20, 1 << 20)  # texts over 1 kB are not counted
    assert len(small) == 20 and set(small.grade) == {1}
    assert take(1000, 1 << 15).text.str.len().sum() <= 1 << 15


def test_well_packed_archives_are_inflated_in_pieces():
    import io

    data = bytes(40 << 20)
    packed = gzip.compress(data) + gzip.compress(b"end")
    pieces = list(warc.inflated(io.BytesIO(packed)))
    assert max(map(len, pieces)) <= warc.INFLATED and b"".join(pieces) == data + b"end"

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash

from tests.conftest import SF
from tidemark.llm import byte_bpe
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.simhash import joined
from tools.check import differences


def texts(sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]


def sql(sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(ORACLES[name]).df()


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("where", ["sf", "edge"])
def test_equals_sql(spark, edge, name, where):
    sf = SF if where == "sf" else edge
    assert differences(QUERIES[name](spark, sf).toPandas(), sql(sf, name)) == ""


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_token_counts_are_the_library_s(spark, edge, where):
    sf = SF if where == "sf" else edge
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = [len(model.encode(t or "")) for _, t in texts(sf)]
    expected = sorted(((d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(texts(sf), counts, strict=True)), key=key)
    assert sorted(map(tuple, QUERIES["op3_token_counts"](spark, sf).collect()), key=key) == expected


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_byte_bpe_is_the_library_s_and_goes_back(spark, edge, where):
    sf = SF if where == "sf" else edge
    encoding = byte_bpe.open_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def row(doc_id, text):
        ids = encoding.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    expected = sorted((row(*r) for r in texts(sf)), key=key)
    assert sorted(map(tuple, QUERIES["op7_byte_bpe"](spark, sf).collect()), key=key) == expected


def plain_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_near_dedup_equals_all_pairs(spark, edge, where):
    sf = SF if where == "sf" else edge
    rows = [(d, plain_fingerprint(t)) for d, t in texts(sf)]
    prints = np.array([f for _, f in rows], np.uint64)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    label = joined(len(rows), a, b)
    first = {}
    for (d, _), c in zip(rows, label.tolist(), strict=True):
        if d is not None:
            first[c] = min(d, first.get(c, d))
    expected = sorted(((d, f"{f:016x}", first.get(c)) for (d, f), c in zip(rows, label.tolist(), strict=True)), key=key)
    assert sorted(map(tuple, QUERIES["op2_simhash_near_dedup"](spark, sf).collect()), key=key) == expected


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 == 2


def auc(score, target):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    target = np.asarray(target, bool)
    return (rank[target].sum() - target.sum() * (target.sum() + 1) / 2) / (target.sum() * (~target).sum())


BIG = SF.replace("sf0.001", "sf0.1")


@pytest.mark.skipif(not os.path.exists(BIG), reason="needs the larger tables")
def test_classifiers_on_held_out_rows(spark):
    labels = pq.read_table(f"{BIG}/labels.parquet").to_pandas().set_index("doc_id")
    known = pq.read_table(f"{BIG}/documents.parquet", columns=["doc_id", "lang"]).to_pandas().set_index("doc_id")
    quality = QUERIES["op1_quality_classifier"](spark, BIG).toPandas().set_index("doc_id").join(labels, how="inner")
    assert [held_out(d) for d in quality.index] == quality.held_out.tolist()
    quality = quality[quality.held_out]
    assert auc(quality.expected_grade, quality.quality) > 0.98
    assert quality[quality.quality == 1].kept.mean() > 0.99
    assert quality[quality.quality == 0].kept.mean() < 0.06
    toxic = QUERIES["op4_toxicity"](spark, BIG).toPandas().set_index("doc_id").join(labels, how="inner")
    toxic = toxic[toxic.held_out]
    assert auc(toxic.score, toxic.toxic) > 0.98
    assert toxic[toxic.toxic == 0].predicted.mean() < 0.02
    assert ((toxic.score >= 0.3) == (toxic.predicted == 1)).all()
    lang = QUERIES["op6_language_id"](spark, BIG).toPandas().set_index("doc_id").join(known)
    lang = lang[lang.held_out]
    assert (lang.lang == lang.lang_pred).mean() > 0.99
    assert lang.rejected.mean() < 0.002


def test_classifiers_on_odd_rows(spark, edge):
    n = len(texts(edge))
    lang = QUERIES["op6_language_id"](spark, edge).toPandas()
    assert len(lang) == n and lang.score.between(0, 1).all()
    assert set(lang.lang_pred) <= {"en", "de", "fr", "ja", "und"}
    blank = lang[lang.doc_id.isin([4, 5, 6, 9])]
    assert (blank.lang_pred == "und").all() and (blank.score == 0).all() and blank.rejected.all()
    toxic = QUERIES["op4_toxicity"](spark, edge).toPandas()
    assert len(toxic) == n and toxic.score.between(0, 1).all() and toxic[toxic.doc_id.isin([4, 6])].score.nunique() == 1
    quality = QUERIES["op1_quality_classifier"](spark, edge).toPandas()
    assert len(quality) == n and quality.expected_grade.between(0, 2).all() and quality.tail_probability.between(0, 1).all()


def test_mix_meets_targets(spark):
    rows = QUERIES["op10_source_mix"](spark, BIG).toPandas()
    per = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) <= 0.001 * per.target).all()
    assert (rows.taken <= 3 * rows["size"]).all()
    assert abs(rows.groupby("source").target.first().sum() - rows["size"].sum()) < 1e-3
    again = QUERIES["op10_source_mix"](spark, BIG).toPandas()
    assert differences(rows, again) == ""

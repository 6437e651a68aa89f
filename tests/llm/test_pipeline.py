import public_tokenizers
import pyarrow.parquet as pq

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_llm_operators import similar_groups
from tidemark.llm import byte_bpe, mixing
from tidemark.llm.common import staged


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas().set_index("doc_id")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, SF))
        assert docs.columns == columns and docs.schema == before.schema
        seen[name] = (before.toPandas(), docs.toPandas())
    before, after = seen["language"]
    assert len(after) >= 0.99 * len(before)
    before, after = seen["quality"]
    good = labels.quality.reindex(before.doc_id).to_numpy()
    stays = before.doc_id.isin(after.doc_id).to_numpy()
    assert stays[good == 1].mean() > 0.97 and stays[good == 0].mean() < 0.35
    before, after = seen["near_dedup"]
    first = before.sort_values("doc_id")
    assert sorted(after.doc_id) == sorted(set(first.doc_id.to_numpy()[similar_groups(first.text)]))
    before, after = seen["mixing"]
    plan = mixing.mixed(spark.createDataFrame(before)).toPandas()
    copies = plan.set_index("doc_id").copies
    assert after.doc_id.value_counts().sort_index().to_dict() == copies[copies > 0].sort_index().to_dict()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    encoding = byte_bpe.open_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = dict(zip(after.doc_id, after.text, strict=True))
    rows = ids.collect()
    assert len(rows) == len(after) and all(list(r["ids"]) == encoding.encode_ordinary(text[r["doc_id"]]) for r in rows)


def test_odd_rows_and_empty_tables(spark, edge, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, edge))
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, edge).columns == ["doc_id", "ids"]

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def documents(rows):
    ids, texts, langs, sources = zip(*rows, strict=True) if rows else ((), (), (), ())
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}
    columns = dict(zip(kinds, (ids, texts, langs, sources), strict=True))
    table = {k: pa.array(columns[k], kinds[k]) for k in kinds}
    table["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
    for extra in ("score", "ids", "fp", "copies", "size", "rest", "h", "held_out", "component_id"):  # names the operators use
        table[extra] = pa.array([f"{extra} {i % 2}" for i in range(len(ids))], pa.string())
    return pa.table(table)


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    """Tables with NULLs in every column, empty and very long texts, ties, repeated rows and columns of clashing names."""
    rng = random.Random(4)
    words = ["the", "and", "Haus", "árbol", "niño", "weiß", "été", "worthless", "x.", "42", "%%%", "SHOUT!!"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same, long = prose(60), prose(60_000)
    rows = [
        (1, same, "en", "a"), (2, same, "en", "a"), (2, same, "en", "a"), (3, same + " end", None, "b"), (None, same, "en", None),
        (None, None, None, None), (4, "", "en", "a"), (5, " \t\n\x0b", "de", "b"), (6, None, "fr", "a"), (7, long, "en", "b"),
        (8, long + " x", "en", "b"), (9, "1234 !!! ---", "en", "c"), (10, "word", "de", "c"), (11, "a\nb\na\n\nb\n a", "en", None),
        (12, "x " * 5000, "fr", "c"), (13, " " * 9000 + "y" + "\n" * 9000, "de", "a"), (14, "日本語 の 文 章", "ja", "d"),
        (15, "y" * 40_000, "en", "d"), (16, "A B C D E F G H I J " * 3, "en", "d"), (None, "other text without an id", "en", "d"),
    ] + [(100 + i, prose(rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "zz", None])) for i in range(60)]
    rows += [(7, long, "en", "b"), (101, "another text under a known id", "en", "a")]
    path = tmp_path_factory.mktemp("edge")
    write = lambda table, name: pq.write_table(table, path / f"{name}.parquet")
    write(documents(rows), "documents")
    write(pa.table({
        "doc_id": pa.array([1, 1, 2, 3, None, 5, 7, 100, 101, 102, 103, 104, 999], pa.int64()),
        "quality": pa.array([1, 1, 1, 0, 1, None, 1, 1, 0, 1, 0, 1, 1], pa.int32()),
        "toxic": pa.array([0, 0, 1, 1, 0, 0, None, 1, 0, 0, 1, 0, 0], pa.int32()),
        "text": pa.array(["label"] * 13),
    }), "labels")
    vectors = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(200)]
    vectors[3], vectors[5], vectors[7], vectors[9] = None, [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5
    vectors[20], vectors[40], vectors[41], vectors[42] = [0.0] * 6, vectors[60], vectors[60], vectors[60]
    write(pa.table({
        "vec_id": pa.array([*range(199), None], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())),
        "label": pa.array([None] * 200, pa.int32()), "v": pa.array(["v"] * 200), "score": pa.array([1] * 200),
    }), "embeddings")
    big = "<p>" + "ä" * 400_000 + "</p>"
    pages = [
        (1, "http://a/ b?x=1\r\ny", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
        (7, "u", "n" * 100), (8, "u", "n" * 100), (8, "u", "n" * 100), (None, "u", "n" * 100), (9, "u", "n" * 99), (10, "u", "n" * 99),
        (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (12, "ü", "z" * 101), (None, "u", "only without an id " * 10),
    ]
    write(pa.table({
        "page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages]),
        "html": pa.array([p[2] for p in pages]), "payload": pa.array(["clash"] * len(pages)), "first": pa.array([1] * len(pages)),
    }), "pages")
    said = lambda conv, n, words=("hi", "ok", "né", ""): [
        (conv, t, rng.choice(["user", "assistant"]), rng.choice(words)) for t in range(n)]
    turns = [(c, t, r, x) for c in range(100, 130) for _, t, r, x in said(c, rng.randint(1, 9))]
    turns += said(0, 3) + said(1, 1) + said(2, 6) + said(-3, 4) + said(-5, 5) + said(66, 1) + said(91, 700, ("a", "b")) + said(None, 3)
    turns += [(c, t, "user", "the same") for c in range(200, 260) for t in range(3)]  # equal conversations
    turns += [(300, None, "user", "first"), (300, None, "user", "also"), (300, 2, None, "x"), (300, 2, "user", None), (300, 2, None, "x")]
    turns += [(305, 1, "user", "the 1:x"), (306, 1, "usert", "he 1:x")]
    rng.shuffle(turns)
    write(pa.table({
        "conv_id": pa.array([t[0] for t in turns], pa.int64()), "turn": pa.array([t[1] for t in turns], pa.int64()),
        "role": pa.array([t[2] for t in turns], pa.string()), "text": pa.array([t[3] for t in turns], pa.string()),
        "family": pa.array(["clash"] * len(turns)), "depth": pa.array([1] * len(turns)), "n": pa.array([2] * len(turns)),
    }), "conversations")
    return str(path)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    tables = {
        "documents": documents([]),
        "labels": pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}),
        "embeddings": pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))}),
        "pages": pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}),
        "conversations": pa.table({
            "conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())}),
    }
    for name, table in tables.items():
        pq.write_table(table, path / f"{name}.parquet")
    return str(path)

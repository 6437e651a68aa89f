"""Byte-level BPE: text to token ids and back to bytes, with a local rank file and the tiktoken library.

Long texts are cut before white space that follows a letter or number of any script. No match of the split pattern reaches over
such a place (only white-space matches hold white space after their first character, and what they look ahead at is never
the cut), so the parts' ids joined are the ids of the whole text; a text without such a place stays whole.

Defined cases: a NULL or empty text has no ids; repeated rows each give a row; other columns than the id are left out;
an empty table gives an empty result. Special tokens are never produced, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, through_arrow

#: Characters of a text given to the library at once.
LONG = 1 << 16
#: White space of the split pattern, fixed by Unicode's property of that name.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{4096,}}")
_CUT = re.compile(r"[^\W_](?=[ \n])")


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """The text in parts of at least `size` characters that the split pattern never joins."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def open_encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoding, text: str, size: int = LONG) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    done = 0
    for run in _RUN.finditer(text):
        for part in parts(text[done : run.start()], size):
            out += encoding.encode_ordinary(part)
        # the pattern gives all of a run but its last character to one match, or all of it at the text's end; the library
        # overflows its stack on such a run, so the match is handed over without the pattern
        done = run.end() - (run.end() < len(text))
        out += encoding._encode_single_piece(text[run.start() : done])
    for part in parts(text[done:], size):
        out += encoding.encode_ordinary(part)
    return out


def encode(docs: DataFrame, rank_path: str, pattern: str, packed: bool = False, size: int = LONG) -> DataFrame:
    """doc_id and `ids`: array<int>, or with `packed` a binary of little-endian unsigned 32-bit integers."""

    def start():
        import numpy as np

        encoding = open_encoding(rank_path, pattern)

        def compute(texts: pa.Array) -> list[pa.Array]:
            rows = [ids_of(encoding, t or "", size) for t in texts.to_pylist()]
            if packed:
                return [pa.array([np.asarray(r, "<u4").tobytes() for r in rows], pa.binary())]
            return [pa.array(rows, pa.list_(pa.int32()))]

        return compute

    return through_arrow(docs, ["doc_id"], f"ids {'binary' if packed else 'array<int>'}", start)


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The columns of `encode`'s result and `decoded`, the raw bytes of the ids (not always whole characters)."""
    packed = encoded.schema["ids"].dataType.simpleString() == "binary"

    def run(batches):
        import numpy as np

        encoding = open_encoding(rank_path, pattern)
        for batch in batches:
            for part in slices(batch):
                rows = part.column(1).to_pylist()
                ids = [np.frombuffer(r, "<u4").tolist() for r in rows] if packed else [r or [] for r in rows]
                raw = pa.array([encoding.decode_bytes(r) for r in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["ids"].dataType.simpleString()
    doc_id = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {doc_id}, ids {kind}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 in lower-case hex of the packed ids and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Token counts by a sentencepiece model, with overlap resynchronisation for huge documents.

A text longer than `chunk` characters is encoded in overlapping chunks with the tokens' offsets. Two neighbours are spliced
inside their overlap at a token boundary both have and that is proven stable: a space after another character. The proof
is made once from the vocabulary (`proven`): no piece holds a space mark after another character, so no merge ever joins
the two sides and each side's tokens are those of the whole text. If the overlap has no such boundary it is doubled, and
when it reaches the last splice the chunk itself grows, in the end to the whole text.

Shorter texts fall into the same stable segments; each distinct segment of at most 64 characters is encoded once per task and remembered. A model
without the proof has every text encoded whole.

Defined cases: a NULL or empty text has 0 tokens; repeated rows each give a row; other columns are left out; an empty table
gives an empty result; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import through_arrow

CHUNK = 1 << 14
OVERLAP = 1 << 8
#: Remembered segments per task, and characters of one; beyond the number the memory starts anew, longer ones are not remembered.
REMEMBERED, SHORT = 300_000, 64
MARK = "▁"


def proven(processor) -> bool:
    """True if tokens never join a space to a character before it, and a line feed stands alone, in this model.

    Holds when no piece has the mark after another character, no longer piece has a line feed, the normaliser keeps texts
    but for the mark in front, and unknown characters become bytes (they would be joined otherwise).
    """
    vocabulary = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    probe = " a  b\n\tc ﬁ Éé　z "
    return (
        not any(MARK in piece.lstrip(MARK) for piece in vocabulary)
        and not any("\n" in piece for piece in vocabulary)
        and "<0x0A>" in vocabulary
        and MARK in vocabulary
        and processor.normalize(probe) == (" " + probe).replace(" ", MARK)
    )


def offsets(processor, text: str) -> list[int]:
    """Where the tokens of `text` end, in characters. A character's bytes all end behind it."""
    ends, at, done = [], 0, 0
    raw = text.encode()
    for piece in processor.encode(text, return_type="proto").pieces:
        if piece.end > done:
            at += len(raw[done : piece.end].decode())
            done = piece.end
        ends.append(at)
    return ends


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] == " " and text[at - 1] not in (" ", MARK)


def count_long(processor, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text that `proven` models encode chunk by chunk."""
    total, splice = 0, -1  # tokens up to the last splice, and its place
    start, end = 0, min(chunk, len(text))
    ends = offsets(processor, text[:end])
    while end < len(text):
        shared, cut = overlap, None
        while cut is None and end - shared > splice:
            nxt = end - shared
            if any(stable(text, at) for at in range(nxt + 1, end)):
                stop = min(len(text), nxt + chunk + shared)
                later = offsets(processor, text[nxt:stop])
                mine = {start + e for e in ends}
                common = [nxt + e for e in later if nxt + e <= end and nxt + e in mine and stable(text, nxt + e)]
                cut = common[len(common) // 2] if common else None
            shared *= 2
        if cut is not None:
            total += sum(splice < start + e <= cut for e in ends)
            splice, start, end, ends = cut, nxt, stop, later
        else:  # no stable boundary after the last splice: take it up again twice as long; its space becomes the mark in front
            end = min(len(text), end + max(chunk, end - splice))
            start = splice + 1
            ends = offsets(processor, text[start:end])
    return total + sum(splice < start + e for e in ends)


class Counter:
    """Counts the tokens of texts; one per task."""

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import re

        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.proven, self.chunk, self.overlap = proven(self.processor), chunk, overlap
        self.segments = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Tokens of a segment that stands behind a space mark; a line feed in front of it replaces the mark."""
        n = len(self.processor.encode(text)) - text.startswith("\n")
        if len(text) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.proven:
            return len(self.processor.encode(text))
        if len(text) > self.chunk:
            return count_long(self.processor, text, self.chunk, self.overlap)
        known, segment = self.known, self.segment
        total = 0
        marked = text.replace("\n", " \n").split(" ")
        if "" in marked or MARK in text:  # runs of spaces
            for run in self.segments.findall(" " + text):
                rest = run[1:]
                total += (known.get(rest) or segment(rest)) if rest and rest[0] != "\n" else self.bare(rest)
            return total
        for rest in marked:
            total += known.get(rest) or segment(rest)
        return total

    def bare(self, rest: str) -> int:
        """Tokens of the mark and `rest`, which is empty or starts with a line feed."""
        return len(self.processor.encode(rest)) if rest else 1


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text."""

    def start():
        counter = Counter(model_path, chunk, overlap)

        def compute(texts: pa.Array) -> list[pa.Array]:
            counts = pa.array([counter.count(t or "") for t in texts.to_pylist()], pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts).cast(pa.int64()), 0)
            return [sizes, counts, pc.greater(counts, limit)]

        return compute

    return through_arrow(docs, ["doc_id"], "n_bytes bigint, n_tokens bigint, over_limit boolean", start)

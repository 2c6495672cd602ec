"""Token counts of whole texts, huge ones by overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelmesh.llm.tokens import once, publish, texts_of, vocabulary

SPACE = "\u2581"
#: Characters of a chunk, and by how many neighbours first overlap.
CHUNK, OVERLAP = 32_768, 256


class PieceBpe:
    """Counts with a sentencepiece BPE model.

    Merging can join two neighbouring characters only if some piece holds them side by side. Between any other two the
    whole text's encoding has a token boundary, and what stands left and right of it does not influence the other side.
    Such a position inside the overlap of two chunks, where both encodings also show a boundary, is where they are
    spliced: ids before it come from the left chunk, ids after it from the right one. An overlap without such a
    position is doubled until it has one or the chunk reaches the end of the text.
    """

    def __init__(self, blob: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=blob)
        self.inner = {
            piece[i:i + 2]
            for n in range(self.model.get_piece_size())
            if not (self.model.is_control(n) or self.model.is_unknown(n) or self.model.is_byte(n))
            for piece in [self.model.id_to_piece(n)]
            for i in range(len(piece) - 1)
        }

    def count_many(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def stable(self, text: str, at: int) -> bool:
        """No piece can cover the characters on both sides of ``at``."""
        return text[at - 1:at + 1].replace(" ", SPACE) not in self.inner

    def _spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces = self.model.encode(text, return_type="proto").pieces
        return tuple(np.array(x, dtype=np.int64) for x in zip(*((p.id, p.begin, p.end) for p in pieces)))

    @staticmethod
    def _cut(spans, byte: int) -> int | None:
        """Number of tokens before a byte offset, or nothing if a token runs across it."""
        _, begin, end = spans
        inside = (begin < byte) & (end > byte)
        return None if inside.any() else int(np.searchsorted(begin, byte, "left"))

    def splice(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
        """The ids of the whole text, chunk by chunk."""
        start, skip, spans, stop = 0, 0, None, min(len(text), chunk)
        while True:
            if spans is None:
                spans = self._spans(text[start:stop])
            if stop == len(text):
                yield spans[0][skip:]
                return
            joined, width = None, overlap
            while joined is None and width < stop - start:
                after = stop - width
                reach = min(len(text), after + max(chunk, 2 * width))
                right = self._spans(text[after:reach])
                for at in range(after + width // 2, stop):
                    if self.stable(text, at):
                        left_tokens = self._cut(spans, len(text[start:at].encode()))
                        right_tokens = self._cut(right, len(text[after:at].encode()))
                        if left_tokens is not None and right_tokens is not None and left_tokens >= skip:
                            joined = (left_tokens, right_tokens, after, reach, right)
                            break
                width *= 2
            if joined is None:  # no common boundary anywhere in this chunk: take a longer one
                stop, spans = min(len(text), start + 2 * (stop - start)), None
                continue
            left_tokens, right_tokens, after, reach, right = joined
            yield spans[0][skip:left_tokens]
            start, stop, skip, spans = after, reach, right_tokens, right

    def counts(self, texts: Iterator[str], chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
        """(bytes, tokens) of every text, short texts in calls of about one chunk."""
        waiting: list[str] = []
        size = 0

        def flush():
            for text, tokens in zip(waiting, self.count_many(waiting) if waiting else []):
                yield len(text.encode()), tokens

        for text in texts:
            if len(text) > chunk:
                yield from flush()
                waiting, size = [], 0
                yield len(text.encode()), sum(len(ids) for ids in self.splice(text, chunk, overlap))
                continue
            waiting.append(text)
            size += len(text)
            if size > 8 * chunk:
                yield from flush()
                waiting, size = [], 0
        yield from flush()


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: key, ``n_bytes``, ``n_tokens`` of the whole text and ``over_limit``.

    No shuffle; a text is in memory once with one chunk's tokens. Null and empty texts count 0, repeated rows and
    null keys are counted row by row, other columns are not read, an empty table gives no rows.
    """
    model = publish(docs.sparkSession, path or vocabulary("piece_bpe_32k.model"))

    def run(batches):
        bpe = once(PieceBpe, model.value)
        for batch in batches:
            found = list(bpe.counts(texts_of(batch.column(1)), chunk, overlap))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b for b, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()),
                 pa.array([n > limit for _, n in found], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(key, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([kept.schema[key]]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return kept.mapInArrow(run, schema)

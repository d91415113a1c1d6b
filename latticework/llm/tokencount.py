"""Token counts of a sentencepiece model; huge documents go through overlapping chunks.

A huge document is encoded chunk by chunk, each chunk overlapping the one before. The two
encodings are spliced at a boundary that both have and that is proven stable; when the overlap
holds none it is widened until one is found or the document ends.

The proof: a boundary before a space that follows a non-space is stable when no piece of the
vocabulary holds a space after a non-space, since then no merge can cross it, whatever
stands on either side. The model file is checked for that when it is loaded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

SPACE = "▁"  # fixed value: the letter for a space in sentencepiece vocabularies


class Counter:
    """Counts tokens with one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.width = np.array([1 if sp.is_byte(k) else len(s.replace(SPACE, " ").encode()) for k, s in enumerate(names)], np.int64)
        self.provable = not any(SPACE in s.lstrip(SPACE) for s in names)
        probe = "ab  c"
        #: one leading space is added, nothing else is changed or dropped
        self.plain = self.provable and sp.decode(sp.encode(probe)) == probe and sp.encode(probe + " ") != sp.encode(probe)

    def _borders(self, raw: bytes, start: int, end: int) -> np.ndarray:
        """Byte offsets of the token borders of raw[start:end]; the added space lies before start."""
        ids = self.sp.encode(raw[start:end].decode())
        return start - 1 + np.concatenate([[0], np.cumsum(self.width[np.array(ids, np.int64)])])

    @staticmethod
    def _letter(raw: bytes, at: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def _stable(self, raw: bytes, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        """A border of both encodings inside (low, high) before a space that follows a non-space."""
        both = np.intersect1d(left[(left > low) & (left < high)], right[(right > low) & (right < high)])
        good = [p for p in both.tolist() if raw[p] == 32 and raw[p - 1] != 32]
        return good[len(good) // 2] if good else None

    def huge(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of one text by overlapping chunks of ``chunk`` bytes."""
        raw = text.replace(SPACE, " ").encode()
        n, total, start, end, begin = len(raw), 0, 0, 0, -1
        end = self._letter(raw, min(n, chunk))
        left = self._borders(raw, start, end)
        while end < n:
            wide = overlap
            while True:
                second = self._letter(raw, max(start, end - wide))
                if second <= start:  # the whole chunk overlaps: encode more at once
                    end = self._letter(raw, min(n, end + 2 * (end - start)))
                    left = self._borders(raw, start, end)
                    if end == n:
                        return total + int((left > begin).sum())
                    wide = overlap
                    continue
                stop = self._letter(raw, min(n, end + chunk - overlap))
                right = self._borders(raw, second, stop)
                at = self._stable(raw, left, right, max(second, begin), end)
                if at is not None:
                    break
                wide *= 2
            total += int(((left > begin) & (left <= at)).sum())
            begin, start, end, left = at, second, stop, right
        return total + int((left > begin).sum())

    def count(self, texts_: list[str], chunk: int, overlap: int) -> list[int]:
        small = [k for k, t in enumerate(texts_) if len(t) <= chunk or not self.plain]
        out = [0] * len(texts_)
        for k, ids in zip(small, self.sp.encode([texts_[k] for k in small], num_threads=1), strict=True):
            out[k] = len(ids)
        for k in set(range(len(texts_))) - set(small):
            out[k] = self.huge(texts_[k], chunk, overlap)
        return out


@lru_cache(maxsize=2)
def model(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, chunk: int = 8192, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text under the sentencepiece model at ``path``.

    Rows: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``); one per input row,
    repeated rows included. A null or empty text has 0 bytes and 0 tokens. Texts of more than
    ``chunk`` characters are counted by overlapping chunks; where the model changes its input or
    gives no proof of stable borders they are encoded whole. Other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        counter = model(path)
        for part in pieces(batches):
            found = counter.count(part.column("text").to_pylist(), chunk, overlap)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("n_bytes").cast(pa.int64()), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)

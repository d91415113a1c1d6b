"""Byte-level BPE, encoded exactly by dynamic programming over prefixes, and decoded.

For every prefix of a word at most one token can end its encoding. An automaton over the
vocabulary lists the tokens that are suffixes of the prefix, longest first; the first one that
is compatible with the last token of the prefix it leaves is that unique token. Back-pointers
from the full word give the ids. Work is linear in the word, also for words of many kilobytes.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, texts

# The published byte-level word pattern, and the bytes that stand for themselves in vocabulary files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [(33, 126), (161, 172), (174, 255)]

# Most characters of a word that is held, most answers about neighbouring tokens that are, and bytes of text encoded at a time.
LONG, MOST_PAIRS, PIECE = 1024, 1 << 17, 1 << 22

SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded string"


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte."""
    plain = [b for low, high in PLAIN_BYTES for b in range(low, high + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words(dict):
    """Packed ids of the words met last: two generations that hold ``most`` words and 16 times as many characters together.

    A full generation becomes the old one, and words of the old one that are met again go on to the next. So what a worker holds does not grow with the
    texts that it has seen. Words of over LONG characters are not held.
    """

    def __init__(self, bpe: PrefixBpe, most: int):
        super().__init__()
        self.bpe, self.most, self.chars, self.old = bpe, max(1, most // 2), 0, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            raw = self.bpe.encode_word(word.encode())
            out = struct.pack(f"<{len(raw)}I", *raw)
        if len(word) > LONG:
            return out
        if len(self) >= self.most or self.chars >= 16 * self.most:
            self.old, self.chars = dict(self), 0
            self.clear()
        self[word] = out
        self.chars += len(word)
        return out


class PrefixBpe:
    """Encoder and decoder of one vocabulary file.

    Tokens are numbered by age inside (bytes first, then merges in order), since the
    compatibility test compares ages; ids of the file come out.
    """

    def __init__(self, path: str, max_words: int = 1 << 19):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        singles = [s for s in letters if s in vocab]
        names = singles + [a + b for a, b in merges]
        age = {s: k for k, s in enumerate(names)}
        self.n_single = len(singles)
        self.parts = [(k, k) for k in range(self.n_single)] + [(age[a], age[b]) for a, b in merges]
        self.joined = {a << 32 | b: k for k, (a, b) in enumerate(self.parts) if k >= self.n_single}
        self.spelled = [bytes(letters[c] for c in s) for s in names]
        self.ids = [vocab[s] for s in names]
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.bytes_of = {i: s for i, s in zip(self.ids, self.spelled, strict=True)} | {t["id"]: t["content"].encode() for t in added}
        self.find = regex.compile(WORD_PATTERN).findall
        self.known, self.pairs, self.whole, self.endings = Words(self, max_words), {}, {}, {}
        self._automaton()

    def _automaton(self) -> None:
        """States are the prefixes of tokens; a state knows the tokens that are its suffixes, longest first."""
        step, word, depth_order = {}, [-1], []
        for k, s in enumerate(self.spelled):
            at = 0
            for b in s:
                key = at << 8 | b
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(word)
                    word.append(-1)
                    depth_order.append((at, b, nxt))
                at = nxt
            word[at] = k
        children: list[list[tuple[int, int]]] = [[] for _ in word]
        for at, b, nxt in depth_order:
            children[at].append((b, nxt))
        back, shorter = [0] * len(word), [0] * len(word)
        queue = [0]
        for at in queue:
            for b, nxt in children[at]:
                queue.append(nxt)
                if at:
                    f = back[at]
                    while f and (f << 8 | b) not in step:
                        f = back[f]
                    back[nxt] = step.get(f << 8 | b, 0)
                f = back[nxt]
                shorter[nxt] = f if word[f] >= 0 else shorter[f]
        self.step, self.word, self.back, self.shorter = step, word, back, shorter

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a and b apart when their bytes stand side by side.

        Undoes merges on either side of the border, youngest first; a merge across the border
        that is older than the ones undone so far would have happened before them.
        """
        bound = 1 << 40
        while True:
            across = self.joined.get(a << 32 | b)
            if across is not None and across < bound:
                return False
            if a > b:
                if a < self.n_single:
                    return True
                bound, a = a, self.parts[a][1]
            else:
                if b < self.n_single:
                    return True
                # of two equal merges the left one comes first
                bound, b = b + 1, self.parts[b][0]

    def _own(self, k: int) -> bool:
        """Whether the bytes of token k are encoded as k itself."""
        if k < self.n_single:
            return True
        a, b = self.parts[k]
        if not (self._own_memo(a) and self._own_memo(b)):
            return False
        # k's two halves stay whole until the merge that joins them, so no older merge may cross
        bound = k
        while True:
            across = self.joined.get(a << 32 | b)
            if across is not None and across < bound:
                return False
            if max(a, b) < self.n_single:
                return True
            if a > b:
                bound, a = a, self.parts[a][1]
            else:
                bound, b = b + 1, self.parts[b][0]

    def _own_memo(self, k: int) -> bool:
        found = self.whole.get(k)
        if found is None:
            found = self.whole[k] = self._own(k)
        return found

    def _suffixes(self, at: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that end in state ``at``, longest first; only those that encode to themselves."""
        out, s = [], at if self.word[at] >= 0 else self.shorter[at]
        while s:
            if self._own_memo(self.word[s]):
                out.append((self.word[s], len(self.spelled[self.word[s]])))
            s = self.shorter[s]
        self.endings[at] = found = tuple(out)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, from the unique last token of each prefix."""
        step, back, pairs, endings, last, at, done = self.step, self.back, self.pairs, self.endings, [], 0, 0
        for b in word:
            nxt = step.get(at << 8 | b)
            while nxt is None:
                if not at:
                    raise ValueError(f"byte {b} is not in the vocabulary")
                at = back[at]
                nxt = step.get(at << 8 | b)
            at = nxt
            done += 1
            for token, width in endings.get(at) or self._suffixes(at):
                if width == done:
                    break
                key = last[done - width - 1] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= MOST_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(key >> 32, token)
                if fits:
                    break
            last.append(token)
        out, ids, spelled = [], self.ids, self.spelled
        while done:
            token = last[done - 1]
            out.append(ids[token])
            done -= len(spelled[token])
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """All ids of ``text``, as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(a in text for a in self.added):
            return self._packed(text)
        return b"".join(self.added[part] if part in self.added else self._packed(part) for part in self.cut.split(text))

    def _packed(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text with the vocabulary file at ``path`` and decode the ids again.

    Rows: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded. One row per
    input row, repeated rows and ids included; a null or empty text has no tokens. Special
    strings of the file inside a text become their ids, as the file's own library does. Equal texts
    of a batch are encoded once; very long ones are a batch of their own. Other columns are not read. The file must be at ``path`` on every executor.
    """

    def run(batches: Iterator) -> Iterator:
        bpe = model(path)
        for part in pieces(batches, n_bytes=PIECE):
            column = part.column("text").to_pylist()
            known = {t: bpe.encode(t) for t in set(column)}
            plain = {t: bpe.decode(x) for t, x in known.items()}
            ids = [known[t] for t in column]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([plain[t] for t in column], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return texts(df, id_col, text_col).mapInArrow(run, SCHEMA)

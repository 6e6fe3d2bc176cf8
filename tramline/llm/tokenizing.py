"""Cached encoding of whole texts with a public tokenizer file, inside Python workers."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .shared import kept, spans_of_rows, text_buffer

#: Words that a worker keeps encoded (about 150 bytes each), and bytes of text encoded at a time.
CACHE_WORDS, CHUNK_BYTES = 600_000, 1 << 20


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    Exact for tokenizers whose normaliser and pre-tokeniser never look across ASCII white space, drop that white space
    and ignore ASCII case, such as ``word_bpe_49k.json``; a text with a special token's opening is not lower-cased first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None  # for words that normalising leaves as they are
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.at, self.n, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.rows = self.used = 0

    def _put(self, ids: np.ndarray, n: np.ndarray) -> None:
        """Rows of ids behind those that are there."""
        need, total = self.rows + len(n), self.used + len(ids)
        while need > len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.at[self.rows : need], self.n[self.rows : need] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : total] = ids
        self.rows, self.used = need, total

    def _add(self, words: list[bytes], tokenizer) -> None:
        """Encode words in one call."""
        if words:
            e = tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
            self._put(np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words)))

    def _gather(self, rows: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, ``gap`` free places behind each, and the number of ids of each."""
        n = self.n[rows]
        before = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(before, n)
        out = np.zeros(int(n.sum()) + gap * len(n), np.uint32)
        out[np.repeat(before + gap * np.arange(len(n)), n) + step] = self.flat[np.repeat(self.at[rows], n) + step]
        return out, n

    def _learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Rows of words that aren't known yet.  A letter before a last comma or stop ends a piece, so such a word is
        its stem and one sign, and the stem often is known."""
        known, fresh, stems, signs, signed = self.place, {}, [], [], []
        for w in words:
            if len(w) > 1 and w[-1] in b",." and 97 <= w[-2] <= 122:
                stems.append(w[:-1])
                signs.append(w[-1:])
                signed.append(w)
            else:
                fresh[w] = 0
        for w in (*stems, *signs):
            if w not in known:
                fresh[w] = 0
        plain = [w for w in fresh if w.isascii() and w == w.lower()]
        other = [w for w in fresh if not (w.isascii() and w == w.lower())]
        for k, w in enumerate(plain + other):
            fresh[w] = self.rows + k
        self._add(plain, self.plain)
        self._add(other, self.tokenizer)
        if signed:
            row = lambda w: fresh[w] if w in fresh else known[w]
            ids, n = self._gather(np.fromiter(map(row, stems), np.int64, len(stems)), gap=1)
            one = {w: self.flat[self.at[row(w)]] for w in set(signs)}
            ids[np.cumsum(n + 1) - 1] = [one[w] for w in signs]
            for k, w in enumerate(signed):
                fresh[w] = self.rows + k
            self._put(ids, n + 1)
        return fresh

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end_id``, and the number of ids of each."""
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = (t if b"<|" in t else t.lower()).split()
            counts[i] = len(own)
            words += own
        get = self.place.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        before = self.rows, self.used
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh = self._learn(list({words[i]: 0 for i in missing}))
            found[missing] = [fresh[words[i]] for i in missing]
        n = self.n[found]
        ids_before = np.concatenate([[0], np.cumsum(n)])
        word_ends = np.cumsum(counts)
        lengths = ids_before[word_ends] - ids_before[word_ends - counts]
        ids, _ = self._gather(found)
        out = np.insert(ids, np.cumsum(lengths), end_id)
        if len(missing):
            if before[0] + len(fresh) <= CACHE_WORDS:
                self.place |= fresh
            elif len(missing) > 0.3 * len(words) and before[0]:
                self.clear()  # the text has changed; what is kept no longer helps
            else:
                self.rows, self.used = before
        return out, lengths + 1


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; it outlives a task."""
    return kept(("words", path), lambda: WordEncoder(path))


def encoded_chunks(path: str, texts: pa.Array, end_id: int):
    """(first row, ids, number of ids of each row) for chunks of a batch, in order."""
    data, offsets = text_buffer(texts)
    enc = encoder(path)
    for a, b in spans_of_rows(offsets, CHUNK_BYTES):
        part = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
        yield a, *enc.encode(part, end_id)


def byte_pair_lengths(path: str, pattern: str, texts: pa.Array) -> np.ndarray:
    """Number of ids of each whole text under a byte-level BPE rank file."""

    def opened():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    enc = kept(("bytes", path, pattern), opened)
    return np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))

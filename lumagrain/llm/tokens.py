"""Subword ids of whole texts through a table of words: each distinct word is encoded once per worker.

The tokenizer file's pre-tokens never cross ASCII white space, and its normalizer maps each character alone
(NFC composes nothing across white space), so the ids of a text are those of its words, one after the other.
"""

from __future__ import annotations

import os

import numpy as np

from .common import IS_WORD, SHORT, HashTable, same_bytes, spread, utf8, word_hashes, words, worker_held

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


JOIN = 200  # words that are encoded as one text, parted by a special token, whose own id parts their ids


class WordIds:
    """Worker cache from words to their ids. At most 2**(bits - 1) words and about `pool` ids and bytes are held; when
    one is full the cache starts anew, so memory is bounded and results never depend on it. Words are found by their keys
    and, where a key is a hash, compared with the word that is held."""

    def __init__(self, path: str, bits: int = 22, pool: int = 1 << 24):
        self.encoder, self.bits, self.pool = load(path), bits, pool
        self.era, self.before_clear = 0, None  # how often the cache has started anew, and what to call before it does
        self.dtype = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        special = [(k, t.content) for k, t in sorted(self.encoder.get_added_tokens_decoder().items()) if t.special and not t.normalized]
        self.mark = special[0] if special else None
        self.clear()

    def clear(self) -> None:
        if self.before_clear:
            self.before_clear()
        self.era += 1
        self.table = HashTable(self.bits)
        self.lengths, self.starts, self.ids, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.dtype), 0, 0
        self.spelled, self.spelt_at, self.sizes, self.spelling = 0, np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint8)
        self.keys = np.zeros(1 << 16, np.uint64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after the other, and how many each word has."""
        if self.mark is None or any(self.mark[1] in t for t in texts):
            return self.flat(self.encoder, texts)
        mark, content = self.mark
        joined = [content.join(texts[k : k + JOIN]) + content for k in range(0, len(texts), JOIN)]
        flat = np.concatenate([np.array(e.ids, self.dtype) for e in self.encoder.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == mark)
        return flat[flat != mark], np.diff(ends, prepend=-1) - 1

    def flat(self, encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in encoder.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((x for ids in each for x in ids), self.dtype), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, texts: list[bytes], keys: np.ndarray) -> np.ndarray:
        """The indices of new words, one for each."""
        flat, lengths = self.encode([t.decode("utf-8", "replace") for t in texts])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        spelt = np.frombuffer(b"".join(texts), np.uint8)
        while self.n + len(texts) > len(self.lengths):
            self.lengths, self.starts, self.spelt_at, self.sizes, self.keys = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts, self.spelt_at, self.sizes, self.keys))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.spelled + len(spelt) > len(self.spelling):
            self.spelling = np.concatenate([self.spelling, np.zeros_like(self.spelling)])
        at = slice(self.n, self.n + len(texts))
        self.lengths[at], self.starts[at] = lengths, self.used + np.cumsum(lengths) - lengths
        self.sizes[at], self.spelt_at[at] = sizes, self.spelled + np.cumsum(sizes) - sizes
        self.keys[at] = keys
        self.ids[self.used : self.used + len(flat)] = flat
        self.spelling[self.spelled : self.spelled + len(spelt)] = spelt
        new = np.arange(self.n, self.n + len(texts))
        self.n, self.used, self.spelled = self.n + len(texts), self.used + len(flat), self.spelled + len(spelt)
        return new

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache's index of each word; words that it does not hold are encoded first."""

        def raw(k: np.ndarray) -> list[bytes]:
            return [data[a:b].tobytes() for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]

        at = self.table.find(hashes)
        if (at < 0).any():
            missing = np.flatnonzero(at < 0)
            keys, first = np.unique(hashes[missing], return_index=True)
            if len(keys) > self.table.room or max(self.used, self.spelled) > self.pool:
                self.clear()
                missing = np.arange(len(hashes))
                keys, first = np.unique(hashes, return_index=True)
                if len(keys) > self.table.room:  # one long text with very many words
                    self.table = HashTable(int(len(keys)).bit_length() + 2)
            self.table.add(keys, self._learn(raw(missing[first]), keys))
            at[missing] = self.table.find(hashes[missing])
        size = ends - starts
        long = np.flatnonzero(size > SHORT)
        held = at[long]
        same = self.sizes[held] == size[long]
        same[same] = same_bytes(data, starts[long[same]], self.spelling[: self.spelled], self.spelt_at[held[same]], size[long[same]])
        if not same.all():  # another word of the same key: encoded on its own
            other = long[~same]
            at[other] = self._learn(raw(other), hashes[other])
        return at

    def batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts, and the n + 1 offsets of the texts in them."""
        data, offsets = utf8(column)
        starts, ends, of = words(data, offsets, IS_WORD)
        at = self.find(word_hashes(data, starts, ends), data, starts, ends)
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.lengths[at], out=total[1:])
        return self.gather(at), total[of]

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of words by their indices, one word after the other."""
        return self.ids[spread(self.starts[at], self.lengths[at])]


def worker_cache(path: str, kind: type = WordIds) -> WordIds:
    """This worker process's cache, which outlives a task: the next task of the worker goes on with it."""
    return worker_held(f"ids:{path}:{kind.__name__}", lambda: kind(path))

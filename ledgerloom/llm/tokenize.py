"""Problem 6: the whole corpus encoded with a public byte-level BPE.

Words of a batch that the worker has not met yet are encoded together: their symbols lie in one flat array, each round finds all
adjacent pairs in the sorted pair keys by binary search, and every word merges the pair of its lowest rank. Words longer than
LONG symbols take a heap instead, so that a megabyte without white space stays near-linear.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No word crosses a single space between two other characters, so a text falls into chunks there that are encoded by themselves.
CHUNKS = r"(?<=\S) (?=\S)"
#: Where a text has none of these, a plain split at spaces finds the same chunks.
UNEVEN = r" \s|\s |\A | \Z"
CHUNK_CHARS = 40
LONG = 512
CACHE_WORDS = 300_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    shifted = {b: 256 + n for n, b in enumerate(rest)}
    return [chr(shifted.get(b, b)) for b in range(256)]


class BytePairCoder:
    """Ids of words by byte-level BPE, by the vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str = DEFAULT_TOKENIZER):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = int(max(vocab.values())) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.split = regex.compile(WORDS).findall
        self.cut_uneven, self.uneven = re.compile(CHUNKS).split, re.compile(UNEVEN).search
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[int, tuple[int, int]] | None = None

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the pair keys, or -1."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def _rounds(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """All words at once; a word that has no pair left leaves the arrays."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        out_sym, out_word = [], []
        while len(sym):
            inner = word[:-1] == word[1:]
            at = np.full(len(sym), -1)
            at[:-1][inner] = self._lookup(sym[:-1][inner] * self.width + sym[1:][inner])
            rank = np.where(at >= 0, self.ranks[at], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[first, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, first), counts)
            live = least < NONE
            if not live.all():
                out_sym.append(sym[~live])
                out_word.append(word[~live])
                sym, word, at, rank, least = sym[live], word[live], at[live], rank[live], least[live]
                if not len(sym):
                    break
            take = np.flatnonzero(rank == least)
            new_run = np.r_[True, np.diff(take) != 1]
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(take)), 0))
            take = take[(np.arange(len(take)) - start) % 2 == 0]
            sym[take] = self.made[at[take]]
            stay = np.ones(len(sym), bool)
            stay[take + 1] = False
            sym, word = sym[stay], word[stay]
        if not out_sym:
            return []
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        ids, ends = sym[order].tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def _heaped(self, word: bytes) -> tuple[int, ...]:
        """One long word: pairs wait in a heap by rank and place; a stale entry is skipped."""
        if self._pairs is None:
            self._pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made)}
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (hit := self._pairs.get(sym[i] * self.width + sym[j])):
                heapq.heappush(waiting, (hit[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = self._pairs[a * self.width + b][1]
            sym[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(s for s in sym if s >= 0)

    def learn(self, words: set[str]) -> None:
        """Encode words into the cache; it is emptied when full, and then holds these words at least."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        fresh = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        for a in range(0, len(short), 50_000):
            part = short[a : a + 50_000]
            for i, ids in zip(part, self._rounds([raw[i] for i in part])):
                self.known[fresh[i]] = ids
        for i, w in enumerate(raw):
            if len(w) > LONG:
                self.known[fresh[i]] = self._heaped(w)

    def encode_chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        split = [self.split(c) for c in chunks]
        words = set(chain.from_iterable(split))
        fresh = words - self.known.keys()
        if fresh:
            room = len(self.known) + len(fresh) <= CACHE_WORDS
            self.learn(fresh if room else words)
        get = self.known.__getitem__
        return [tuple(chain.from_iterable(map(get, words))) for words in split]

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.cut_uneven(text) if self.uneven(text) else text.split(" ")

    def pieces(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """The ids of the chunks of each text. A chunk behind the first begins with the space; short ones are cached."""
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        parts = list(map(self.cut, texts))
        missing: dict[str, None] = {}
        out = []
        for words in parts:
            ids = list(map(self.chunks.get, words[1:]))
            out.append(ids)
            if None in ids:
                missing.update((w, None) for w, x in zip(words[1:], ids) if x is None)
        firsts = self.encode_chunks([words[0] for words in parts if words])
        if missing:
            found = dict(zip(missing, self.encode_chunks([" " + w for w in missing])))
            for words, ids in zip(parts, out):
                if None in ids:
                    ids[:] = [found[w] if x is None else x for w, x in zip(words[1:], ids)]
            self.chunks.update((w, x) for w, x in found.items() if len(w) <= CHUNK_CHARS)
        first = iter(firsts)
        return [[next(first), *ids] if words else [] for words, ids in zip(parts, out)]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, its offsets)."""
        ids = [list(chain.from_iterable(x)) for x in self.pieces(texts)]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])), offsets

    def count_batch(self, texts: list[str | None]) -> list[int]:
        return [sum(map(len, x)) for x in self.pieces(texts)]


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """One coder for each file in a worker."""
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


def slices(texts: list, most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most_chars each, so that very long texts do not pile up in a worker."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most_chars:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, ids ARRAY<INT>) for each row of df; an empty and a null text have the empty list, a special token's string is plain text.

    Repeated keys and texts keep a row each; other columns are not read. No shuffle where the input has as many splits as cores.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, offsets = bpe.encode_batch(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["key", "ids"])

    pairs = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return pairs.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The columns of keep and n_tokens BIGINT, the tokens of text (0 for an empty or null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts: list[int] = []
            for a, b in slices(texts):
                counts += bpe.count_batch(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*names, "n_tokens"])

    columns: list[Column] = [F.col(c) for c in keep]
    names = list(keep)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*columns, F.col(text).alias("__text"))).mapInArrow(run, f"{kinds}, n_tokens bigint")

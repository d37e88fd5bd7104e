"""Operator 10: benchmark decontamination.

A document is contaminated by an item when some stretch of its words is
within ``floor((1 - similarity) * n)`` word edits of the item's ``n`` words
(lower case, letters and digits only). Items are taken in blocks of bounded
size; each block is compiled once and broadcast, and every document meets
every block in Arrow batches, so documents are never shuffled.

1. Count filter (loses nothing): k edits spoil at most 2k of an item's n - 1
   word pairs, so windows with fewer than n - 1 - 2k pairs of an item cannot
   match it. Pairs of more than ``COMMON`` items of a block, and of a word
   with itself, are left out on both sides of that inequality, unless an item
   has hardly any other.
2. CGK: ``repeats`` random walks embed each remaining item-sized window, or
   windows of the size of an item's pieces if it has more than ``PIECE`` words
   (k edits cannot give every piece more than its share). Where a counted pair
   stands says where its item would start, give or take k words, so words left
   out of the count shift no window. At step j the walk writes the word it
   stands on and moves on if a random bit of (repeat, j, word) says so; equal
   words keep two walks together, and after an edit they drift back into step,
   so few edits mean few differing coordinates.
3. Bit sampling: per repeat, ``samples`` coordinates of the embedding are the
   LSH key; a window is a candidate of an item counted there with the same key
   (of one of its pieces).
4. Exact verification: Sellers' edit distance of the item against the
   document around the window, ends free.

Only step 3 can miss; tests measure its recall against brute force. Items of
fewer than ``min_words`` words have no edits to spare; they are looked up as
they are, by the hash of their words, and compared word by word.

Words are runs of letters and digits, or single letters in scripts written
without spaces.

Defined cases: NULL and empty texts contain nothing, an item without a word is
found nowhere; equal items are reported under each of
their ids; repeated document rows are reported once per row; NULL document
ids are kept as NULL; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scripts written without spaces (Thai, Lao, Burmese, Khmer, Kana, Han): every letter counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")
MIX = np.uint64(0x9E3779B97F4A7C15)
FLAGS = 1 << 20  # slots of the word-pair pre-test
COMMON = 64      # items of a block a counted pair may be in
PIECE = 64       # words of a window at most


def item_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class ItemBlock:
    """Compiled items: vocabulary, word-pair filter, walks and LSH keys."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, min_words: int = 5,
                 repeats: int = 24, samples: int = 2, seed: int = 7):
        toks = [(i, item_words(t)) for i, t in items if t]
        toks = [(i, w) for i, w in toks if w]
        self.vocab: dict[str, int] = {}
        for _, w in toks:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        # short items go last: their numbers follow those of the searched ones
        toks.sort(key=lambda t: len(t[1]) < min_words)
        self.exact: dict[int, dict[int, list[int]]] = {}
        for i, (_, w) in enumerate(toks):
            if len(w) < min_words:
                s = np.array([self.vocab[x] for x in w], np.int64)
                self.exact.setdefault(len(w), {}).setdefault(int(self._rolled(s, len(w))[0]), []).append(i)
        self.short = {i: np.array([self.vocab[x] for x in w], np.int64) for i, (_, w) in enumerate(toks) if len(w) < min_words}
        self.every = [i for i, _ in toks]
        self.words = [len(w) for _, w in toks]
        toks = [t for t in toks if len(t[1]) >= min_words]
        self.ids = [i for i, _ in toks]
        self.seq = [np.array([self.vocab[x] for x in w], np.int64) for _, w in toks]
        self.sizes = sorted({len(s) for s in self.seq})
        self.edits = {n: int((1 - similarity) * n + 1e-9) for n in self.sizes}
        self.repeats, self.base = repeats, len(self.vocab) + 2
        if not self.seq:
            return
        rng = np.random.default_rng(seed)
        # pieces of equal length: one of them has at most its share of an item's edits
        cuts = [[len(s) * j // m for j in range(m + 1)] for s in self.seq for m in [-(-len(s) // PIECE)]]
        pieces = [s[a:b] for s, c in zip(self.seq, cuts) for a, b in zip(c, c[1:])]
        self.piece_ptr = np.concatenate(([0], np.cumsum([len(c) - 1 for c in cuts])))
        self.piece_at = np.array([a for c in cuts for a in c[:-1]])
        self.piece_size = np.array([len(x) for x in pieces])
        lengths = np.unique(self.piece_size).tolist()
        steps = 2 * lengths[-1]
        self.odd = rng.integers(0, 2**63, (steps, repeats), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.coords = {n: np.sort(rng.integers(0, 2 * n, (repeats, samples)), axis=1) for n in lengths}
        own = [np.unique(s[:-1] * self.base + s[1:]) for s in self.seq]
        pairs, shared = np.unique(np.concatenate(own), return_counts=True)
        frequent = pairs[shared > COMMON]
        where: dict[int, list[int]] = {}
        offsets: dict[tuple[int, int], list[int]] = {}
        need = []
        for i, s in enumerate(self.seq):
            # pairs of one word twice say little: a text may repeat it for pages
            left_out = np.isin(s[:-1] * self.base + s[1:], frequent) | (s[:-1] == s[1:])
            n, k = len(s), self.edits[len(s)]
            if n - 1 - int(left_out.sum()) - 2 * k < 1:
                left_out[:] = False  # an item of frequent pairs only: all of them count
            need.append(max(1, n - 1 - int(left_out.sum()) - 2 * k))
            for o in np.flatnonzero(~left_out).tolist():
                p = int(s[o] * self.base + s[o + 1])
                if (p, i) not in offsets:
                    where.setdefault(p, []).append(i)
                offsets.setdefault((p, i), []).append(o)
        self.need = np.array(need)
        self.length = np.array([len(s) for s in self.seq])
        self.budget = np.array([self.edits[len(s)] for s in self.seq])
        self.span = self.length + self.budget - 1
        self.pair = np.array(sorted(where), np.int64)
        per = [where[p] for p in self.pair.tolist()]
        self.ptr = np.concatenate(([0], np.cumsum([len(x) for x in per])))
        self.item = np.array([i for x in per for i in x], np.int64)
        # the places of a pair in an item, in the order of self.item
        places = [offsets[p, i] for p, x in zip(self.pair.tolist(), per) for i in x]
        self.offset_ptr = np.concatenate(([0], np.cumsum([len(x) for x in places])))
        self.offset = np.array([o for x in places for o in x], np.int64)
        self.flag = np.zeros(FLAGS, bool)
        self.flag[self._slot(self.pair)] = True
        self.key = self.keys_of(pieces)

    @staticmethod
    def _rolled(seq: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from every place."""
        h = np.zeros(max(0, len(seq) - n + 1), np.uint64)
        for j in range(n):
            h = (h + seq[j:len(seq) - n + 1 + j].astype(np.uint64) + np.uint64(1)) * MIX
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def look_up(self, seq: np.ndarray) -> dict[int, tuple[int, int]]:
        """Short items that stand in the sequence, with their first place."""
        found: dict[int, tuple[int, int]] = {}
        for n, items in self.exact.items():
            h = self._rolled(seq, n)
            for at in np.flatnonzero(np.isin(h, np.fromiter(items, np.int64, len(items)))).tolist():
                for i in items[int(h[at])]:
                    if i not in found and (seq[at:at + n] == self.short[i]).all():
                        found[i] = (0, at)
        return found

    @staticmethod
    def _slot(p: np.ndarray) -> np.ndarray:
        return (p.astype(np.uint64) * MIX >> np.uint64(44)).astype(np.int64)

    def keys_of(self, parts: list[np.ndarray]) -> np.ndarray:
        """Keys (parts x repeats) of sequences of any indexed length."""
        out = np.zeros((len(parts), self.repeats), np.uint64)
        size = np.array([len(x) for x in parts])
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            for i in range(0, len(at), 4096):
                out[at[i:i + 4096]] = self.keys(np.stack([parts[x] for x in at[i:i + 4096]]))
        return out

    def keys(self, win: np.ndarray) -> np.ndarray:
        """Sampled coordinates of the CGK embedding, hashed (windows x repeats)."""
        m, n = win.shape
        coords = self.coords[n]
        padded = np.concatenate([win, np.full((m, 1), self.base, np.int64)], axis=1)
        at = np.zeros((m, self.repeats), np.int64)
        rows = np.arange(m)[:, None]
        out = np.zeros((m, self.repeats), np.uint64)
        for j in range(int(coords.max()) + 1):
            sym = padded[rows, at].astype(np.uint64) + np.uint64(1)
            for r in np.nonzero(coords == j)[0]:  # a repeat once for each of its samples at j
                out[:, r] = (out[:, r] + sym[:, r]) * MIX
            at = np.minimum(at + (sym * self.odd[j] >> np.uint64(63)).astype(np.int64), n)
        return out

    def search(self, seq: np.ndarray) -> dict[int, tuple[int, int]]:
        """item index -> (edit distance, start word) for one long sequence."""
        found = self.look_up(seq)
        if len(seq) < 2 or not self.seq:
            return found
        pair = seq[:-1] * self.base + seq[1:]
        pos = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
        pos = pos[self.flag[self._slot(pair[pos])]]
        if not len(pos):
            return found
        at = np.searchsorted(self.pair, pair[pos])
        hit = self.pair[np.minimum(at, len(self.pair) - 1)] == pair[pos]
        pos, at = pos[hit], at[hit]
        entry, of = ranges(self.ptr[at], self.ptr[at + 1])
        item, where = self.item[entry], pos[of]
        place = item * (len(seq) + int(self.span.max()) + 1) + where
        order = np.argsort(place, kind="stable")
        place, item, where, entry = place[order], item[order], where[order], entry[order]
        # pairs of one match lie within n + k words
        dense = np.searchsorted(place, place + self.span[item]) - np.arange(len(place)) >= self.need[item]
        if not dense.any():
            return found
        for c, s in self.candidates(seq, item[dense], where[dense], entry[dense]):
            if found.get(c, (1,))[0] == 0:
                continue
            k, n = int(self.budget[c]), int(self.length[c])
            lo, hi = max(0, s - 2 * k), s + n + 3 * k
            d, end = sellers(self.seq[c], seq[lo:hi])
            if d <= k and d < found.get(c, (k + 1,))[0]:
                found[c] = (d, max(0, lo + end - n))
        return found

    def candidates(self, seq: np.ndarray, item: np.ndarray, where: np.ndarray,
                   entry: np.ndarray) -> Iterator[tuple[int, int]]:
        """Items and their start words in the document, of windows that share
        a key with the item. ``entry``: index of a counted pair of ``item`` in
        ``self.item``, seen at ``where``."""
        offset, of = ranges(self.offset_ptr[entry], self.offset_ptr[entry + 1])
        # the item would start here, but for up to k insertions or deletions in front of the pair
        front = self.sizes[-1]
        wide = len(seq) + 2 * front
        start = np.unique(item[of] * wide + where[of] - self.offset[offset] + front)
        item, start = start // wide, start % wide - front
        k = self.budget[item]
        low = start - k
        low[1:] = np.where(item[1:] == item[:-1], np.maximum(low[1:], start[:-1] + k[1:] + 1), low[1:])
        start, of = ranges(low, start + k + 1)
        item = item[of]
        hit = np.zeros(len(item), bool)
        piece, of = ranges(self.piece_ptr[item], self.piece_ptr[item + 1])
        begin = start[of] + self.piece_at[piece]
        inside = (begin > -self.piece_size[piece]) & (begin < len(seq))  # a head may be missing
        piece, begin, of = piece[inside], begin[inside], of[inside]
        size = self.piece_size[piece]
        long = np.concatenate([np.zeros(PIECE, np.int64), seq, np.zeros(PIECE, np.int64)])
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            at, back = np.unique(begin[mine], return_inverse=True)
            for i in range(0, len(at), 4096):
                keys = self.keys(long[at[i:i + 4096, None] + PIECE + np.arange(n)])
                now = (back >= i) & (back < i + 4096)
                same = (keys[back[now] - i] == self.key[piece[mine[now]]]).any(axis=1)
                hit[of[mine[now][same]]] = True
        last, until = -1, 0
        for c, s in zip(item[hit].tolist(), start[hit].tolist()):
            if c != last or s > until:  # else inside a stretch that is verified already
                last, until = c, s + int(self.budget[c])
                yield c, s


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges start[i]..stop[i] - 1, and the i of each."""
    size = stop - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[of], of


def sellers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any substring of ``text`` and
    the end of the first such substring."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    step = np.arange(n + 1)
    for i, x in enumerate(pattern.tolist()):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != x), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, items_per_block: int, **how):
    """Broadcast item blocks: by hash, about ``items_per_block`` items each
    whatever their number, so neither driver nor task holds more than one."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")) \
        .where("t is not null")
    n = max(1, -(-items.count() // items_per_block))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).sort("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(ItemBlock([(r.i, r.t) for r in rows], **how))


def _found(block: ItemBlock, text: str | None) -> dict[int, tuple[int, int]]:
    if not text or not block.every:
        return {}
    get = block.vocab.get
    return block.search(np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", items_per_block: int = 5000,
                  **how) -> DataFrame:
    """One row per document row and item found in it: ``doc_id``, ``item_id``,
    ``distance`` (word edits), ``item_words``, ``start_word``. ``how``:
    ``similarity``, ``min_words``, ``repeats``, ``samples`` of ``ItemBlock``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    names = ["doc_id", "item_id", "distance", "item_words", "start_word"]
    parts = []
    for block in _blocks(benchmark, item_id, item_text, items_per_block, **how):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            it = block.value
            for b in batches:
                out = [(i, it.every[k], d, it.words[k], s) for i, t in enumerate(b.column(1))
                       for k, (d, s) in _found(it, t.as_py()).items()]
                if out:
                    at, *cols = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at)), *[pa.array(c, pa.int64()) for c in cols]], names=names)

        parts.append(src.mapInArrow(run, ", ".join(f"{c} long" for c in names)))
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", items_per_block: int = 5000, **how) -> DataFrame:
    """The rows and columns of ``docs`` in which no item is found."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_id, item_text, items_per_block, **how):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not _found(block.value, t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

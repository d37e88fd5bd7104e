"""Operator 9: line dedup by an exact set-similarity join.

The lines of all documents are token sets (words, A-Z lower-cased). Two sets
link at Jaccard ``similarity`` or more; a line is removed when an earlier line
(by document id, then line number) has the same set or a linked one.

1. Rarity: token frequencies are counted into a sketch of ``SKETCH`` counters
   (fixed size, the only broadcast). A token's rank is (counter, hash): a
   total order that puts rare tokens first and is the same everywhere, which
   is all that exactness needs.
2. Prefixes: a line posts its rarest ``n - ceil(similarity n) + 1`` tokens with
   its size, their positions and a 128-bit parity bitmap of the set, as packed
   arrays dealt by token hash.
3. Per token, each distinct set once: pairs pass the length filter, the
   positional filter (tokens left on either side) and the bitmap filter (the
   sets differ in at least as many tokens as the bitmaps differ in bits; all
   three only drop pairs that cannot reach the threshold). What leaves the
   task are the sets that are in a pair, not the pairs.
4. One line of each such set is read once more and its tokens are sent where
   the set is in a pair; there the pairs are compared in full. A pair counts
   where its first common token is, so once, and a set leaves with its number
   of links and its earliest linked line.
5. Classes (equal sets) and links decide which lines go, per document.

A copied line is one posting per batch and one class, whatever its number; a
pair is only formed between different sets. Sets too small to be within the
threshold of a larger one (under four tokens at 0.8) only have copies and post
nothing. Words are told apart by 64-bit hashes.

Defined cases: NULL text counts as empty (no lines); lines without a word are
never removed; ties go to the smaller line number; NULL ids sort last; rows
that share an id are read as one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_BYTES, materialise

SKETCH = 1 << 18
PIECE = 1 << 15  # bytes hashed at a time: their arrays stay in the cache
NO_ID = 2**63 - 1     # a NULL id, with NO_ID_LINE added to its line numbers:
NO_ID_LINE = 1 << 30  # no text has as many lines, so a document of that id stays another one
HEAD = 4         # rarest tokens compared before whole sets are
READ = "kind string, set array<long>, doc array<long>, line array<int>, n array<long>"
POSTED = "bucket int, token array<int>, set array<long>, size array<int>, pos array<int>, low array<long>, high array<long>"

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)[np.frombuffer(LOWER_BYTES, np.uint8)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP = int(_RNG.integers(0, 2**62)) * 2 + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, np.uint64(base & (2**64 - 1)), np.uint64))))


class Hasher:
    """64-bit hashes of all words of a text buffer at once: a word's bytes,
    weighted by powers of an odd number, are the difference of two prefix
    sums (modulo 2^64), shifted back by the inverse power."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, line number) of every word; lines end at each newline."""
        hashes, lines, at, line = [], [], 0, 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            if end < len(data):  # cut at white space, further on if a word is longer
                space = np.flatnonzero(_SPACE[data[at:end]])
                while not len(space) and end < len(data):
                    end = min(len(data), end + PIECE)
                    space = np.flatnonzero(_SPACE[data[at:end]])
                if end < len(data):
                    end = at + int(space[-1]) + 1
            h, n, newlines = self._piece(data[at:end])
            hashes.append(h)
            lines.append(n + line)
            line += newlines
            at = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(lines)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        if len(self.up) < len(data):
            self.up, self.down = _powers(_STEP, len(data)), _powers(pow(_STEP, -1, 2**64), len(data))
        word = np.concatenate(([False], ~_SPACE[data], [False]))
        start = np.flatnonzero(word[1:-1] & ~word[:-2])
        end = np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * self.up[:len(data)])))
        h = _mixed((total[end] - total[start]) * self.down[start])
        newline = np.flatnonzero(data == 10)
        return h, np.searchsorted(newline, start), len(newline)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def token_sets(tok: np.ndarray, line: np.ndarray, rank: np.ndarray | None):
    """Distinct tokens per line, by rank of their slot, then hash: (tokens,
    line of each set, size, start)."""
    if rank is None:
        order = np.lexsort((tok, line)) if len(tok) and line[-1] >= 1 << 24 else \
            np.argsort((line.astype(np.uint64) << np.uint64(40)) | (tok >> np.uint64(24)))
    elif len(tok) and line[-1] >= 1 << 20:
        order = np.lexsort((tok, rank[_slot(tok)], line))
    else:  # one key: line, rank (18 bits), 26 bits of the hash that the slot leaves
        order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (rank[_slot(tok)] << np.uint64(26))
                           | ((tok >> np.uint64(20)) & np.uint64((1 << 26) - 1)))
    tok, line = tok[order], line[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (line[1:] != line[:-1])
    tok, line = tok[new], line[new]
    start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, int)
    return tok, line[start], np.diff(np.append(start, len(line))), start


def set_keys(tok: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit key of each token set, independent of the order."""
    s = np.add.reduceat(_mixed(tok + np.uint64(0x9E3779B97F4A7C15)), start) if len(start) else np.zeros(0, np.uint64)
    return _mixed(s + size.astype(np.uint64)).view(np.int64)


def bitmaps(tok: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits per set."""
    bit = np.uint64(1) << (tok & np.uint64(63))
    upper = (tok >> np.uint64(6)) & np.uint64(1) == 1
    none = np.zeros(0, np.int64)
    return tuple(np.bitwise_xor.reduceat(np.where(m, bit, np.uint64(0)), start).view(np.int64) if len(start) else none
                 for m in (~upper, upper))


def _needed(size: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def _list(parts: list[np.ndarray], kind) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))


def _chunks(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, first line numbers, lines per text, joined text) of a few megabytes
    of rows at a time."""
    ids, texts, total = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(i)
        texts.append(t.as_py() or b"")
        total += len(texts[-1])
        if total >= most:
            yield _joined(ids, texts)
            ids, texts, total = [], [], 0
    if ids:
        yield _joined(ids, texts)


def _joined(ids, texts):
    lines = np.array([t.count(b"\n") + 1 if t else 0 for t in texts], np.int64)
    base = np.array([NO_ID_LINE if i is None else 0 for i in ids], np.int64)
    return np.array([NO_ID if i is None else i for i in ids], np.int64), base, lines, np.frombuffer(b"\n".join(t for t in texts if t), np.uint8)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token frequencies, set key of every line, lines of every document."""
    hasher, freq, none = Hasher(), np.zeros(SKETCH, np.int64), np.zeros(0, np.int64)

    def packed(rows):
        kind, *cols = zip(*rows)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), *[_list(list(c), k) for c, k in zip(cols, kinds)]],
                                          names=["kind", "set", "doc", "line", "n"])

    for b in batches:
        for ids, base, lines, data in _chunks(b):
            tok, line = hasher(data)
            freq += np.bincount(_slot(tok), minlength=SKETCH)
            tok, own, size, start = token_sets(tok, line, None)
            number = np.arange(int(lines.sum())) - np.repeat(np.cumsum(lines) - lines - base, lines)
            yield packed([("doc", none, ids, base, lines),
                          ("line", set_keys(tok, size, start), np.repeat(ids, lines)[own], number[own], none)])
    at = np.flatnonzero(freq)
    yield packed([("freq", none, none, at, freq[at])])


def _post(rank, buckets: int, similarity: float):
    """Postings of the distinct sets of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = Hasher(), rank.value
        for b in batches:
            for *_, data in _chunks(b):
                tok, line = hasher(data)
                tok, _, size, start = token_sets(tok, line, order)
                key, (low, high) = set_keys(tok, size, start), bitmaps(tok, start)
                once = np.zeros(len(key), bool)
                once[np.unique(key, return_index=True)[1]] = True
                # sets too small to be within the threshold of a larger set only have copies
                able = np.flatnonzero(once & (_needed(size + 1, similarity) <= size))
                n = size[able] - _needed(size[able], similarity) + 1
                w = np.repeat(able, n)
                pos = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                t = tok[start[w] + pos]
                bucket = _bucket(t, buckets)
                by = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                cols = [(t[by] >> np.uint64(32)).astype(np.uint32).view(np.int32), key[w][by], size[w][by], pos[by],
                        low[w][by], high[w][by]]
                edge = np.append(cut[full], len(by))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), *[pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(c, k))
                     for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]],
                    names=[x.split()[0] for x in POSTED.split(", ")])
    return run


def _bucket(tok: np.ndarray, buckets: int) -> np.ndarray:
    return ((tok & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pairs(tok, size, pos, low, high, similarity: float):
    """Pairs (x, y, overlap they need) of postings, sorted by token and size,
    that share a token and pass the length, positional and bitmap filters;
    some 100,000 pairs at a time, or those of one posting."""
    if not len(tok):
        return
    start = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(tok))))
    # partners of i are i + 1 .. the last of at most size / similarity
    limit = np.floor(size / similarity + 1e-9).astype(np.int64)
    last = np.searchsorted(group * (1 << 32) + size, group * (1 << 32) + limit, side="right")
    n = last - np.arange(len(tok)) - 1
    done = np.cumsum(n)
    i = 0
    while i < len(tok):
        before = done[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(done, before + 500_000, side="right")))
        x = np.repeat(np.arange(i, j), n[i:j])
        y = x + 1 + np.arange(len(x)) - np.repeat(done[i:j] - n[i:j] - before, n[i:j])
        both = size[x] + size[y]
        overlap = np.ceil(both * similarity / (1 + similarity) - 1e-9).astype(np.int64)
        most = np.minimum(pos[x], pos[y]) + np.minimum(size[x] - pos[x], size[y] - pos[y])
        differ = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y])
        ok = (most >= overlap) & (differ <= both - 2 * overlap)
        yield x[ok], y[ok], overlap[ok]
        i = j


def _candidates(similarity: float):
    """Sets of one bucket that are in a pair."""
    def run(table: pa.Table) -> pa.Table:
        tok, key, size, pos, low, high = (np.asarray(table.column(c).combine_chunks().flatten()) for c in
                                          ("token", "set", "size", "pos", "low", "high"))
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        order = np.lexsort((key, size, tok))
        new = np.ones(len(tok), bool)
        new[1:] = (tok[order][1:] != tok[order][:-1]) | (key[order][1:] != key[order][:-1])
        tok, key, size, pos, low, high = (x[order[new]] for x in (tok, key, size, pos, low, high))
        found = [np.unique(np.concatenate([key[x], key[y]])) for x, y, _ in _pairs(tok, size, pos, low, high, similarity)]
        sets = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.table([pa.array(np.full(len(sets), table.column("bucket")[0].as_py()), pa.int32()), pa.array(sets)],
                        names=["bucket", "set"])
    return run


def _verify(buckets: int, similarity: float):
    """Links of the sets of one bucket, compared on their tokens."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        tokens = table.column("tokens").combine_chunks()
        size = np.asarray(tokens.value_lengths()).astype(np.int64)
        flat = np.asarray(tokens.flatten()).view(np.uint64)
        start = np.cumsum(size) - size
        low, high = bitmaps(flat, start)
        n = size - _needed(size, similarity) + 1
        own = np.repeat(np.arange(len(size)), n)
        pos = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        tok = flat[start[own] + pos]
        here = _bucket(tok, buckets) == bucket
        tok, own, pos = tok[here], own[here], pos[here]
        order = np.lexsort((size[own], tok))
        tok, own, pos = tok[order], own[order], pos[order]
        head = flat[start[:, None] + np.minimum(np.arange(HEAD), size[:, None] - 1)]
        first = list(zip(table.column("doc").to_pylist(), table.column("line").to_pylist()))
        sets: dict[int, frozenset] = {}
        links, near = [0] * len(size), [None] * len(size)

        def tokens_of(i: int) -> frozenset:
            if i not in sets:
                sets[i] = frozenset(flat[start[i]:start[i] + size[i]].tolist())
            return sets[i]

        for x, y, overlap in _pairs(tok, size[own], pos, low[own], high[own], similarity):
            # both sides of a pair meet in the group of every token they share;
            # most of those are told by their rarest tokens
            a, b, k, m = own[x], own[y], pos[x], pos[y]
            again = np.zeros(len(x), bool)
            for p in range(HEAD):
                for q in range(HEAD):
                    again |= (p < k) & (q < m) & (head[a, p] == head[b, q])
            for i, j, k, least in zip(a[~again].tolist(), b[~again].tolist(), k[~again].tolist(), overlap[~again].tolist()):
                other = tokens_of(j)
                if len(tokens_of(i) & other) >= least and \
                        not any(t in other for t in flat[start[i]:start[i] + k].tolist()):
                    for p, q in ((i, j), (j, i)):
                        links[p] += 1
                        near[p] = first[q] if near[p] is None else min(near[p], first[q])
        some = [i for i, c in enumerate(links) if c]
        return pa.table([table.column("set").take(pa.array(some, pa.int64())), pa.array([links[i] for i in some], pa.int64()),
                         pa.array([near[i][0] for i in some], pa.int64()), pa.array([near[i][1] for i in some], pa.int32())],
                        names=["set", "n_links", "doc", "line"])
    return run


def _fetch(rank):
    """Tokens, rarest first, of the wanted lines of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            keys, texts = [], []
            for text, want in zip(b.column(0), b.column(1).to_pylist()):
                rows = (text.as_py() or b"").split(b"\n")
                for w in want:
                    at = w["line"] % NO_ID_LINE
                    if at < len(rows):
                        keys.append(w["set"])
                        texts.append(rows[at])
            tok, line = hasher(np.frombuffer(b"\n".join(texts), np.uint8))
            tok, own, size, start = token_sets(tok, line, rank.value)
            # another row of the same id may hold the line
            same = np.array(keys, np.int64)[own] == set_keys(tok, size, start)
            if same.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.int64)[own][same]),
                     _list([x for x, ok in zip(np.split(tok.view(np.int64), start[1:]), same) if ok], pa.int64())],
                    names=["set", "tokens"])
    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
               block_rows: int = 1024) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_removed``, ``n_links``
    (linked other sets, summed over its lines), ``removed`` (line numbers,
    from 0, ascending)."""
    res = line_classes(docs, id_col, text_col, similarity, block_rows)
    per_doc = res["lines"].groupBy("doc", "none").agg(
        F.count_if("gone").alias("n_removed"), F.sum("n_links").alias("n_links"),
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"))
    return (res["docs"].groupBy("doc", "none").agg(F.sum("n_lines").alias("n_lines")).join(per_doc, ["doc", "none"], "left")
            .select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "n_lines",
                    F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
                 block_rows: int = 1024) -> dict[str, DataFrame]:
    """``docs`` (doc, none, n_lines), ``lines`` (doc, none, line, set, gone,
    n_links; ``none``: the document has no id) and ``sets`` (set, keep, n_links: those that repeat or have links)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("t"))
    read = materialise(src.mapInArrow(_read, READ), "line-sets")
    freq = np.zeros(SKETCH, np.int64)
    for r in (read.where("kind = 'freq'").select(F.explode(F.arrays_zip("line", "n")).alias("x"))
              .groupBy("x.line").agg(F.sum("x.n").alias("n")).toArrow().to_pylist()):  # at most SKETCH rows
        freq[r["line"]] = r["n"]
    rank = np.empty(SKETCH, np.uint64)
    rank[np.argsort(freq, kind="stable")] = np.arange(SKETCH, dtype=np.uint64)
    rank = docs.sparkSession.sparkContext.broadcast(rank)
    buckets = max(1, -(-docs.count() // block_rows))
    cands = materialise(src.mapInArrow(_post(rank, buckets, similarity), POSTED).groupBy("bucket")
                        .applyInArrow(_candidates(similarity), "bucket int, set long"), "line-candidates")
    lines = read.where("kind = 'line'").select(F.explode(F.arrays_zip("set", "doc", "line")).alias("x")).select("x.*")
    classes = materialise(lines.groupBy("set").agg(
        F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n")), "line-classes")

    # full tokens of one line of every set in a candidate pair
    wanted = cands.select("set").distinct().join(classes, "set")
    per_doc = wanted.groupBy(F.col("first.doc").alias("d")).agg(F.collect_list(F.struct("first.line", "set")).alias("want"))
    id_of = F.coalesce(F.col("doc"), F.lit(NO_ID))
    tokens = src.join(per_doc, id_of == F.col("d")).select("t", "want").mapInArrow(
        _fetch(rank), "set long, tokens array<long>").dropDuplicates(["set"])
    sets = materialise(tokens.join(wanted.select("set", "first.doc", "first.line"), "set"), "line-tokens")
    linked = (cands.join(sets, "set").groupBy("bucket")
              .applyInArrow(_verify(buckets, similarity), "set long, n_links long, doc long, line int")
              .groupBy("set").agg(F.min(F.struct("doc", "line")).alias("near"), F.sum("n_links").alias("n_links")))
    known = classes.join(linked, "set", "left").where("n > 1 or n_links > 0").select(
        "set", F.least("first", F.coalesce("near", "first")).alias("keep"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    judged = lines.join(known, "set", "left").select(
        "doc", (F.col("line") >= NO_ID_LINE).alias("none"), (F.col("line") % NO_ID_LINE).alias("line"), "set", F.coalesce(F.struct("doc", "line") > F.col("keep"), F.lit(False)).alias("gone"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    counts = read.where("kind = 'doc'").select(F.explode(F.arrays_zip("doc", "line", "n")).alias("x")).select(
        "x.doc", (F.col("x.line") >= NO_ID_LINE).alias("none"), F.col("x.n").alias("n_lines"))
    return {"docs": counts, "lines": judged, "sets": known}


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the removed lines cut out of the text."""
    gone = line_dedup(docs, id_col, text_col, **how).where("n_removed > 0").select(F.col("doc_id").alias("__id"), "removed")
    rows = F.split(F.col(text_col), "\n")
    kept = F.filter(rows, lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    cols = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left").select(*cols)

"""Operator 12: spelling variant grouping by a variable-length gram index.

Words are counted over whole texts; two words are near if one inserted,
deleted or replaced code point turns one into the other.

1. Gram dictionary. A word is read between two end marks. Grams of two and
   more code points that occur more often than one in ``PRUNE`` of all grams
   are frequent; a gram is extended while it is frequent, up to ``QMAX``. What
   is kept is the set of frequent grams: under ``PRUNE`` of each length by
   construction, the only part of the dictionary that travels.
2. Decomposition. Every position of a word starts one gram: the shortest that
   is not frequent. It reads its own code points only, so one edit affects
   exactly the grams over its place; the largest number of grams over one
   place is the word's bound ``affected``.
3. List merging. Two near words share all but ``affected`` grams of either, so
   one of the ``affected + 1`` rarest grams of either is common (rarity: a
   sketch of ``SLOTS`` counters, then the gram; any total order does). Only
   those are posted, under (gram, position, length): the same position for an
   equal length, the same or the next one in a word that is one longer. A list
   whose slot counts over ``list_rows`` postings is cut into blocks and dealt
   as pairs of blocks.
4. Verification. Pairs of a list pass a letter-parity bitmap (it only drops
   pairs at two edits or more) and are compared by common prefix and suffix. A
   pair counts in the first list the two words share. What leaves a task is a
   count and a best partner per word, not the pairs.
5. A word's form is its near word of largest count where that is ``ratio``
   times its own; roots follow forms by pointer jumping. Counts at least
   double along a chain, so the rounds are few (log2 of log2 of the count).

Defined cases: NULL and empty texts have no words; a NULL id reads as empty in
the hash of the damage; ties in the largest count go to the smallest word in
code-point order; very long words are compared like any other; a repeated row
counts again; an empty table gives no rows. Words hold code points up to
U+00FF only, so a code point is one byte inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, ASCII_UPPER, materialise

QMAX = 4           # longest gram; at least one gram of a word of QMAX letters survives an edit
PRUNE = 1 << 16
SLOTS = 1 << 18
WIDE = 32          # longer words are compared one pair at a time
PAIRS = 1 << 21    # pairs looked at together
START, END = b"\x01", b"\x02"
POSTED = ("bucket int, key binary, cell binary, role binary, word binary, size binary, text binary, n binary")
NEAR = "word string, n_near long, n long, near string"


def damaged(run: Column, row_id: Column, every: int) -> Column:
    """``run`` without one code point where ``every`` divides the CRC of id and run."""
    h = F.crc32(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))) \
        .otherwise(run)


def count_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int,
                every: int) -> DataFrame:
    """``word``, ``n`` of the damaged words long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), ASCII_UPPER, ASCII_LOWER),
                                F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}+"), F.lit(0))
    word = docs.select(F.col(id_col).alias("i"), F.explode(runs).alias("run")) \
        .select(damaged(F.col("run"), F.col("i"), every).alias("word"))
    return word.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


class Letters:
    """Words as one byte string with end marks; grams are integers."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.flat = np.frombuffer(b"".join(START + w + END for w in words), np.uint8)
        self.size = np.array([len(w) + 2 for w in words], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.word = np.repeat(np.arange(self.n), self.size)
        self.pos = np.arange(len(self.flat)) - self.start[self.word]
        self.left = self.size[self.word] - self.pos  # code points from here to the end mark

    def grams(self, q: int) -> np.ndarray:
        """The gram of length q at every place (meaningful where left >= q)."""
        g = np.zeros(len(self.flat), np.uint64)
        for i in range(q):
            g <<= np.uint64(8)
            g[:len(g) - i] |= self.flat[i:].astype(np.uint64)
        return g << np.uint64(3) | np.uint64(q)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = Letters([w.encode("latin-1") for w in b.column(0).to_pylist()])
        for q in range(2, QMAX):
            g, c = np.unique(t.grams(q)[t.left >= q], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(np.full(len(g), q, np.int32)),
                                              pa.array(c.astype(np.int64))], names=["gram", "q", "n"])


class Index:
    """The frequent grams and the rarity counters; decomposes words into the
    grams they post."""

    def __init__(self, frequent: dict[int, np.ndarray], rarity: np.ndarray | None = None,
                 lists: np.ndarray | None = None):
        self.frequent = {q: np.sort(g.astype(np.uint64)) for q, g in frequent.items()}
        self.rarity, self.lists = rarity, lists

    def _is_frequent(self, q: int, g: np.ndarray) -> np.ndarray:
        known = self.frequent.get(q)
        if known is None or not len(known):
            return np.zeros(len(g), bool)
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        return known[at] == g

    def decompose(self, t: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram, word, position) of every gram, and ``affected`` per word."""
        here = t.left >= 2
        gram, size = t.grams(2), np.full(len(t.flat), 2)
        for q in range(2, QMAX):
            more = here & (size == q) & (t.left > q)
            more[more] = self._is_frequent(q, gram[more])
            gram[more] = t.grams(q + 1)[more]
            size[more] = q + 1
        place = np.flatnonzero(here)
        over = np.zeros(len(t.flat) + QMAX + 1, np.int64)
        np.add.at(over, place, 1)
        np.add.at(over, place + size[place], -1)
        over = np.cumsum(over)[:len(t.flat)]
        affected = np.maximum.reduceat(over, t.start) if t.n else np.zeros(0, np.int64)
        return gram[place], t.word[place], t.pos[place], affected

    def posted(self, t: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, role, word) of every posting. Role 0 meets words of its own
        length and, as the shorter word, those of role 1."""
        gram, word, pos, affected = self.decompose(t)
        order = np.lexsort((pos, gram, self.rarity[_slot(_mixed(gram))], word))
        gram, word, pos = gram[order], word[order], pos[order]
        rank = np.arange(len(word)) - np.searchsorted(word, word)
        keep = rank <= affected[word]
        gram, word, pos = gram[keep], word[keep], pos[keep]
        size = t.size[word]

        def key(shift: int, shorter: int) -> np.ndarray:
            where = ((size - shorter).astype(np.uint64) << np.uint64(32)) | (pos - shift + 1).astype(np.uint64)
            return _mixed(_mixed(gram) ^ (where * np.uint64(0x9E3779B97F4A7C15)))

        # the same gram one place on: its shifted key is the one before's own, posted once
        again = (word[1:] == word[:-1]) & (gram[1:] == gram[:-1]) & (pos[1:] == pos[:-1] + 1)
        new = np.concatenate((np.ones(min(len(word), 1), bool), ~again))
        return (np.concatenate((key(0, 0), key(0, 1), key(1, 1)[new])),
                np.repeat(np.array([0, 1, 1], np.uint8), [len(word), len(word), int(new.sum())]),
                np.concatenate((word, word, word[new])))


def _sketch(slots) -> callable:
    """Partial counters of the slots that ``slots(words)`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            s = slots(Letters([w.encode("latin-1") for w in b.column(0).to_pylist()]))
            total += np.bincount(s, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    return run


def _summed(words: DataFrame, slots) -> np.ndarray:
    """At most SLOTS counters reach the driver."""
    got = words.mapInArrow(_sketch(slots), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def build_index(words: DataFrame) -> Index:
    counts = materialise(words.select("word").mapInArrow(gram_counts, "gram long, q int, n long")
                         .groupBy("q", "gram").agg(F.sum("n").alias("n")), "spelling-grams")
    total = dict(counts.groupBy("q").agg(F.sum("n")).collect())
    often = F.lit(False)
    for q, n in total.items():  # under PRUNE grams of each length pass
        often = often | ((F.col("q") == q) & (F.col("n") > n // PRUNE))
    rows = counts.where(often).select("q", "gram").collect()
    index = Index({q: np.array([g for k, g in rows if k == q], np.int64) for q in total})
    index.rarity = _summed(words, lambda t, index=index: _slot(_mixed(index.decompose(t)[0])))
    index.lists = _summed(words, lambda t, index=index: _slot(index.posted(t)[0]))
    return index


def _post(index: Index, buckets: int, list_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            n = b.column("n").to_numpy()
            if not words:
                continue
            t = Letters(words)
            key, role, word = index.posted(t)
            # blocks of a long list: a posting goes to every pair with its own block
            blocks = -(-index.lists[_slot(key)] // list_rows)
            mine = np.array([hash_of(w) for w in words], np.int64)[word] % np.maximum(blocks, 1)
            copies = np.maximum(blocks, 1)
            row = np.repeat(np.arange(len(key)), copies)
            other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            low, high = np.minimum(mine[row], other), np.maximum(mine[row], other)
            # side 0: both of a pair from one block; 1 and 2: one from either
            side = np.where(low == high, 0, np.where(mine[row] == low, 1, 2)).astype(np.uint8)
            key, role, word = key[row], role[row] | (side << 1), word[row]
            cell = ((low << 24) | high).astype(np.int64)
            bucket = (_mixed(key ^ (cell.astype(np.uint64) + np.uint64(1))) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            out = []
            for s, e in zip(edges, [*edges[1:], len(order)]):
                rows = order[s:e]
                used, local = np.unique(word[rows], return_inverse=True)
                out.append((int(bucket[rows[0]]), key[rows].tobytes(), cell[rows].tobytes(), role[rows].tobytes(),
                            local.astype(np.int32).tobytes(), (t.size[used] - 2).astype(np.int32).tobytes(),
                            b"".join(words[i] for i in used), n[used].astype(np.int64).tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                names=["bucket", "key", "cell", "role", "word", "size", "text", "n"])

    return run


def hash_of(word: bytes) -> int:
    return int.from_bytes(word[-8:], "little") * 0x9E3779B1 % (1 << 31)


class Words:
    """The words of a bucket, laid out for comparison."""

    def __init__(self, text: list[bytes]):
        self.text = text
        self.size = np.array([len(w) for w in text], np.int64)
        short = [w if len(w) <= WIDE else b"" for w in text]
        self.head = np.frombuffer(b"".join(w.ljust(WIDE, b"\0") for w in short), np.uint8).reshape(-1, WIDE)
        self.tail = np.frombuffer(b"".join(w.rjust(WIDE, b"\0") for w in short), np.uint8).reshape(-1, WIDE)
        flat = np.frombuffer(b"".join(text), np.uint8)
        start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        bits = np.uint64(1) << (flat & 63).astype(np.uint64)
        self.parity = np.bitwise_xor.reduceat(bits, start)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a no longer than b, by one at most) are one edit apart."""
        longer = self.size[b] - self.size[a]
        keep = np.flatnonzero(np.bitwise_count(self.parity[a] ^ self.parity[b]) <= 2 - longer)
        a, b, longer = a[keep], b[keep], longer[keep]
        first = np.argmax(np.concatenate((self.head[a] != self.head[b], np.ones((len(a), 1), bool)), 1), 1)
        last = np.argmax(np.concatenate((self.tail[a, ::-1] != self.tail[b, ::-1], np.ones((len(a), 1), bool)), 1), 1)
        yes = np.minimum(first, self.size[a]) + np.minimum(last, self.size[a]) >= self.size[b] - 1
        for i in np.flatnonzero(self.size[b] > WIDE):
            yes[i] = _one_edit(self.text[a[i]], self.text[b[i]])
        return keep[yes]


def _one_edit(x: bytes, y: bytes) -> bool:
    """x is no longer than y, and differs from it."""
    p = _common(x, y)
    return x[p + 1:] == y[p + 1:] if len(x) == len(y) else x[p:] == y[p + 1:]


def _common(x: bytes, y: bytes) -> int:
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid - 1)
    return lo


def _pairs(key: np.ndarray, cell: np.ndarray, role: np.ndarray):
    """Pairs of postings of one list, in chunks: a posting of role 0 with all
    that follow in (key, cell, role) order."""
    order = np.lexsort((role & 1, cell, key))
    k, c = key[order], cell[order]
    edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]), [True])))
    end = np.repeat(edge[1:], np.diff(edge))
    first = np.flatnonzero((role[order] & 1) == 0)
    many = end[first] - first - 1
    first, many = first[many > 0], many[many > 0]
    upto = np.concatenate(([0], np.cumsum(many)))
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        m = many[at:stop]
        x = np.repeat(first[at:stop], m)
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[at:stop] - upto[at], m)
        x, y = order[x], order[y]
        side = role >> 1
        ok = (side[x] == 0) | (side[x] != side[y])
        yield x[ok], y[ok]
        at = stop


def _link(index: Index):
    def run(table: pa.Table) -> pa.Table:
        text, n, key, cell, role, word = [], [], [], [], [], []
        for r in table.to_pylist():
            size, at = np.frombuffer(r["size"], np.int32), 0
            word.append(np.frombuffer(r["word"], np.int32).astype(np.int64) + len(text))
            for s in size:
                text.append(r["text"][at:at + s])
                at += s
            key.append(np.frombuffer(r["key"], np.uint64))
            cell.append(np.frombuffer(r["cell"], np.int64))
            role.append(np.frombuffer(r["role"], np.uint8))
            n.append(np.frombuffer(r["n"], np.int64))
        key, cell, role, word, n = (np.concatenate(x) for x in (key, cell, role, word, n))
        words = Words(text)
        got = []
        for x, y in _pairs(key, cell, role):
            a, b = word[x], word[y]
            swap = words.size[a] > words.size[b]  # a role 0 before a role 0 of its length, or a longer role 1
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            hit = words.near(a, b)
            got.append((a[hit], b[hit], key[x[hit]]))
        a, b, k = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        used, local = np.unique(np.concatenate((a, b)), return_inverse=True)
        if not len(used):
            return pa.table({c: pa.array([], t) for c, t in zip(
                ("word", "n_near", "n", "near"), (pa.string(), pa.int64(), pa.int64(), pa.string()))})
        a, b = local[:len(a)], local[len(a):]
        names = [text[i] for i in used]
        mine = _first_list(index, names, a, b, k)
        a, b = a[mine], b[mine]
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        src, dst, count = np.concatenate((a, b)), np.concatenate((b, a)), n[used]
        order = np.lexsort((rank[dst], -count[dst], src))
        src, dst = src[order], dst[order]
        head = np.flatnonzero(np.diff(src, prepend=-1))
        many = np.diff(np.append(head, len(src)))
        shown = [w.decode("latin-1") for w in names]
        return pa.table({"word": pa.array([shown[i] for i in src[head]], pa.string()), "n_near": pa.array(many, pa.int64()),
                         "n": pa.array(count[dst[head]], pa.int64()),
                         "near": pa.array([shown[i] for i in dst[head]], pa.string())})

    return run


def _first_list(index: Index, names: list[bytes], a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs (a no longer than b) have ``key`` as the smallest key they share."""
    t = Letters(names)
    k, role, word = index.posted(t)
    lists = []
    for r in (0, 1):
        keep = role == r
        kk, ww = k[keep], word[keep]
        order = np.lexsort((kk, ww))
        kk, ww = kk[order], ww[order]
        width = int(np.bincount(ww).max())
        table = np.full((len(names), width), 2**64 - 1 - r, np.uint64)  # padding never meets padding
        table[ww, np.arange(len(ww)) - np.searchsorted(ww, ww)] = kk
        lists.append(table)
    out = np.zeros(len(a), bool)
    same = t.size[a] == t.size[b]
    for s in range(0, len(a), 1 << 16):
        x, y, eq = a[s:s + (1 << 16)], b[s:s + (1 << 16)], same[s:s + (1 << 16)]
        for rows, other in ((np.flatnonzero(eq), lists[0]), (np.flatnonzero(~eq), lists[1])):
            left, right = lists[0][x[rows]], other[y[rows]]
            met = (left[:, :, None] == right[:, None, :]).any(2)
            low = np.where(met, left, np.uint64(2**64 - 1)).min(1) if len(rows) else np.zeros(0, np.uint64)
            out[s + rows] = low == key[s + rows]
    return out


def near_words(words: DataFrame, list_rows: int = 1 << 16, bucket_postings: int = 250_000) -> DataFrame:
    """Per word of ``word``, ``n`` with a near word: ``n_near`` and the near
    word of largest count (``n``, ``near``)."""
    index = build_index(words)
    buckets = int(index.lists.sum() // bucket_postings) + 1
    part = (words.select("word", "n").mapInArrow(_post(index, buckets, list_rows), POSTED)
            .groupBy("bucket").applyInArrow(_link(index), NEAR))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near")))
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")) \
        .select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of ``word``, ``form`` (NULL at the end of a chain)."""
    cur = materialise(forms.select("word", F.coalesce("form", "word").alias("root"),
                                   F.col("form").isNotNull().alias("moved")), "spelling-roots")
    while cur.where("moved").limit(1).count():
        on = cur.select(F.col("word").alias("w"), F.col("root").alias("next"))
        step = cur.join(on, cur["root"] == on["w"]).select(
            "word", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved"))
        cur = materialise(step, "spelling-roots")
    return cur.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                      min_count: int = 3, ratio: int = 2, every: int = 97, **how) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` per word of
    ``docs``; ``how``: sizes of ``near_words``."""
    if min_length < QMAX:
        raise ValueError(f"words of under {QMAX} code points can lose all their grams to one edit")
    words = materialise(count_words(docs, id_col, text_col, min_length, min_count, every), "spelling-words")
    near = near_words(words, **how).withColumnRenamed("word", "w")
    takes = F.col("near_n") >= ratio * F.col("n")
    found = materialise(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", F.when(takes, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("near_n")).alias("form_n")), "spelling-forms")
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")

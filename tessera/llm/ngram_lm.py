"""Operator 7: language-model scores by a weighted backoff automaton.

Documents are dealt into blocks by a hash. A block lists its distinct n-grams
(64-bit hashes, sorted) with their counts in training documents, cut into key
ranges; one shuffle brings equal ranges of all blocks together, where the
counts are summed over the whole corpus, and the sums go back to the blocks
in the order the block listed the n-grams. So a block learns the corpus counts
of every n-gram it needs, no model is ever broadcast or collected, and what a
task holds is a block or the range of a block, at any corpus size. A frequent
n-gram is one entry per block, already counted.

Each block then builds its part of the automaton: known contexts are states,
known n-grams are arcs with a log-probability, and every state has a failure
arc to its longest shorter context with the backoff weight. States and arcs are
numbered like the block's n-grams, so the state after each token is known from
the n-grams that end there, and the texts of a block are traversed together,
left to right in one array: where the state has an arc for the next token its
weight is added, elsewhere the backoff weight is, and the failure arc followed.

Smoothing is Jelinek-Mercer: p(w | h) = (1 - l) c(hw) / c(h) + l p(w | h'),
where l, per order, is the leave-one-out share of training n-grams that would
be unseen without themselves (those that occur once). The lowest order is the
add-half unigram estimate that is also ``base_score``.

Defined cases: NULL text counts as empty (one token, the end); a NULL id counts
as the text "" in the fold; without training documents every probability is
the lowest order's for a vocabulary of none; repeated rows count each; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, words

BEGIN, END = np.uint64(1), np.uint64(2)
MULT = np.uint64(0x9FB21C651E98DF25)
COUNTS = "block int, kind int, bucket int, keys binary, n binary"
SUMS = "block int, kind int, bucket int, c binary, tokens long, types long, once long"


def word_key(word: bytes) -> int:
    """64-bit key of a word; the lowest bits are left to BEGIN and END."""
    return xxhash.xxh64_intdigest(word) | 4


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * MULT) ^ (a >> np.uint64(29)) ^ b
    x = (x ^ (x >> np.uint64(32))) * MULT
    return x ^ (x >> np.uint64(28))


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    """Gaps of ascending keys, byte plane by byte plane: the high planes are
    zeros, which the shuffle's compression takes away."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts in the fewest bytes each (1, 2, 4 or 8; told by the first byte)."""
    top = int(n.max()) if len(n) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Block:
    """Token sequences of a block and its distinct n-grams per order."""

    def __init__(self, texts: list[bytes | None], held: list[bool], order: int):
        ids: dict[bytes, int] = {}
        seqs = [[ids.setdefault(w, len(ids) + 2) for w in words(t or b"")] for t in texts]
        keys = np.array([BEGIN, END, *[word_key(w) for w in ids]], np.uint64)
        self.n_local = len(keys)
        self.length = np.array([len(s) + 2 for s in seqs])
        self.local = np.concatenate([np.array([0, *s, 1], np.int64) for s in seqs]) if seqs else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.length) - self.length
        depth = np.arange(len(self.local)) - np.repeat(self.begin, self.length)
        train = np.repeat(~np.array(held, bool), self.length)
        gram = keys[self.local]
        one = gram
        self.keys, self.n, self.inv, self.at = [], [], [], []
        for k in range(1, order + 1):
            if k > 1:
                gram = np.concatenate([gram[:1], _mix(gram[:-1], one[1:])])
            valid = depth >= k - 1
            where = np.flatnonzero(valid)
            u, first, inv = np.unique(gram[valid], return_index=True, return_inverse=True)
            full = np.full(len(gram), -1, np.int64)
            full[where] = inv
            self.keys.append(u)
            self.inv.append(full)
            self.at.append(where[first] if len(where) else where)
            self.n.append(np.bincount(inv, weights=train[valid], minlength=len(u)).astype(np.int64))

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        for k, (u, n) in enumerate(zip(self.keys, self.n), 1):
            part = ((u >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                yield block, k, int(b), pack_keys(u[s]), pack_counts(n[s])


class Automaton:
    """States, arcs and failure arcs for the n-grams of one block. The state
    of a context of k words is its number among the block's k-grams, an arc
    that of the n-gram it completes."""

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, types: int, backoff: list[float]):
        self.block, self.counts = block, counts
        p = (np.zeros(block.n_local) + 0.5) / (total + 0.5 * (types + 1))
        self.known = np.zeros(block.n_local, bool)  # by local word; BEGIN is no token
        word = block.local[block.at[0]]
        p[word] = (counts[0] + 0.5) / (total + 0.5 * (types + 1))
        self.known[word] = counts[0] > 0
        self.base = np.log10(p)
        self.bow = [0.0]           # backoff weight of the states of k words
        self.weight = [self.base[word]]  # of the arcs that complete an n-gram
        low = p[word]
        for k in range(2, len(counts) + 1):
            at, share = block.at[k - 1], backoff[k - 1]
            h = counts[k - 2][block.inv[k - 2][at - 1]]
            low = low[block.inv[k - 2][at]]
            low = np.where(h > 0, (1 - share) * counts[k - 1] / np.maximum(h, 1) + share * low, low)
            self.weight.append(np.log10(low))
            self.bow.append(float(np.log10(share)))

    def score(self) -> np.ndarray:
        """log10 probability of every token (0 for BEGIN), all texts at once."""
        b, order = self.block, len(self.counts)
        out = np.zeros(len(b.local))
        todo = np.flatnonzero(b.local != 0)
        for k in range(order, 1, -1):
            # tokens whose state is a known context of k - 1 words
            state = b.inv[k - 2][todo - 1]
            has = (b.inv[k - 1][todo] >= 0) & (state >= 0)
            has[has] = self.counts[k - 2][state[has]] > 0
            arc = b.inv[k - 1][todo]
            ok = has.copy()
            ok[has] = self.counts[k - 1][arc[has]] > 0
            out[todo[ok]] += self.weight[k - 1][arc[ok]]
            out[todo[has & ~ok]] += self.bow[k - 1]  # the failure arc
            todo = todo[~ok]
        out[todo] += self.base[b.local[todo]]
        return out


def _sum_counts(table: pa.Table) -> pa.Table:
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate([unpack_counts(x) for x in table.column("n").to_pylist()])
    c = np.bincount(inv, weights=n).astype(np.int64)
    cut = np.cumsum([len(k) for k in keys])[:-1]
    own = u != BEGIN
    zero = [0] * (table.num_rows - 1)
    stat = [int(c[own].sum()), int((c[own] > 0).sum()), int((c[own] == 1).sum())]
    return pa.table([table.column("block"), table.column("kind"), table.column("bucket"),
                     pa.array([pack_counts(x) for x in np.split(c[inv], cut)], pa.binary()),
                     *[pa.array([x, *zero], pa.int64()) for x in stat]],
                    names=["block", "kind", "bucket", "c", "tokens", "types", "once"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2,
                folds: int = 5, held_fold: int = 1, block_rows: int = 1024) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` for each row of ``docs``."""
    n_blocks = max(1, -(-docs.count() // block_rows))
    src = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_fold).alias("held"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(n_blocks)).cast("int").alias("block"))

    def count(table: pa.Table) -> pa.Table:
        b = Block(table.column("t").to_pylist(), table.column("held").to_pylist(), order)
        rows = list(b.rows(table.column("block")[0].as_py(), n_blocks))
        head = list(zip(*[r[:3] for r in rows]))
        return pa.table([*[pa.array(x, pa.int32()) for x in head], pa.array([r[3] for r in rows], pa.binary()),
                         pa.array([r[4] for r in rows], pa.binary())], names=["block", "kind", "bucket", "keys", "n"])

    sums = materialise(src.groupBy("block").applyInArrow(count, COUNTS)
                       .groupBy("kind", "bucket").applyInArrow(_sum_counts, SUMS), "lm-counts")
    stat = {r.kind: r for r in sums.groupBy("kind").agg(
        F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.sum("once").alias("once")).collect()}
    total, types = (stat[1].tokens, stat[1].types) if 1 in stat else (0, 0)
    backoff = [min(0.999, max(0.001, stat[k].once / stat[k].tokens)) if k in stat and stat[k].tokens else 1.0
               for k in range(1, order + 1)]

    def score(table: pa.Table, got: pa.Table) -> pa.Table:
        held = table.column("held").to_pylist()
        b = Block(table.column("t").to_pylist(), held, order)
        where = sorted((k, p, i) for i, (k, p) in enumerate(
            zip(got.column("kind").to_pylist(), got.column("bucket").to_pylist())))
        lists = [unpack_counts(x) for x in got.column("c").to_pylist()]
        counts = [np.concatenate([lists[i] for kind, _, i in where if kind == k] or [np.zeros(0, np.int64)])
                  for k in range(1, order + 1)]
        a = Automaton(b, counts, total, types, backoff)
        token = b.local != 0
        sums = [np.add.reduceat(x, b.begin) for x in (np.where(token, a.base[b.local], 0.0), a.score(),
                                                      (token & a.known[b.local]).astype(np.int64))]
        return pa.table([table.column("doc_id"), pa.array(held, pa.bool_()), pa.array(b.length - 1, pa.int64()),
                         pa.array(sums[2], pa.int64()), pa.array([total] * len(held), pa.int64()),
                         pa.array(sums[0], pa.float64()), pa.array(sums[1], pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return src.groupBy("block").cogroup(sums.select("block", "kind", "bucket", "c").groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")

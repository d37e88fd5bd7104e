"""Operator 4: SimHash near-duplicates by bit-sliced comparison.

Fingerprints are built per document in Arrow batches. Equal fingerprints are
merged first (one row per distinct value), so copies never meet in a pair.
With the 64 bits cut into ``radius + 2`` pieces, two fingerprints within the
radius agree on at least two pieces; every pair of pieces gives one table
whose key is about 26 bits for radius 3. Buckets are gathered with
``collect_list`` after every oversized bucket is cut into block pairs of at
most 2 x ``BLOCK`` rows, so no task holds an unbounded bucket.

Inside a bucket the fingerprints are stored vertically: plane k is a bitmap
of bit k of all members. A query flips each plane by its own bit and feeds
the planes into a carry-save counter (bitwise ones / twos / fours and an
overflow bitmap); members whose counter passes the radius drop out, and a
block of planes is abandoned once every member has. Of the links of a
bucket only a spanning forest leaves it (members minus components rows, not
all pairs), which keeps reachability whole.

Defined cases: NULL text counts as empty; a text without words has
fingerprint zero and links like any other; fewer words than the shingle
length make one shingle; repeated rows share a fingerprint; NULL identifiers
take part, and lose against any other identifier in the minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import connected_components, materialise, words

BLOCK = 4096
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[s:e], SEED)
                  for s, e in zip(starts[:len(w) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    n, ones = len(hashes), np.zeros(64, np.int64)
    a = np.array(hashes, dtype="<u8")
    for i in range(0, n, 8192):  # bounded scratch for very long texts
        ones += np.unpackbits(a[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, fp long")


# --- bit-sliced comparison ----------------------------------------------------

def planes(fps: np.ndarray) -> np.ndarray:
    """64 x words matrix: bit t of word w of plane k is bit k of member 64 w + t."""
    n = len(fps)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(query: np.ndarray, plane: np.ndarray, radius: int) -> np.ndarray:
    """Bitmaps (queries x words) of the members at most ``radius`` bits from
    each query: carry-save counters over the planes."""
    flip = np.where((query[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1),
                    np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    shape = (len(query), plane.shape[1])
    out = np.zeros(shape, np.uint64)
    live = np.arange(len(query))
    count = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64)
    for k in range(64):
        carry = plane[k][None, :] ^ flip[live, k][:, None]
        for j, c in enumerate(count):
            carry, count[j] = c & carry, c ^ carry
        over |= carry
        if k % 8 == 7 and k < 63:  # abandon blocks in which everyone is out
            alive = (~_beyond(count, over, radius)).any(axis=1)
            if not alive.all():
                live, over, count = live[alive], over[alive], [c[alive] for c in count]
    out[live] = ~_beyond(count, over, radius)
    return out


def _beyond(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bitmap of counters above the radius."""
    gt, eq = np.zeros_like(over), ~np.zeros_like(over)
    for j in reversed(range(len(count))):
        if radius >> j & 1:
            eq = eq & count[j]
        else:
            gt |= eq & count[j]
            eq = eq & ~count[j]
    return over | gt


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (member, parent) of a spanning forest of one bucket: breadth
    first, each member is a query once, a whole frontier at a time."""
    n = len(fps)
    plane = planes(fps)
    rest = np.ones(n, bool)
    edges: list[tuple[int, int]] = []
    for seed in range(n):
        if not rest[seed]:
            continue
        rest[seed] = False
        frontier = np.array([seed])
        while len(frontier) and rest.any():
            found = []
            for i in range(0, len(frontier), 256):
                part = frontier[i:i + 256]
                near = np.unpackbits(within(fps[part], plane, radius).view(np.uint8), axis=1,
                                     bitorder="little")[:, :n].astype(bool)
                for q, row in zip(part, near):
                    new = np.flatnonzero(row & rest)
                    rest[new] = False
                    edges += [(int(x), int(q)) for x in new]
                    found.append(new)
            frontier = np.concatenate(found) if found else np.array([], int)
    return edges


def small_forests(buckets: list[np.ndarray], radius: int) -> Iterator[tuple[int, int]]:
    """Edges (as fingerprints) of many buckets of at most 64 members: one
    bucket is one machine word, and lane t of all buckets is compared at once."""
    buckets = sorted(buckets, key=len, reverse=True)
    sizes = np.array([len(b) for b in buckets])
    plane = np.zeros((64, len(buckets)), np.uint64)
    member = np.zeros((len(buckets), int(sizes[0])), np.uint64)
    for i, b in enumerate(buckets):
        member[i, :len(b)] = b
    for t in range(int(sizes[0])):
        for k in range(64):
            plane[k] |= ((member[:, t] >> np.uint64(k)) & np.uint64(1)) << np.uint64(t)
    valid = np.where(sizes == 64, np.uint64(0xFFFFFFFFFFFFFFFF),
                     (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1))
    near = np.zeros((int(sizes[0]), len(buckets)), np.uint64)
    for t in range(int(sizes[0])):
        m = int((sizes > t).sum())  # buckets are sorted by size
        p = plane[:, :m]
        count = [np.zeros(m, np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(m, np.uint64)
        for k in range(64):
            carry = p[k] ^ (np.uint64(0) - ((p[k] >> np.uint64(t)) & np.uint64(1)))
            for j, c in enumerate(count):
                carry, count[j] = c & carry, c ^ carry
            over |= carry
        near[t, :m] = ~_beyond(count, over, radius) & valid[:m]
    for i, b in enumerate(buckets):
        rest = int(valid[i])
        while rest:
            seed = (rest & -rest).bit_length() - 1
            rest &= ~(1 << seed)
            todo = [seed]
            while todo:
                q = todo.pop()
                new = int(near[q, i]) & rest
                rest &= ~new
                while new:
                    x = (new & -new).bit_length() - 1
                    new &= new - 1
                    todo.append(x)
                    yield int(b[x]), int(b[q])


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat = np.asarray(col.flatten()).astype(np.int64).view(np.uint64)
            cut = np.asarray(col.offsets) - np.asarray(col.offsets)[0]
            small, out = [], []
            for s, e in zip(cut[:-1], cut[1:]):
                fps = np.sort(flat[s:e])
                if e - s <= 64:
                    small.append(fps)
                else:
                    out += [(int(fps[a]), int(fps[b])) for a, b in forest(fps, radius)]
            if small:
                out += small_forests(small, radius)
            if out:
                e = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])
    return run


def links(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``fp`` that connect
    everything within ``radius`` bits."""
    n = radius + 2
    edge = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(n)]
    signed = [(masks[i] | masks[j]) for i, j in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in signed]
    tabled = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed]))
                        .alias("tab", "key"))
    # big buckets become pairs of blocks of about `block` members
    big = (tabled.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block)
           .select("tab", "key", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    big = materialise(big, "buckets")
    cell = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda j: F.concat_ws("-", F.least(cell, j.cast("long")), F.greatest(cell, j.cast("long"))))
    rows = tabled.join(big, ["tab", "key"], "left").select(
        "tab", "key", "fp",
        F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(""))).otherwise(pairs)).alias("part"))
    buckets = (rows.groupBy("tab", "key", "part").agg(F.collect_list("fp").alias("m"))
               .where(F.size("m") > 1).select("m"))
    return buckets.mapInArrow(_links(radius), "u long, v long")


def simhash_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, radius: int = 3) -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``): fingerprints link at
    ``radius`` or fewer differing bits, the component id is the smallest
    doc_id reachable."""
    fp, named = _components(docs, id_col, text_col, shingle, radius)
    return fp.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``fp``) per row, and (``fp``, ``component``, ``component_id``)
    per fingerprint; ``component`` is its smallest fingerprint."""
    fp = materialise(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-values")
    comp = connected_components(links(distinct.select("fp"), radius), "u", "v")
    named = distinct.join(comp, distinct.fp == comp.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("component"))
    named = materialise(named, "fingerprint-roots")
    ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return fp, named.join(ids, "component").select("fp", "component", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows and columns of ``docs`` of which one per component stays: the
    smallest id (NULL last), then the smallest fingerprint, then the smallest
    text hash. Rows whose id is NULL or repeated are told apart by their own
    fingerprint, computed again for the kept ids among them only."""
    fp, named = _components(docs, id_col, text_col, shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    best = fp.join(named, "fp").groupBy("component").agg(F.min(order).alias("b")).select("b.id", "b.fp")
    rows_of = fp.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"))
    kept = materialise(best.join(rows_of, F.col("id").eqNullSafe(F.col("doc_id"))).select(
        F.col("id").alias("__id"), F.col("fp").alias("__fp"), "__rows"), "near-kept")
    mine = F.col(id_col).cast("long")
    alone = kept.where("__rows = 1 and __id is not null")
    out = docs.join(alone, mine == F.col("__id"), "left_semi")
    more = kept.where("__rows > 1 or __id is null").select("__id", "__fp")
    if more.isEmpty():
        return out
    at = docs.columns.index(text_col)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() for t in b.column(at))
            fps = [fingerprint(t if isinstance(t, bytes) else t.encode(), shingle) if t else 0 for t in texts]
            yield b.append_column("__own", pa.array(np.array(fps, np.uint64).view(np.int64)))

    # ids that name several rows: those of the kept fingerprint, and one of them
    ids = more.select("__id").distinct()
    doubtful = docs.join(ids, mine.eqNullSafe(F.col("__id")), "left_semi")
    schema = StructType([*doubtful.schema.fields, StructField("__own", LongType())])
    seen = doubtful.mapInArrow(own, schema)
    seen = seen.join(more, mine.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp")), "left_semi")
    text_hash = F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)
    first = Window.partitionBy(F.col(id_col).cast("long"), F.col("__own")).orderBy(F.col(text_col).isNull(), text_hash)
    one = seen.withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return out.unionByName(one.select(*docs.columns))

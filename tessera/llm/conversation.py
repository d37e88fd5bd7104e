"""Operator 11: conversation structure repair by branch and bound.

Rows are damaged as the contract of the query states, then every conversation
is repaired: rows are kept (K), given another role (R) or deleted (D), empty
ones inserted (I), so that the role initials read ``(s?(ua)+)?`` at least cost,
ties to the ASCII-least string of edits.

Search (``Search``): depth first with an explicit stack. A node is a row and
the role written last. The bound of a node is the cost of its cheapest
completion, from one sweep over the rows from the end. Children are opened in
order of bound, then letter; a node whose cost plus bound passes the incumbent
(cost, audit), or ties with it behind its audit, is cut, and so is one that a
cheaper or ASCII-smaller prefix reached before (a table per node). Two prefixes
of one node and cost are never the beginning of one another (both consumed the
same rows, and an insertion costs), so the smaller prefix gives the smaller
audit. The stack empty, the incumbent is proved.

How it runs: facts of a row are a few bytes (role, fault, a digest of the text);
they are range-partitioned by (conversation, order), so a conversation of any
length is split over tasks. A task searches every segment it holds: from the
start to the end for a whole conversation, and between all pairs of roles for
one that may go on in the task before or after. Segments of one conversation
are then put together (one short row per task it touches). Texts move once, to
be hashed in order behind their edits; they stream, a task holds one batch. The
SHA-256 of a conversation is one sequential sum over its text, so that stream
is one task's by contract.

Defined cases: a NULL role or text reads as one space, so does a NULL id or
turn in the hash of the damage; NULL ids are one conversation; NULL turns come
first; rows of one turn are ordered by role, then SHA-256 of the text; a role
that is empty or has another initial than s, u, a cannot be kept; repeated rows
are duplicates; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

NOT_BLANK = r"[^\x20\x09-\x0D]"
CUT_SHORT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*+\z"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
INF = 1 << 60
# role written last: none, system, user, assistant
NONE, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NONE, ASSISTANT)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
SEGMENT = ("conv long, turn long, role string, digest string, first_turn long, last_turn long, turns long, "
           "head string, tail string, rows long, blank long, duplicate long, truncated long, illegal long, "
           "open boolean, paths array<struct<entry:int,exit:int,cost:long,audit:string>>")
REPAIR = ("conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _moves() -> dict[str, list[list[tuple[str, int, int]]]]:
    """Edits of a row by its code and the role written last. Codes: x must go;
    s, u, a and o (another initial); upper case if its text is cut short."""
    table = {"x": [[("D", role, DELETE)] for role in range(4)]}
    for initial in "suao":
        for code, extra in ((initial, 0), (initial.upper(), UNFINISHED)):
            table[code] = []
            for role in range(4):
                here = [("D", role, DELETE)]
                mine = INITIAL.get(initial)
                if mine == NEXT[role] or (mine == SYSTEM and role == NONE):
                    here.append(("K", mine, KEEP + extra))
                here.append(("R", NEXT[role], REROLE + extra))
                table[code].append(here)
    return table


MOVES = _moves()


def _trail(link: tuple | None) -> str:
    out = []
    while link:
        link, letter = link
        out.append(letter)
    return "".join(reversed(out))


class Search:
    """Least edits of ``rows`` (a code per row) from any role written before."""

    def __init__(self, rows: str, final: tuple[int, ...] = FINAL):
        self.rows, self.final = rows, final
        n = len(rows)
        self.bound = [None] * n + [self._inserted([0 if r in final else INF for r in range(4)])]
        for i in range(n - 1, -1, -1):
            after, moves = self.bound[i + 1], MOVES[rows[i]]
            self.bound[i] = self._inserted([min(c + after[to] for _, to, c in moves[r]) for r in range(4)])

    @staticmethod
    def _inserted(cost: list[int]) -> list[int]:
        for _ in range(2):  # user, then assistant
            cost = [min(cost[r], INSERT + cost[NEXT[r]]) for r in range(4)]
        return cost

    def best(self, entry: int = NONE) -> tuple[int, str] | None:
        n, rows, bound = len(self.rows), self.rows, self.bound
        if bound[0][entry] >= INF:
            return None
        incumbent: tuple[int, str] | None = None
        seen: dict[tuple[int, int], tuple[int, tuple | None]] = {}
        stack = [(0, entry, 0, None)]
        while stack:
            i, role, cost, trail = stack.pop()
            least = cost + bound[i][role]
            if incumbent and (least > incumbent[0] or (least == incumbent[0] and _trail(trail) > incumbent[1])):
                continue
            before = seen.get((i, role))
            if before and (before[0] < cost or (before[0] == cost and _trail(before[1]) <= _trail(trail))):
                continue
            seen[i, role] = (cost, trail)
            if i == n and role in self.final:
                found = (cost, _trail(trail))
                if incumbent is None or found < incumbent:
                    incumbent = found
            children = [(cost + INSERT, "I", i, NEXT[role])]
            if i < n:
                children += [(cost + c, letter, i + 1, to) for letter, to, c in MOVES[rows[i]][role]]
            limit = incumbent[0] if incumbent else INF - 1
            children = sorted((c + bound[j][to], letter, c, j, to) for c, letter, j, to in children
                              if c + bound[j][to] <= limit)
            stack += [(j, to, c, (trail, letter)) for _, letter, c, j, to in reversed(children)]
        return incumbent


def damaged(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``copies`` (0 if dropped)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    src = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                               F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
                               (F.crc32(key.cast("binary")) % 20).alias("hit"))
    return src.select(
        "conv", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def faults(rows: DataFrame) -> DataFrame:
    """One row per different (conv, turn, role, text): ``copies``, and the code
    of its first and of its further copies (``first``, ``rest``)."""
    facts = rows.select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), "copies",
                        (~F.col("text").rlike(NOT_BLANK)).alias("blank"), F.col("text").rlike(CUT_SHORT).alias("cut"))
    facts = facts.groupBy("conv", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # NULL is the smallest turn; rows that were dropped are seen by nobody
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = facts.where("copies > 0 and not blank").groupBy("conv", "role", "digest").agg(F.min(order).alias("earliest")) \
        .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest")
    j = facts.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                   & (F.col("digest") == F.col("d")), "left")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return j.select("conv", "turn", "role", "digest", "copies", initial.alias("initial"),
                    F.when(F.col("blank"), "b").when(F.col("earliest") != order, "d")
                    .when(F.col("cut"), F.upper(code)).otherwise(code).alias("first"),
                    F.when(F.col("blank"), "b").otherwise("d").alias("rest"))


class Segment:
    """The rows of one conversation in one task, in order."""

    def __init__(self, row: dict):
        self.at = [row[c] for c in ("conv", "turn", "role", "digest")]
        self.first_turn = self.last_turn = None
        self.turns = self.rows = self.illegal = 0
        self.head = self.tail = ""
        self.count = {"b": 0, "d": 0, "cut": 0}
        self.codes: list[str] = []

    def add(self, row: dict) -> None:
        if not row["copies"]:
            return
        if row["turn"] is not None and row["turn"] != self.last_turn:
            self.turns += 1
            self.last_turn = row["turn"]
            if self.first_turn is None:
                self.first_turn = row["turn"]
        initial, copies = row["initial"], row["copies"]
        if not self.rows:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # a copy follows its like
        self.tail, self.rows = initial, self.rows + copies
        for code, n in ((row["first"], 1), (row["rest"], copies - 1)):
            if code in self.count:
                self.count[code] += n
                self.codes.append("x" * n)
            elif n:
                self.count["cut"] += code.isupper()
                self.codes.append(code)

    def result(self, before: bool, after: bool) -> tuple:
        """``before``, ``after``: may the conversation go on there?"""
        codes, paths = "".join(self.codes), []
        for exits in [(r,) for r in range(4)] if after else [FINAL]:
            search = Search(codes, exits)
            for entry in range(4) if before else (NONE,):
                found = search.best(entry)
                if found:
                    paths.append({"entry": entry, "exit": exits[0], "cost": found[0], "audit": found[1]})
        return (*self.at, self.first_turn, self.last_turn, self.turns, self.head, self.tail, self.rows,
                self.count["b"], self.count["d"], self.count["cut"], self.illegal, before or after, paths)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    cur, first, out = None, True, []
    for b in batches:
        for row in b.to_pylist():
            if cur is None or row["conv"] != cur.at[0]:
                if cur is not None:
                    out.append(cur.result(first, False))
                    first = False
                cur = Segment(row)
            cur.add(row)
        if out:
            schema = schema or _segment_schema()
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if cur is not None:
        schema = schema or _segment_schema()
        out.append(cur.result(first, True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _segment_schema() -> pa.Schema:
    path = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ") for f in SEGMENT.split(", ")]
    return pa.schema([(n, kinds.get(t) or pa.list_(path)) for n, t in fields])


def _joined(table: pa.Table) -> pa.Table:
    """The segments of one conversation, put together in order."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["digest"]))
    best = {NONE: (0, "")}
    turns, first, last, tail, illegal = 0, None, None, None, 0
    for k, r in enumerate(rows):
        step: dict[int, tuple[int, str]] = {}
        for p in r["paths"]:
            # the last segment is searched up to each role; only a final one may end there
            if p["entry"] in best and (k + 1 < len(rows) or p["exit"] in FINAL):
                cost, audit = best[p["entry"]]
                found = (cost + p["cost"], audit + p["audit"])
                if p["exit"] not in step or found < step[p["exit"]]:
                    step[p["exit"]] = found
        best = step
        turns += r["turns"] - (last is not None and r["first_turn"] == last)
        first = r["first_turn"] if first is None else first
        last = r["last_turn"] if r["last_turn"] is not None else last
        if r["rows"]:
            illegal += r["illegal"] + (tail is not None and tail + r["head"] not in ("su", "ua", "au"))
            tail = r["tail"]
    cost, audit = min(best.values())
    total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")}
    gaps = 0 if first is None else last - first + 1 - turns
    cols = [rows[0]["conv"], gaps, total["blank"], total["duplicate"], total["truncated"], illegal, cost, audit]
    fields = [f.split(" ") for f in REPAIR.split(", ")]
    return pa.table({n: pa.array([v], pa.string() if t == "string" else pa.int64()) for (n, t), v in zip(fields, cols)})


def audits(rows: DataFrame) -> DataFrame:
    """``REPAIR`` per conversation."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    parts = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialise(parts.select("conv", "turn", "role", "digest", "copies", "initial", "first", "rest")
                        .mapInArrow(segments, SEGMENT), "repair-segments")
    whole = parts.where("not open").select(
        "conv", F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
        .cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit"))
    return whole.unionByName(parts.where("open").groupBy("conv").applyInArrow(_joined, REPAIR))


class Writer:
    """Follows the edits of a conversation and hashes the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.role, self.lines = audit, 0, NONE, 0
        self.hash = hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.lines += 1
        self.hash.update(f"{role}:{text}".encode())

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.role = NEXT[self.role]
            self.line(NAMES[self.role], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.role = INITIAL[role[0]]
            self.line(role, text)
        elif letter == "R":
            self.role = NEXT[self.role]
            self.line(NAMES[self.role], text)

    def done(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its audit comes first, then its rows in order."""
    cur, writer, out = None, None, []
    for b in batches:
        for row in b.to_pylist():
            if row["audit"] is not None:
                if writer:
                    out.append((cur, writer.done()))
                cur, writer = row["conv"], Writer(row["audit"])
            else:
                for _ in range(row["copies"]):
                    writer.add(row["role"], row["text"])
        if out:
            yield _hash_batch(out)
            out = []
    if writer:
        yield _hash_batch([(cur, writer.done())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(digest, pa.string())],
                                      names=["c", "repaired_sha256"])


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit``, ``repaired_sha256`` of every conversation."""
    rows = damaged(conversations, conv_id, turn, role, text)
    found = materialise(audits(rows), "repair-audits")
    none = F.lit(None)
    stream = found.select("conv", none.cast("long").alias("turn"), none.cast("string").alias("role"),
                          none.cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit") \
        .unionByName(rows.where("copies > 0").withColumn("audit", none.cast("string")))
    order = ["conv", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", _digest(F.col("text"))]
    hashed = stream.repartition("conv").sortWithinPartitions(*order).mapInArrow(hashes, "c long, repaired_sha256 string")
    return found.join(hashed, F.col("conv").eqNullSafe(F.col("c"))).select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256")

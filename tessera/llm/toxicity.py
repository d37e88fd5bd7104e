"""Operator 8: toxicity by a weighted finite-state pattern grammar.

Four small transducers are composed into one machine that reads a clause word
by word: *negation* rewrites an insult or threat in its scope to ``denied``,
*reported speech* rewrites one after a saying verb to ``quoted``, and the
*insult*, *threat* and *target* acceptors remember what is left. The state at
the end of the clause names the matched pattern (insult at a target, denied
insult, ...), and the patterns, not the words, carry the weights of the score.

The insult lexicon is a seed list plus stems learned from labelled rows:
greedily the stem that explains most toxic texts not explained so far, as
long as that is beyond chance. The pattern weights are a logistic regression
on pattern counts, drawn towards the weights below where data are few.
Training reads at most ``max_training_rows`` labelled rows (a hash sample);
scoring reads every row, in Arrow batches, without a shuffle.

Defined cases: NULL text counts as empty and gets the score of a text without
a match; NULL ids count as the text "" in the fold; rows without a label are
scored only; without any label the seed lexicon and weights apply; labels of
one id that differ count as toxic if any is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise

# Seed lexicons of the grammar.
INSULT = ("idiot idiots moron morons imbecile stupid dumb loser losers scum trash garbage pathetic worthless "
          "disgusting clown clowns pig pigs vermin coward fool ugly freak filth")
THREAT = "kill killing murder hurt punch stab shoot burn destroy beat strangle hang"
TARGET = ("you your youre you're yourself u he him his she her they them their these those people everyone "
          "du dich dir ihr euch sie tu toi vous il elle ils ellos ellas tú ti usted ustedes él ella")
NEGATION = ("not no never nobody isn't aren't wasn't don't doesn't didn't won't can't without nicht kein keine nie "
            "ne pas jamais sin nunca jamás")
REPORT = ("said says say called calls wrote writes quoted quote claimed claims alleged reported sagte schrieb dit "
          "écrit dijo escribió")
PATTERNS = ("insult", "insult at target", "threat", "threat at target", "denied", "quoted")
# log-odds drawn towards, per pattern, and the bias
PRIOR = (6.0, 7.0, 2.0, 6.0, 0.0, 1.0, -3.0)

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
STEM_SIZES = range(3, 13)


# --- the machine --------------------------------------------------------------

class Transducer:
    """``step(state, symbol) -> (state, symbol)`` with a start state."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, the other reads."""
        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = other.step(state[1], mid)
            return (a, b), out
        return Transducer((self.start, other.start), step)


def _negation(scope, s):
    if s == "negation":
        return 4, s
    return max(0, scope - 1), "denied" if scope and s in ("insult", "threat") else s


def _report(seen, s):
    if s == "report":
        return True, s
    return seen, "quoted" if seen and s in ("insult", "threat") else s


def _seen(name):
    return Transducer(False, lambda state, s: (state or s == name, s))


def grammar() -> Transducer:
    machine = Transducer(0, _negation).then(Transducer(False, _report))
    for name in ("insult", "threat", "target", "denied", "quoted"):
        machine = machine.then(_seen(name))
    return machine


def pattern(state) -> int | None:
    (((((_, insult), threat), target), denied), quoted) = state
    if insult:
        return 1 if target else 0
    if threat:
        return 3 if target else 2
    return 4 if denied else 5 if quoted else None


class Matcher:
    """Clause patterns of a text under a lexicon of insult stems."""

    def __init__(self, stems: list[str]):
        self.kind = {}
        for name, words in (("report", REPORT), ("negation", NEGATION), ("target", TARGET), ("threat", THREAT),
                            ("insult", INSULT)):
            self.kind |= dict.fromkeys(words.split(), name)
        self.stems = set(stems)
        self.sizes = sorted({len(s) for s in stems})
        self.find = ahocorasick.Automaton()
        for w in {*stems, *INSULT.split(), *THREAT.split()}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()
        self.machine, self.table = grammar(), {}

    def symbol(self, word: str) -> str:
        known = self.kind.get(word)
        if known != "insult" and any(word[:n] in self.stems for n in self.sizes if n <= len(word)):
            return "insult"
        return known or "other"

    def hits(self, text: str) -> bool:
        """Does a word begin with a stem? Most texts end here."""
        return any(end - n < 0 or not text[end - n].isalpha() for end, n in self.find.iter(text))

    def counts(self, text: str) -> list[int]:
        out = [0] * len(PATTERNS)
        text = text.lower()
        if not self.hits(text):
            return out
        state, start, table = self.machine.start, self.machine.start, self.table
        for tok in TOKEN.findall(text) + ["."]:
            if tok[0] in ".!?;:\n":
                p = pattern(state)
                if p is not None:
                    out[p] += 1
                state = start
                continue
            s = self.symbol(tok)
            key = (state, s)
            nxt = table.get(key)
            if nxt is None:
                nxt = table[key] = self.machine.step(state, s)[0]
            state = nxt
        return out


# --- learning -------------------------------------------------------------------

def stems_of(text: str) -> set[str]:
    out = set()
    for w in set(LETTERS.findall(text.lower())):
        out.add(w)
        out.update(w[:n] for n in STEM_SIZES if n < len(w))
    return out


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            (toxic if label else clean).update(stems_of(text.as_py() or ""))
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()),
             pa.array([clean[x] for x in names], pa.int64())], names=["stem", "toxic", "clean"])


def learn_stems(train: DataFrame, min_texts: int = 4, p_value: float = 1e-3) -> list[str]:
    """Stems that mark toxic texts. ``train`` (text, toxic) is bounded by the
    caller; its texts are distinct."""
    n = {bool(r.toxic): r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return []
    rate = n[True] / (n[True] + n[False])
    need = max(min_texts, int(np.ceil(np.log(p_value / 1e6) / np.log(rate) / 3)))
    table = train.select("text", "toxic").mapInArrow(_stem_counts, "stem string, toxic long, clean long")
    good = (table.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where((F.col("toxic") >= need) & (F.col("clean") <= 0.02 * F.col("toxic"))))
    clean = {r.stem: r.clean for r in good.collect()}  # bounded by the training sample

    def marks(batches):
        for b in batches:
            rows = [(i, s) for i, t in zip(b.column(0).to_pylist(), b.column(1))
                    for s in stems_of(t.as_py() or "") if s in clean]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.string())], names=["i", "stem"])

    where = defaultdict(set)
    for r in train.where("toxic = 1").select("i", "text").mapInArrow(marks, "i long, stem string").collect():
        where[r.stem].add(r.i)
    # greedy cover: a stem earns its place by texts no other stem explains
    chosen = []
    while where:
        best = max(where, key=lambda s: (len(where[s]) - 20 * clean[s], len(s), s))
        done = set(where[best])
        if len(done) < need or len(done) <= 20 * clean[best]:
            break
        chosen.append(best)
        where = {s: left for s, ids in where.items() if len(left := ids - done) >= need}
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, pull: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge towards ``PRIOR``."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + pull * (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def pattern_counts(docs: DataFrame, text_col: str, stems: list[str], out: str = "hits") -> DataFrame:
    """``docs`` and, as last column ``out``, how often each pattern matches."""
    shared = docs.sparkSession.sparkContext.broadcast(stems)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value)
        for b in batches:
            hits = [m.counts(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.int32()))],
                                             names=[*b.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def fold(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class ToxicityModel:
    stems: list[str]
    weights: list[float]

    def score(self, hits: Column) -> Column:
        z = F.lit(self.weights[-1])
        for k in range(len(PATTERNS)):
            z = z + F.lit(self.weights[k]) * F.log1p(hits[k].cast("double"))
        return 1 / (1 + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_training_rows: int = 20_000) -> ToxicityModel:
    """Lexicon and weights from labelled rows outside fold 0; at most about
    ``max_training_rows`` of them (a hash sample of the ids)."""
    marked = (labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0))
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    share = min(1.0, max_training_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    train = (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(marked, "id")
             .groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h"))
             .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("id").alias("i")))
    train = materialise(train.select("i", "text", "toxic"), "toxic-train")
    stems = learn_stems(train)
    table = pattern_counts(train.select("toxic", "text"), "text", stems).groupBy(F.col("hits").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("y")).collect()  # bounded by the training rows
    if not table:
        return ToxicityModel(stems, list(PRIOR))
    w = fit_weights(np.log1p(np.array([r.x for r in table], float)), np.array([r.y for r in table], float),
                    np.array([r.n for r in table], float))
    return ToxicityModel(stems, [float(x) for x in w])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", max_training_rows: int = 20_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``hits`` (matches per
    pattern) for each row of ``docs``. Rows of fold 0 never train."""
    model = learn(docs, labels, id_col, text_col, label_col, max_training_rows)
    rows = pattern_counts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                          "text", model.stems)
    score = model.score(F.col("hits"))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"),
                       (score >= 0.5).cast("int").alias("predicted"), "hits")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` that are not predicted toxic."""
    model = learn(docs, labels, text_col=text_col, **how)
    rows = pattern_counts(docs, text_col, model.stems, out="__hits")
    return rows.where(model.score(F.col("__hits")) < 0.5).drop("__hits")

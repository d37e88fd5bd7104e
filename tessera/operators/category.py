"""Category, text and embedding encoders.

Dictionaries are built as distributed tables (distinct values ranked with
the skew-safe rank) and joined back, so a column with a billion distinct ids
never passes through the driver; only explicitly bounded vocabularies
(one-hot columns, top-k terms) are collected. Text features are kept in long
format (doc, term, weight) until a vector is asked for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.machine import out_of_fold
from tessera.plans.factor import non_negative, once as _once, pair_cells, randomised_svd, topics
from tessera.plans.positions import global_rank, with_positions


# ------------------------------------------------------------------ C01-C02
def label_encode(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Category -> dense index 0..n-1 in ascending value order (as
    ``StringIndexer(stringOrderType='alphabetAsc')``); NULL gets its own
    index n. The dictionary is a distributed table, ranked without one task."""
    name = name or f"{c}_label"
    vals = _once(df.select(c).where(F.col(c).isNotNull()).distinct())
    ranked = global_rank(vals, [c], pos="_i", total="_n")
    out = df.join(ranked.select(c, "_i"), c, "left")
    # the NULL index is the number of values: one small aggregate, as a literal
    n = vals.count()
    return out.withColumn(name, F.when(F.col(c).isNull(), F.lit(n)).otherwise(F.col("_i")).cast("bigint")).drop("_i")


def frequency_ordinal(df: DataFrame, c: str, na_values: Sequence = (), name: str | None = None) -> DataFrame:
    """Categories ranked by ascending count 1..n (ties by value); NULL
    and the given NA values -> -1."""
    name = name or f"{c}_freq_rank"
    x = F.col(c)
    valid = x.isNotNull()
    for v in na_values:
        valid = valid & (x != F.lit(v))
    counts = _once(df.where(valid).groupBy(c).agg(F.count(F.lit(1)).alias("_cnt")))
    ranked = global_rank(counts, ["_cnt", c], pos="_fr", total=None)
    out = df.join(ranked.select(c, (F.col("_fr") + 1).alias("_rk")), c, "left")
    return out.withColumn(name, F.when(valid, F.col("_rk")).otherwise(F.lit(-1)).cast("bigint")).drop("_rk")


# ------------------------------------------------------------------ C03-C06
def one_hot_dense(df: DataFrame, c: str, values: Sequence[str] | None = None, prefix: str | None = None,
                  na_value: str = "NA_NOT_FOUND", drop_first: bool = False) -> DataFrame:
    """One 0/1 column per value ``{prefix}_{value}``; NULL is its own
    category ``NA_NOT_FOUND``. Without ``values`` all distinct values become
    columns (C04 is the form for many)."""
    p = prefix or c
    x = F.coalesce(F.col(c).cast("string"), F.lit(na_value))
    if values is None:
        values = sorted(r[0] for r in df.select(x.alias("v")).distinct().collect())
    if drop_first:
        values = values[1:]
    return df.select("*", *[(x == F.lit(v)).cast("int").alias(f"{p}_{v}") for v in values])


def one_hot_sparse(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """High-cardinality one-hot as a sparse vector: distributed index
    (C01) then ``OneHotEncoder(dropLast=False, handleInvalid='keep')``."""
    from pyspark.ml.feature import OneHotEncoder
    name = name or f"{c}_onehot"
    idx = label_encode(df, c, name="_idx")
    enc = OneHotEncoder(inputCols=["_idx"], outputCols=[name], dropLast=False, handleInvalid="keep")
    return enc.fit(idx).transform(idx).drop("_idx")


def rare_fold(df: DataFrame, c: str, threshold: int = 20, adaptive_distinct: int | None = None,
              pct: float | None = None, rare: str = "RARE_VALUE", name: str | None = None) -> DataFrame:
    """Values seen fewer than ``threshold`` times -> ``RARE_VALUE``.
    Adaptive: with more than ``adaptive_distinct`` distinct values the
    threshold becomes ``mean count x pct``."""
    name = name or f"{c}_folded"
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_cnt"))
    thr = float(threshold)
    if adaptive_distinct is not None:
        st = counts.agg(F.count(F.lit(1)).alias("d"), F.avg("_cnt").alias("m")).first()
        if st["d"] > adaptive_distinct:
            thr = st["m"] * pct
    out = df.join(counts, c, "left")
    return out.withColumn(name, F.when(F.col("_cnt") < thr, F.lit(rare)).otherwise(F.col(c).cast("string"))) \
              .drop("_cnt")


def shared_vocabulary(df: DataFrame, c: str, is_train: Column, unknown: str | None = "unknown",
                      name: str | None = None) -> DataFrame:
    """Keep values seen in both train and test rows, others ->
    ``unknown`` (or NULL). ``intersect`` of the two distinct sets."""
    name = name or f"{c}_shared"
    tr = df.where(is_train).select(c).distinct()
    te = df.where(~is_train).select(c).distinct()
    both = tr.intersect(te).withColumn("_both", F.lit(True))
    out = df.join(both, c, "left")
    keep = F.col("_both").isNotNull()
    return out.withColumn(name, F.when(keep, F.col(c).cast("string")).otherwise(F.lit(unknown))).drop("_both")


# ------------------------------------------------------------------ C07-C08
def feature_hash(df: DataFrame, cols_: Sequence[str], n: int = 100, name: str = "hashed") -> DataFrame:
    """All categorical strings hashed into ``n`` buckets (FeatureHasher)."""
    from pyspark.ml.feature import FeatureHasher
    return FeatureHasher(inputCols=list(cols_), outputCol=name, numFeatures=n,
                         categoricalCols=list(cols_)).transform(df)


def tag_counts(df: DataFrame, id_col: str, c: str, min_df: int = 1, sep: str = ",") -> DataFrame:
    """Comma-separated tags -> (id, tag, cnt), tags of at least ``min_df``
    rows. The dictionary stays a distributed table, whatever its size."""
    tags = df.select(id_col, F.explode(F.filter(F.split(F.col(c), sep), lambda s: s != "")).alias("tag"))
    cnt = tags.groupBy(id_col, "tag").agg(F.count(F.lit(1)).alias("cnt"))
    if min_df <= 1:
        return cnt
    cnt = _once(cnt)
    often = cnt.groupBy("tag").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= min_df).select("tag")
    return cnt.join(often, "tag", "left_semi")


def tag_count_vector(df: DataFrame, c: str, vocabulary: Sequence[str], sep: str = ",", name: str | None = None):
    """C08 as an ML vector over a vocabulary the caller gives."""
    from pyspark.ml.feature import CountVectorizerModel
    name = name or f"{c}_counts"
    toks = df.withColumn("_toks", F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda s: s != ""))
    model = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol="_toks", outputCol=name)
    return model.transform(toks).drop("_toks")


# ---------------------------------------------------------------------- C09
TOKEN_PATTERN = r"[^\p{L}\p{N}_]+"
TASK_TERMS = 1 << 21  # (document, term) rows that a task counts, sorts or packs at a time, about


def _parts(df: DataFrame, text: str, per_char: float) -> int:
    """Tasks that the terms of all texts take, ``per_char`` of them a character."""
    chars = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, int(chars * per_char / TASK_TERMS) + 1)


def _counted(rows: DataFrame, doc: str, grams: Column) -> DataFrame:
    """(doc, term, tf) of rows dealt by ``doc``: all terms of a document are in one
    task, so they are counted (and joined by document) without another exchange."""
    return rows.select(doc, F.explode(grams).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks (``é`` -> ``e``); the table follows
    from Unicode's canonical decomposition."""
    pairs = [(chr(x), unicodedata.normalize("NFD", chr(x))) for x in range(0xC0, 0x250)]
    pairs = [(x, d[0]) for x, d in pairs if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return F.translate(c, "".join(x for x, _ in pairs), "".join(d for _, d in pairs))


def word_terms(df: DataFrame, doc: str, text: str, ngram: tuple[int, int] = (1, 1),
               lowercase: bool = True, stop_words: Sequence[str] = (), accents: bool = True) -> DataFrame:
    """(doc, term, tf) for word n-grams: split on non-word characters of any
    script, drop ``stop_words``; n-grams join consecutive tokens with one
    space. ``accents=False`` strips accents first."""
    t = F.lower(F.col(text)) if lowercase else F.col(text)
    if not accents:
        t = strip_accents(t)
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else None
    sizes = ngram[1] - ngram[0] + 1
    texts = df.select(doc, text).where(F.col(text).isNotNull()).repartition(_parts(df, text, sizes / 6), doc)
    toks = texts.select(doc, F.filter(F.split(t, TOKEN_PATTERN), lambda s: (s != "") if stop is None else
                                      (s != "") & ~F.array_contains(stop, s)).alias("_t"))
    none = F.array().cast("array<string>")

    def joined(n: int):
        return lambda i: F.array_join(F.slice("_t", i + 1, n), " ")

    # the n-grams of every size of a row in one list: the text is split once
    grams = [F.col("_t") if n == 1 else F.when(F.size("_t") >= n, F.transform(F.sequence(F.lit(0), F.size("_t") - n), joined(n)))
             .otherwise(none) for n in range(ngram[0], ngram[1] + 1)]
    return _counted(toks, doc, F.concat(*grams))


def char_terms(df: DataFrame, doc: str, text: str, ngram: tuple[int, int] = (2, 5)) -> DataFrame:
    """(doc, term, tf) for character n-grams of the whole text."""
    none = F.array().cast("array<string>")

    def cut(n: int):
        return lambda i: F.substring(text, i, n)

    grams = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), cut(n))).otherwise(none)
             for n in range(ngram[0], ngram[1] + 1)]
    parts = _parts(df, text, ngram[1] - ngram[0] + 1)
    return _counted(df.select(doc, text).repartition(parts, doc), doc, F.concat(*grams))


def tfidf_fit(terms: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0,
              max_features: int | None = None) -> DataFrame:
    """(term, idf) of the training documents: smooth idf ``ln((1 + n) /
    (1 + df)) + 1``. ``n_docs`` counts every input document (also those without
    a term); count the input table, not the terms. Terms are kept by
    ``min_df`` / ``max_df`` and, with ``max_features``, the most frequent ones
    (ties by term)."""
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_cf"))
    stats = stats.where((F.col("_df") >= min_df) & (F.col("_df") <= F.lit(max_df * n_docs)))
    if max_features is not None:
        # top terms: the vocabulary cap is the feature; each partition keeps
        # its best max_features before one merge (bounded by the cap)
        stats = stats.orderBy(F.desc("_cf"), F.asc("term")).limit(max_features)
    # written: a small vocabulary is then known to be small, and the terms of the documents stay where they are
    return _once(stats.select("term", (F.log((F.lit(1.0 + n_docs)) / (F.col("_df") + 1)) + 1).alias("idf")))


def tfidf_apply(terms: DataFrame, doc: str, idf: DataFrame, sublinear: bool = True, norm: bool = True) -> DataFrame:
    """Weights of any documents under a fitted ``idf`` table: sublinear
    tf ``1 + ln(tf)``, l2 norm per document; terms not fitted are dropped."""
    tf = (1 + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    w = terms.join(idf, "term").select(doc, "term", (tf * F.col("idf")).alias("w"))
    if not norm:
        return w.withColumnRenamed("w", "tfidf")
    # the terms of a document in one row (no longer than its text): one exchange, no join back
    per = w.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_nrm"), F.collect_list(F.struct("term", "w")).alias("_l"))
    return per.select(doc, "_nrm", F.explode("_l").alias("x")).select(doc, "x.term", (F.col("x.w") / F.col("_nrm")).alias("tfidf"))


def tfidf(terms: DataFrame, doc: str, n_docs: int, min_df: int = 1, max_df: float = 1.0,
          max_features: int | None = None, sublinear: bool = True, norm: bool = True) -> DataFrame:
    """TF-IDF in long format, as scikit-learn's default, fitted on and
    applied to the same documents."""
    return tfidf_apply(terms, doc, tfidf_fit(terms, n_docs, min_df, max_df, max_features), sublinear, norm)


# ------------------------------------------------------------------ C10-C16
def category_vectors(df: DataFrame, cols_: Sequence[str], size: int = 8, seed: int = 0) -> DataFrame:
    """C10 fit: (``token``, ``vector``) of every ``col=value``. Each row is a
    sentence of its tokens; the vectors factorise their positive pointwise
    mutual information, the matrix a skip-gram model over the whole sentence
    approaches. Pairs are counted with partial aggregation, the factors are
    joins and sums: the training is spread over all tasks and two runs agree."""
    toks = _tokens(cols_)
    pairs = F.array(*[F.struct(a.alias("_r"), b.alias("_c")) for i, a in enumerate(toks) for b in toks[i + 1:]])
    half = df.select(F.explode(pairs).alias("p")).groupBy("p._r", "p._c").agg(F.count(F.lit(1)).alias("n"))
    both = _once(half.unionByName(half.select(F.col("_c").alias("_r"), F.col("_r").alias("_c"), "n")))
    single = _once(both.groupBy("_r").agg(F.sum("n").alias("nr")))
    total = single.agg(F.sum("nr")).first()[0] or 0
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("nr") * F.col("nc")))
    cells = both.join(single, "_r").join(single.select(F.col("_r").alias("_c"), F.col("nr").alias("nc")), "_c") \
        .select(F.lit("").alias("_g"), "_r", "_c", pmi.alias("_v")).where("_v > 0")
    rows, sigma = randomised_svd(cells, size, max_iter=6, seed=seed)
    # U sqrt(S): half of the weight on either side of a pair
    root = [1 / np.sqrt(s) if s > 0 else 0.0 for s in sigma.get("", np.zeros(size))] + [0.0] * size
    vec = F.array(*[F.col(f"_{i}") * F.lit(float(root[i])) for i in range(size)])
    # a token without positive information is at the origin
    return single.select(F.col("_r").alias("token")).join(rows.select(F.col("_r").alias("token"), vec.alias("vector")), "token", "left") \
        .select("token", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)).alias("vector"))


def _tokens(cols_: Sequence[str]) -> list[Column]:
    return [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in cols_]


def category2vec(df: DataFrame, id_col: str, cols_: Sequence[str], size: int = 8, seed: int = 0,
                 name: str = "cat2vec", fit_on: DataFrame | None = None) -> DataFrame:
    """A row gets the concatenation of its tokens' vectors, fitted on
    ``fit_on`` (default: the rows themselves); unseen tokens -> zeros."""
    vecs = _once(category_vectors(df if fit_on is None else fit_on, cols_, size, seed))
    sent = df.select(id_col, F.posexplode(F.array(*_tokens(cols_))).alias("_p", "token"))
    out = sent.join(vecs, "token", "left").groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("_p", F.col("vector").alias("_a")))).alias("_l"))
    flat = F.flatten(F.transform("_l", lambda s: F.coalesce(s["_a"], F.array_repeat(F.lit(0.0), size))))
    return out.select(id_col, flat.alias(name))


def key_value_document(df: DataFrame, key: str, value: str) -> DataFrame:
    """C11: per key, its co-occurring values with counts, sorted by value:
    the bag of words of a "document". Size per key is bounded by the number
    of distinct values, not by the key's rows."""
    bag = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("cnt"))
    return bag.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(value).cast("string").alias("v"),
                                                                      F.col("cnt")))).alias("doc"))


def _pair_table(factor: DataFrame, pair: tuple[str, str], df: DataFrame, prefix: str, k: int) -> DataFrame:
    key, value = pair
    return factor.where(F.col("_g") == f"{key}|{value}").select(
        F.col("_r").cast(df.schema[key].dataType).alias(key), *[F.col(f"_{i}").alias(f"{prefix}_{key}_{value}_{i}") for i in range(k)])


def topic_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], k: int = 5, seed: int = 0, max_iter: int = 30) -> DataFrame:
    """C12 for many (key, value) pairs at once: ``_g`` = ``key|value``, ``_r``
    = the key, and its topic shares. The jobs of all pairs are those of one."""
    return topics(pair_cells(df, pairs), k, max_iter, seed)[0]


def lda_topics(df: DataFrame, key: str, value: str, k: int = 5, seed: int = 0, max_iter: int = 30) -> DataFrame:
    """Topic mixture per key from its value document."""
    return _pair_table(topic_pairs(df, [(key, value)], k, seed, max_iter), (key, value), df, "lda", k)


def svd_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], k: int = 5, binary: bool = False) -> DataFrame:
    """C13 for many pairs at once: rows of U S per ``_g``, ``_r``."""
    cells = pair_cells(df, pairs)
    return randomised_svd(cells.withColumn("_v", F.lit(1.0)) if binary else cells, k, tol=1e-6)[0]


def svd_embedding(df: DataFrame, key: str, value: str, k: int = 5, binary: bool = False) -> DataFrame:
    """Truncated SVD of the key x value count (or 0/1) matrix; the key
    embedding is ``U * S``."""
    return _pair_table(svd_pairs(df, [(key, value)], k, binary), (key, value), df, "svd", k)


def nmf_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], k: int = 5, seed: int = 0, max_iter: int = 10) -> DataFrame:
    """C14 for many pairs at once: rows of W per ``_g``, ``_r``."""
    return non_negative(pair_cells(df, pairs), k, max_iter, seed)[0]


def nmf_embedding(df: DataFrame, key: str, value: str, k: int = 5, seed: int = 0, max_iter: int = 10) -> DataFrame:
    """C14: non-negative factors W H of the key x value count matrix (zero
    cells count as zeros) by multiplicative updates."""
    return _pair_table(nmf_pairs(df, [(key, value)], k, seed, max_iter), (key, value), df, "nmf", k)


def tag_rate_embedding(df: DataFrame, id_col: str, tags: str, item: str, label: str, k: int = 4,
                       sep: str = ",") -> DataFrame:
    """Tag x item click-rate matrix (clicks / impressions), SVD, and a
    row's embedding = the sum of its tags' vectors."""
    ex = df.select(id_col, item, label, F.explode(F.filter(F.split(F.col(tags), sep), lambda s: s != "")).alias("_tag"))
    cells = ex.where(F.col(item).isNotNull()).groupBy(F.col("_tag").alias("_r"), F.col(item).cast("string").alias("_c")) \
        .agg((F.sum(label) / F.count(F.lit(1))).alias("_v"))
    emb = randomised_svd(cells.select(F.lit("").alias("_g"), "_r", "_c", "_v"), k)[0]
    j = ex.select(id_col, "_tag").join(emb.drop("_g").withColumnRenamed("_r", "_tag"), "_tag")
    return j.groupBy(id_col).agg(*[F.sum(f"_{i}").alias(f"tag_svd_{i}") for i in range(k)])


def mf_oof_feature(df: DataFrame, user: str, item: str, label: str, fold: str, k_folds: int, rank: int = 4,
                   seed: int = 0, name: str = "mf_score") -> DataFrame:
    """User x item click matrix factorisation as an out-of-fold
    feature: for each fold, ALS on the other folds predicts that fold."""
    from pyspark.ml.recommendation import ALS
    ui = label_encode(df.select(user).distinct(), user, name="_ui").select(user, "_ui")
    ii = label_encode(df.select(item).distinct(), item, name="_ii").select(item, "_ii")
    # written once: every fold's fit and prediction reads the rows again
    d = _once(df.join(ui, user).join(ii, item).withColumn("_y", F.col(label).cast("float")))
    out = None
    for f in range(k_folds):
        tr = d.where(F.col(fold) != f)
        va = d.where(F.col(fold) == f)
        m = ALS(rank=rank, maxIter=5, seed=seed, userCol="_ui", itemCol="_ii", ratingCol="_y",
                coldStartStrategy="nan").fit(tr)
        p = m.transform(va).withColumnRenamed("prediction", name).drop("_ui", "_ii", "_y")
        out = p if out is None else out.unionByName(p)
    return out


def fm_oof_feature(df: DataFrame, id_col: str, user: str, item: str, label: str, fold: str, k_folds: int,
                   side: Sequence[str] = (), numeric: Sequence[str] = (), factors: int = 4, buckets: int = 1 << 16,
                   max_iter: int = 60, step: float = 0.1, reg: float = 1e-4, seed: int = 0, name: str = "fm_score") -> DataFrame:
    """C16 with side columns: a factorisation machine over user, item, ``side``
    categories and ``numeric`` columns, as an out-of-fold probability. A row is
    a sparse vector of hashed ``column=value`` slots (``FeatureHasher``), so no
    dictionary is built and the model has ``buckets x (factors + 1)`` numbers
    whatever the number of users; numeric columns are scaled to deviation one.
    A value that the other folds never hold contributes its start factors only,
    near zero: the row is scored by the rest. NULL categories are a value, NULL
    numbers are 0 (the mean). The machines of all folds learn in the same passes."""
    from pyspark.ml.feature import FeatureHasher
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_samp))],
                   F.count(F.lit(1)).alias("n")).first()
    cats = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_c{i}") for i, c in enumerate([user, item, *side])]
    # a zero is left out of the vector (the machine takes no explicit zeros), like NULL
    nums = [F.nullif((F.col(c).cast("double") - F.lit(stats[f"{c}_m"])) / F.lit(stats[f"{c}_s"] or 1.0), F.lit(0.0)).alias(f"_n{i}")
            for i, c in enumerate(numeric)]
    inputs = [f"_c{i}" for i in range(2 + len(side))] + [f"_n{i}" for i in range(len(numeric))]
    hasher = FeatureHasher(inputCols=inputs, outputCol="features", numFeatures=buckets)
    rows = hasher.transform(df.select(id_col, F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("f"), *cats, *nums)) \
        .select(id_col, "y", "f", "features")
    return out_of_fold(rows, id_col, k_folds, len(inputs), buckets, factors, max_iter, step, reg, seed, name)


# ------------------------------------------------------------------ C17-C19
def sequence_builder(child: DataFrame, parent: str, order: Sequence[str], value: str, maxlen: int,
                     pad=0.0, name: str | None = None) -> DataFrame:
    """C17: a parent's children in time order as one array of the last
    ``maxlen`` values, left-padded with ``pad``. Only the last ``maxlen``
    rows are collected (recency rank from the skew-safe positions)."""
    name = name or f"{value}_seq"
    need = child.select(*dict.fromkeys([parent, *order, value]))
    pos = with_positions(need, [parent], order, total=None, descending=True, pos="_rec")
    last = pos.where(F.col("_rec") < maxlen)
    seq = last.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct(F.col("_rec"), F.col(value)))).alias("_l"))
    vals = F.reverse(F.transform("_l", lambda s: s[value].cast("double")))
    padded = F.concat(F.array_repeat(F.lit(float(pad)), F.lit(maxlen) - F.size(vals)), vals)
    return seq.select(parent, padded.alias(name))


def max_scale(df: DataFrame, cols_: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Divide each column by its maximum (one aggregate)."""
    mx = df.agg(*[F.max(c).alias(c) for c in cols_]).first()
    return df.select("*", *[F.try_divide(F.col(c), F.lit(mx[c])).alias(f"{c}{suffix}") for c in cols_])


def nb_ratios(long: DataFrame, doc: str, feature: str, value: str, labels: DataFrame, label: str) -> DataFrame:
    """C19 fit: naive-Bayes log-count ratio per feature
    ``r = ln((sum x|y=1 + 1) / (n1 + 1)) - ln((sum x|y=0 + 1) / (n0 + 1))``."""
    # an outer join whose hits are kept by a condition that the optimiser leaves where it is, not an inner join:
    # that would put a filter below the exchange of ``long``, which the apply could then not share
    hit = F.when(F.spark_partition_id() >= 0, F.col("_hit"))
    j = long.join(labels.select(doc, label, F.lit(True).alias("_hit")), doc, "left").where(hit)
    cnt = labels.groupBy(label).count().collect()
    n = {r[label]: r["count"] for r in cnt}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    r = j.groupBy(feature).agg(F.sum(F.when(F.col(label) == 1, F.col(value)).otherwise(0)).alias("_p"),
                               F.sum(F.when(F.col(label) == 0, F.col(value)).otherwise(0)).alias("_q"))
    return r.select(feature, (F.log((F.col("_p") + 1) / F.lit(n1 + 1)) - F.log((F.col("_q") + 1) / F.lit(n0 + 1)))
                    .alias("nb_ratio"))


def packed(long: DataFrame, doc: str, feature: str, value: str) -> DataFrame:
    """(feature, ``_docs``, ``_values``): the rows of ``long``, those of one feature among each task's next
    ``TASK_TERMS`` rows as one. The feature crosses the exchange of a join once for all of them, and no list
    is longer, however common the feature. In Python, as no expression groups inside a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(some):
            t = pa.Table.from_batches(some).group_by(feature, use_threads=False).aggregate([(doc, "list"), (value, "list")])
            yield from t.select([feature, f"{doc}_list", f"{value}_list"]).rename_columns(
                [feature, "_docs", "_values"]).to_batches(max_chunksize=10_000)

        some, rows = [], 0
        for b in batches:
            some.append(b)
            rows += b.num_rows
            if rows >= TASK_TERMS:
                yield from pack(some)
                some, rows = [], 0
        if rows:
            yield from pack(some)

    rows, kind = long.select(feature, doc, value), {f.name: f.dataType for f in long.schema.fields}
    return rows.mapInArrow(run, T.StructType([T.StructField(feature, kind[feature]), T.StructField("_docs", T.ArrayType(kind[doc])),
                                              T.StructField("_values", T.ArrayType(kind[value]))]))


def nb_log_ratio(long: DataFrame, doc: str, feature: str, value: str, ratios: DataFrame, name: str = "nb") -> DataFrame:
    """C19 apply: the fitted ratio multiplied into x, long format; features
    that were not fitted are dropped."""
    j = packed(long, doc, feature, value).join(ratios, feature)
    return j.select(feature, "nb_ratio", F.explode(F.arrays_zip("_docs", "_values")).alias("_e")).select(
        F.col("_e._docs").alias(doc), feature, (F.col("_e._values") * F.col("nb_ratio")).alias(name))

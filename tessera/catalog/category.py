"""Registered category / text / embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.events import EV, events_df
from tessera.catalog.registry import register, table
from tessera.functions.columns import rnd
from tessera.operators import category as C
from tessera.operators import sampling as H

PART_NULL_BRAND = "CASE WHEN p_size <= 45 THEN p_brand END"


@register("C01_label_encode", sql=f"""
WITH p AS (SELECT p_partkey, p_type, {PART_NULL_BRAND} AS brand FROM part)
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type_label,
  CAST(CASE WHEN brand IS NULL THEN (SELECT count(DISTINCT brand) FROM p)
       ELSE dense_rank() OVER (ORDER BY brand) - 1 END AS BIGINT) AS brand_label
FROM p""")
def c01(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", F.expr(PART_NULL_BRAND).alias("brand"))
    out = C.label_encode(C.label_encode(p, "p_type"), "brand")
    return out.select("p_partkey", "p_type_label", "brand_label")


@register("C02_frequency_ordinal", sql=f"""
WITH c AS (SELECT k, count(*) AS cnt FROM {EV} e WHERE k <> 0 GROUP BY k),
r AS (SELECT k, row_number() OVER (ORDER BY cnt, k) AS rk FROM c)
SELECT e.event_id, CAST(CASE WHEN e.k = 0 THEN -1 ELSE r.rk END AS BIGINT) AS k_freq_rank
FROM {EV} e LEFT JOIN r USING (k)""")
def c02(spark, sf):
    out = C.frequency_ordinal(events_df(spark, sf), "k", na_values=[0])
    return out.select("event_id", "k_freq_rank")


SEGMENTS = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NA_NOT_FOUND"]


@register("C03_one_hot_dense", sql="""
SELECT c_custkey, """ + ", ".join(
    f"CAST(coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, 'NA_NOT_FOUND') = '{v}' "
    f"AS INTEGER) AS seg_{v}" for v in SEGMENTS) + " FROM customer")
def c03(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING",
                                                                F.col("c_mktsegment")).alias("seg"))
    out = C.one_hot_dense(c, "seg")
    return out.select("c_custkey", *[f"seg_{v}" for v in SEGMENTS])


@register("C04_one_hot_sparse")
def c04(spark, sf):
    ev = events_df(spark, sf).select("event_id", "user_id")
    return C.one_hot_sparse(ev, "user_id")


@register("C05_rare_category_fold", sql=f"""
WITH c AS (SELECT k, count(*) AS cnt FROM {EV} e GROUP BY k),
t AS (SELECT CASE WHEN count(*) > 50 THEN avg(cnt) * 0.9 ELSE 20 END AS thr FROM c)
SELECT e.event_id, CASE WHEN c.cnt < t.thr THEN 'RARE_VALUE' ELSE CAST(e.k AS VARCHAR) END AS k_folded
FROM {EV} e JOIN c USING (k), t""")
def c05(spark, sf):
    out = C.rare_fold(events_df(spark, sf), "k", threshold=20, adaptive_distinct=50, pct=0.9)
    return out.select("event_id", "k_folded")


@register("C06_shared_vocabulary", sql=f"""
WITH b AS (SELECT user_id FROM {EV} a WHERE day <= 24 INTERSECT SELECT user_id FROM {EV} b WHERE day > 24)
SELECT e.event_id, CASE WHEN b.user_id IS NOT NULL THEN CAST(e.user_id AS VARCHAR) ELSE 'unknown' END AS user_id_shared
FROM {EV} e LEFT JOIN b USING (user_id)""")
def c06(spark, sf):
    out = C.shared_vocabulary(events_df(spark, sf), "user_id", F.expr("day <= 24"))
    return out.select("event_id", "user_id_shared")


@register("C07_feature_hashing")
def c07(spark, sf):
    ev = events_df(spark, sf).select("event_id", "event_type", F.col("k").cast("string").alias("k"),
                                     F.col("hr").cast("string").alias("hr"))
    return C.feature_hash(ev, ["event_type", "k", "hr"], n=100).select("event_id", "hashed")


TAGS = "concat(replace(p_name, ' ', ','), ',', p_type, ',', p_brand)"


@register("C08_tag_counts", sql=f"""
WITH t AS (SELECT p_partkey, unnest(list_filter(string_split({TAGS}, ','), lambda s: s <> '')) AS tag FROM part),
c AS (SELECT p_partkey, tag, count(*) AS cnt FROM t GROUP BY ALL)
SELECT * FROM c WHERE tag IN (SELECT tag FROM c GROUP BY tag HAVING count(*) >= 2)""")
def c08(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(TAGS).alias("tags"))
    return C.tag_counts(p, "p_partkey", "tags", min_df=2)


@register("C09_tfidf_word_ngrams", sql="""
WITH t AS (SELECT conv_id * 1000 + turn AS doc, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda s: s <> '') AS w
           FROM conversations),
g AS (SELECT doc, w[i] AS term FROM t, range(1, len(w) + 1) r(i)
      UNION ALL SELECT doc, w[i] || ' ' || w[i + 1] FROM t, range(1, len(w)) r(i)),
tf AS (SELECT doc, term, count(*) AS tf FROM g GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM conversations),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (SELECT term, df FROM st, nd WHERE df >= 2 AND df <= 0.9 * nd.n ORDER BY cf DESC, term LIMIT 3000),
w AS (SELECT tf.doc, tf.term, (1 + ln(tf.tf)) * (ln((1 + nd.n) / (1 + vocab.df)) + 1) AS w FROM tf JOIN vocab USING (term), nd)
SELECT doc, term, RND(w / sqrt(sum(w * w) OVER (PARTITION BY doc))) AS tfidf FROM w""", headline=True)
def c09(spark, sf):
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    terms = C.word_terms(conv, "doc", "text", ngram=(1, 2))
    out = C.tfidf(terms, "doc", conv.count(), min_df=2, max_df=0.9, max_features=3000)
    return out.select("doc", "term", rnd("tfidf").alias("tfidf"))


@register("C09_tfidf_char_ngrams", sql="""
WITH g AS (SELECT p_partkey AS doc, substr(p_name, i, n) AS term FROM part, range(2, 6) a(n), range(1, 200) b(i)
           WHERE i <= length(p_name) - n + 1),
tf AS (SELECT doc, term, count(*) AS tf FROM g GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM part),
st AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc, tf.term, (1 + ln(tf.tf)) * (ln((1 + nd.n) / (1 + st.df)) + 1) AS w FROM tf JOIN st USING (term), nd)
SELECT doc, term, RND(w / sqrt(sum(w * w) OVER (PARTITION BY doc))) AS tfidf FROM w""")
def c09c(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), "p_name")
    terms = C.char_terms(p, "doc", "p_name", ngram=(2, 5))
    return C.tfidf(terms, "doc", p.count()).select("doc", "term", rnd("tfidf").alias("tfidf"))


@register("C09_tfidf_train_test", sql=r"""
WITH c AS (SELECT conv_id, conv_id * 1000 + turn AS doc, strip_accents(lower(text)) AS t FROM conversations),
w AS (SELECT conv_id, doc, list_filter(string_split_regex(t, '[^\p{L}\p{N}_]+'),
             lambda s: s <> '' AND NOT list_contains(['the', 'of', 'and', 'a', 'to', 'in', 'de', 'la'], s)) AS w FROM c),
g AS (SELECT conv_id, doc, w[i] AS term FROM w, range(1, len(w) + 1) r(i)),
tf AS (SELECT conv_id, doc, term, count(*) AS tf FROM g GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM conversations WHERE conv_id % 4 <> 0),
idf AS (SELECT term, ln((1 + max(nd.n)) / (1 + count(*))) + 1 AS idf FROM tf, nd WHERE conv_id % 4 <> 0 GROUP BY term HAVING count(*) >= 2),
x AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term) WHERE conv_id % 4 = 0)
SELECT doc, term, RND(w / sqrt(sum(w * w) OVER (PARTITION BY doc))) AS tfidf FROM x""")
def c09_train_test(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    train, test = conv.where("conv_id % 4 <> 0"), conv.where("conv_id % 4 = 0")
    how = {"stop_words": ["the", "of", "and", "a", "to", "in", "de", "la"], "accents": False}
    idf = C.tfidf_fit(C.word_terms(train, "doc", "text", **how), train.count(), min_df=2)
    out = C.tfidf_apply(C.word_terms(test, "doc", "text", **how), "doc", idf)
    return out.select("doc", "term", rnd("tfidf").alias("tfidf"))


@register("C10_category2vec")
def c10(spark, sf):
    ev = events_df(spark, sf)
    return C.category2vec(ev, "event_id", ["event_type", "k", "hr"], size=8)


@register("C11_key_value_document", sql=f"""
WITH b AS (SELECT user_id, event_type, count(*) AS cnt FROM {EV} e GROUP BY ALL)
SELECT user_id, string_agg(event_type || ':' || CAST(cnt AS VARCHAR), ' ' ORDER BY event_type) AS doc
FROM b GROUP BY user_id""")
def c11(spark, sf):
    d = C.key_value_document(events_df(spark, sf), "user_id", "event_type")
    return d.select("user_id", F.array_join(F.transform("doc", lambda s: F.concat(s["v"], F.lit(":"),
                                                                                    s["cnt"].cast("string"))), " ")
                    .alias("doc"))


@register("C12_lda_topics")
def c12(spark, sf):
    return C.lda_topics(events_df(spark, sf), "user_id", "k", k=5, max_iter=5)


@register("C13_svd_embedding")
def c13(spark, sf):
    return C.svd_embedding(events_df(spark, sf), "user_id", "k", k=5)


@register("C14_nmf_embedding")
def c14(spark, sf):
    return C.nmf_embedding(events_df(spark, sf), "user_id", "k", k=4, max_iter=5)


PAIRS = [(a, b) for a in ("event_type", "k", "hr") for b in ("event_type", "k", "hr") if a != b]


def _pair_rows(factor, k):
    return factor.select(F.col("_g").alias("pair"), F.col("_r").alias("key"), *[F.col(f"_{i}").alias(f"dim_{i}") for i in range(k)])


@register("C12_topics_all_pairs")
def c12_pairs(spark, sf):
    return _pair_rows(C.topic_pairs(events_df(spark, sf), PAIRS, k=5, max_iter=5), 5)


@register("C13_svd_all_pairs")
def c13_pairs(spark, sf):
    return _pair_rows(C.svd_pairs(events_df(spark, sf), PAIRS, k=3), 3)


@register("C14_nmf_all_pairs")
def c14_pairs(spark, sf):
    return _pair_rows(C.nmf_pairs(events_df(spark, sf), PAIRS, k=4, max_iter=5), 4)


@register("C15_tag_click_rate_svd")
def c15(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    li = li.select(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in
                                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                              "l_quantity", "l_extendedprice", "l_shipdate")])).alias("rid"),
                   F.expr(TAGS).alias("tags"), "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return C.tag_rate_embedding(li, "rid", "tags", "l_suppkey", "y", k=4)


@register("C16_mf_oof_feature")
def c16(spark, sf):
    ev = H.kfold(events_df(spark, sf), "event_id", 3, seed=7)
    return C.mf_oof_feature(ev, "user_id", "k", "y", "fold", 3).select("event_id", "mf_score")


@register("C16_fm_side_features")
def c16_fm(spark, sf):
    ev = H.kfold(events_df(spark, sf), "event_id", 3, seed=7)
    return C.fm_oof_feature(ev, "event_id", "user_id", "k", "y", "fold", 3, side=["day"], numeric=["hr", "value"],
                            buckets=1 << 14, max_iter=30)


@register("C17_sequence_builder", sql="""
WITH r AS (SELECT o_custkey, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS rec FROM orders),
l AS (SELECT o_custkey, list(o_totalprice ORDER BY rec DESC) FILTER (WHERE rec < 5) AS s FROM r GROUP BY o_custkey),
p AS (SELECT o_custkey, list_concat(list_transform(range(5 - len(s)), lambda x: 0.0), s) AS s FROM l)
SELECT o_custkey, s[1] AS s_0, s[2] AS s_1, s[3] AS s_2, s[4] AS s_3, s[5] AS s_4 FROM p""")
def c17(spark, sf):
    o = table(spark, sf, "orders")
    seq = C.sequence_builder(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 5, pad=0.0, name="s")
    return seq.select("o_custkey", *[F.col("s")[i].alias(f"s_{i}") for i in range(5)])


@register("C18_max_scale", sql="""
SELECT p_partkey, RND(p_retailprice / max(p_retailprice) OVER ()) AS p_retailprice_scaled,
  RND(p_size / max(p_size) OVER ()) AS p_size_scaled FROM part""")
def c18(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    out = C.max_scale(p, ["p_retailprice", "p_size"])
    return out.select("p_partkey", rnd("p_retailprice_scaled").alias("p_retailprice_scaled"),
                      rnd("p_size_scaled").alias("p_size_scaled"))


@register("C19_naive_bayes_ratio", sql="""
WITH t AS (SELECT d.doc_id, unnest(list_filter(string_split_regex(lower(d.text), '[^\\p{L}\\p{N}_]+'), lambda s: s <> '')) AS term
           FROM documents d),
tf AS (SELECT doc_id, term, count(*) AS x FROM t GROUP BY ALL),
j AS (SELECT tf.*, l.toxic FROM tf JOIN labels l USING (doc_id)),
n AS (SELECT count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0 FROM labels)
SELECT term, RND(ln((coalesce(sum(x) FILTER (WHERE toxic = 1), 0) + 1) / (any_value(n.n1) + 1))
               - ln((coalesce(sum(x) FILTER (WHERE toxic = 0), 0) + 1) / (any_value(n.n0) + 1))) AS nb_ratio
FROM j, n GROUP BY term""")
def c19(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    terms = C.word_terms(docs, "doc_id", "text").withColumnRenamed("tf", "x")
    r = C.nb_ratios(terms, "doc_id", "term", "x", labels, "toxic")
    return r.select("term", rnd("nb_ratio").alias("nb_ratio"))


@register("C19_naive_bayes_feature", sql="""
WITH t AS (SELECT d.doc_id, unnest(list_filter(string_split_regex(lower(d.text), '[^\\p{L}\\p{N}_]+'), lambda s: s <> '')) AS term
           FROM documents d),
tf AS (SELECT doc_id, term, count(*) AS x FROM t GROUP BY ALL),
n AS (SELECT count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0 FROM labels),
r AS (SELECT term, ln((coalesce(sum(x) FILTER (WHERE toxic = 1), 0) + 1) / (any_value(n.n1) + 1))
               - ln((coalesce(sum(x) FILTER (WHERE toxic = 0), 0) + 1) / (any_value(n.n0) + 1)) AS r
      FROM tf JOIN labels l USING (doc_id), n GROUP BY term)
SELECT doc_id, term, RND(x * r) AS nb FROM tf JOIN r USING (term)""")
def c19_feature(spark, sf):
    """The form multiplied into x, for every document (labelled or not)."""
    terms = C.word_terms(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("tf", "x")
    ratios = C.nb_ratios(terms, "doc_id", "term", "x", table(spark, sf, "labels"), "toxic")
    out = C.nb_log_ratio(terms, "doc_id", "term", "x", ratios)
    return out.select("doc_id", "term", rnd("nb").alias("nb"))

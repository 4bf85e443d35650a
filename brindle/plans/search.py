"""Retrieval queries over documents, benchmark passages, parts and embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import index as ix
from ..operators import metrics as mt
from ..operators import retrieval as rt
from .registry import _sql, query, relation, table, values

FIELDS = {"title": "title", "body": "body"}
WEIGHTS = {"title": 6.0, "body": 1.0}
DEPTH = 50


def corpus_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The session's index of the documents, built by the first query that needs it."""
    return ix.kept(table(spark, sf_dir, "documents"), titled, FIELDS, "documents")


def titled(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, title, body): the first line and the rest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.regexp_extract(text, r"^([^\n]*)", 1).alias("title"), F.regexp_replace(text, r"^[^\n]*\n?", "").alias("body"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_STOP = _sql(list(vocab.STOPWORDS))
#: Common parts of the SQL twins.
CORPUS_SQL = r"""
corpus AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^([^\n]*)', 1) AS title, regexp_replace(coalesce(text, ''), '^[^\n]*\n?', '') AS body FROM documents),
toks AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(title)), '[\p{L}\p{N}]+') AS tt, regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+') AS bt FROM corpus),
size AS (SELECT count(*) AS n_docs, avg(len(tt) + len(bt)) AS mean_d FROM toks),
post AS (SELECT doc_id, len(tt) + len(bt) AS d, unnest(list_concat(list_transform(tt, lambda x: {'t': x, 'w': 6.0::DOUBLE}), list_transform(bt, lambda x: {'t': x, 'w': 1.0::DOUBLE}))) AS p FROM toks),
tf AS (SELECT doc_id, p.t AS term, sum(p.w) AS f, min(d) AS d FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"""
TERMS_SQL = f"""
qterm AS (SELECT item_id AS query_id, unnest(list_slice(u, 1, 40)) AS term FROM (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(ts), lambda x: {{'p': list_position(ts, x), 't': x}})), lambda x: x.t) AS u FROM
  (SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains({_STOP}, t)) AS ts FROM benchmark)))"""


#: The same with all of a query's terms.
ALL_TERMS_SQL = TERMS_SQL.replace("list_slice(u, 1, 40)", "u")


def _bm25_sql(terms: str, n: int, name: str) -> str:
    return f"""
{name}_all AS (SELECT q.query_id, tf.doc_id, round(sum(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean_d))), 6) AS score
  FROM {terms} q JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, score FROM {name}_all QUALIFY rank <= {n})"""


def bm25_leg(spark: SparkSession, sf_dir: str, n: int, most: int | None = vocab.MAX_QUERY_TERMS) -> DataFrame:
    return ix.bm25(corpus_index(spark, sf_dir), rt.query_terms(searches(spark, sf_dir), most=most), n, WEIGHTS)


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 10, 'bm')} SELECT * FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_leg(spark, sf_dir, 10)


_GRAM_SQL = f"""
qtok AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM benchmark),
qg AS (SELECT query_id, list_filter(flatten(list_transform([6, 5, 4, 3, 2], lambda n: list_transform(range(0, greatest(0, len(ts) - n + 1)), lambda i: ts[i + 1 : i + n]))), lambda g: len(list_filter(g, lambda t: NOT list_contains({_STOP}, t))) > 0) AS gs FROM qtok),
qj AS (SELECT query_id, list_transform(gs, lambda g: array_to_string(g, ' ')) AS gs FROM qg),
qgram AS (SELECT query_id, unnest(list_slice(list_sort(list_transform(list_distinct(gs), lambda g: {{'p': list_position(gs, g), 'g': g}})), 1, 24)) AS s FROM qj),
grams AS (SELECT query_id, s.g AS gram, row_number() OVER (PARTITION BY query_id ORDER BY s.p) - 1 AS k FROM qgram),
have AS (SELECT DISTINCT doc_id, unnest(list_distinct(flatten(list_transform([6, 5, 4, 3, 2], lambda n: list_transform(range(0, greatest(0, len(f) - n + 1)), lambda i: array_to_string(f[i + 1 : i + n], ' ')))))) AS gram
  FROM (SELECT doc_id, tt AS f FROM toks UNION ALL SELECT doc_id, bt FROM toks)),
hit AS (SELECT * FROM have WHERE gram IN (SELECT gram FROM grams)),
rare AS (SELECT gram FROM hit GROUP BY gram HAVING count(*) <= 150),
ph_all AS (SELECT query_id, doc_id, sum(len(string_split(gram, ' ')) * len(string_split(gram, ' ')))::DOUBLE AS score, min(k) AS k FROM grams JOIN hit USING (gram) JOIN rare USING (gram) GROUP BY ALL),
ph AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k, doc_id)::INT AS rank, score FROM ph_all QUALIFY rank <= {{n}})"""


def phrase_leg(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return ix.phrases(corpus_index(spark, sf_dir), rt.query_grams(searches(spark, sf_dir)), n)


@query(f"WITH {CORPUS_SQL}, {_GRAM_SQL.replace('{n}', '10')} SELECT * FROM ph")
def phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_leg(spark, sf_dir, 10)


@query("""SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, d.vec_id)::INT AS rank
FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every vector whose id is divisible by 100, against all vectors."""
    return _nearest(spark, sf_dir, 10)


def _nearest(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rt.dense(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), queries, n)


_PRF_SQL = f"""
seedtop AS (SELECT query_id, doc_id FROM bm WHERE rank <= 10),
words AS (SELECT doc_id, term FROM tf WHERE len(term) >= 3 AND regexp_full_match(term, '[a-z0-9]+') AND NOT regexp_full_match(term, '[0-9]+') AND NOT list_contains({_STOP}, term)),
near AS (SELECT query_id, term, count(*) AS fdf FROM seedtop JOIN words USING (doc_id) WHERE (query_id, term) NOT IN (SELECT query_id, term FROM qterm) GROUP BY ALL HAVING count(*) >= 3),
prf AS (SELECT query_id, term, fdf, round(fdf * ln(n_docs / df), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(fdf * ln(n_docs / df), 6) DESC, term)::INT AS rank FROM near JOIN df USING (term), size WHERE ln(n_docs / df) > 0 QUALIFY rank <= 8),
more AS (SELECT query_id, term FROM qterm UNION SELECT query_id, term FROM prf)"""


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 50, 'bm')}, {_PRF_SQL} SELECT * FROM prf")
def prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback(spark, sf_dir)


def _feedback(spark: SparkSession, sf_dir: str, most: int | None = vocab.MAX_QUERY_TERMS) -> DataFrame:
    return ix.feedback_terms(corpus_index(spark, sf_dir), bm25_leg(spark, sf_dir, vocab.PRF_DOCS, most), rt.query_terms(searches(spark, sf_dir), most=most))


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 50, 'bm')}, {_PRF_SQL}, {_bm25_sql('more', 10, 'pr')} SELECT * FROM pr")
def prf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prf_leg(spark, sf_dir, 10)


_LEGS_SQL = """
legs AS (SELECT query_id, doc_id, 0 AS leg, rank FROM bm UNION ALL SELECT query_id, doc_id, 1, rank FROM ph),
pop AS (SELECT doc_id, length(coalesce(text, '')) AS popularity FROM documents)"""


def two_legs(spark: SparkSession, sf_dir: str, n: int = DEPTH) -> DataFrame:
    return rt.union_of_legs([bm25_leg(spark, sf_dir, n), phrase_leg(spark, sf_dir, n)])


@query("""WITH cand AS (SELECT p_brand AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part QUALIFY r <= 30),
n AS (SELECT l_partkey AS doc_id, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT query_id, doc_id, coalesce(c, 0)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(c, 0) DESC, r, doc_id)::INT AS rank FROM cand LEFT JOIN n USING (doc_id)""")
def popularity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_retailprice")
    cand = rt.top_n(part, 30, F.col("p_retailprice"), F.col("doc_id"))
    popular = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("popularity"))
    return rt.popularity(rt.union_of_legs([cand]), popular)


_FUSE_SQL = """
fa AS (SELECT {keys}query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, min(leg * 1000000 + rank) AS first_at FROM {legs} WHERE w > 0 GROUP BY ALL),
fused AS (SELECT {keys}query_id, doc_id, row_number() OVER (PARTITION BY {keys}query_id ORDER BY score DESC, first_at, doc_id)::INT AS rank, score FROM fa QUALIFY rank <= {n})"""


@query(
    f"WITH {CORPUS_SQL}, {ALL_TERMS_SQL}, {_bm25_sql('qterm', 50, 'bm')}, {_GRAM_SQL.replace('{n}', '50')}, {_PRF_SQL}, {_bm25_sql('more', 50, 'pr')}, {_LEGS_SQL},"
    " three AS (SELECT * FROM legs UNION ALL SELECT query_id, doc_id, 2, rank FROM pr),"
    " firsts AS (SELECT query_id, doc_id, min(leg * 1000000 + rank) AS first_at FROM three GROUP BY ALL),"
    " popleg AS (SELECT query_id, doc_id, 3 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, first_at, doc_id) AS rank FROM firsts JOIN pop USING (doc_id)),"
    " weighed AS (SELECT *, [2.0, 2.0, 0.5, 0.5][leg + 1] AS w FROM (SELECT * FROM three UNION ALL SELECT * FROM popleg)),"
    + _FUSE_SQL.format(keys="", legs="weighed", n=10)
    + " SELECT * FROM fused"
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25, phrase, feedback and popularity legs, fused with weights 2, 2, 0.5, 0.5; all terms of a query count."""
    three = rt.union_of_legs([bm25_leg(spark, sf_dir, DEPTH, None), phrase_leg(spark, sf_dir, DEPTH), _prf_leg(spark, sf_dir, DEPTH, None)])
    popular = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("popularity"))
    leg = rt.popularity(three, popular)
    legs = three.unionByName(leg.select("query_id", "doc_id", F.lit(3).alias("leg"), "rank"))
    return rt.fused(legs, [2.0, 2.0, 0.5, 0.5], 10)


def _prf_leg(spark: SparkSession, sf_dir: str, n: int, most: int | None = vocab.MAX_QUERY_TERMS) -> DataFrame:
    terms = rt.expanded(rt.query_terms(searches(spark, sf_dir), most=most), _feedback(spark, sf_dir, most))
    return ix.bm25(corpus_index(spark, sf_dir), terms, n, WEIGHTS)


def sought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): the documents that contain a passage, which its search should find."""
    return ix.containing(corpus_index(spark, sf_dir), table(spark, sf_dir, "documents"), searches(spark, sf_dir).withColumnRenamed("text", "passage"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: BM25 and phrase legs fused, ten documents a query."""
    return rt.fused(two_legs(spark, sf_dir), [2.0, 2.0], 10)


TRUTH_SQL = ", truth AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
#: Evaluation of ``fused`` under the settings of ``grid`` against ``truth``.
EVAL_SQL = """best AS (SELECT setting, query_id, min(rank) AS r FROM fused JOIN truth USING (query_id, doc_id) GROUP BY ALL),
  q AS (SELECT DISTINCT setting, query_id FROM (SELECT DISTINCT setting FROM grid), (SELECT DISTINCT query_id FROM truth)),
  m AS (SELECT setting, round(avg((r IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM q LEFT JOIN best USING (setting, query_id) GROUP BY ALL)
  SELECT setting, hit_rate, mrr, round(mrr - first_value(mrr) OVER (ORDER BY setting), 6) AS delta FROM m"""

_GRID = [(s, leg, w) for s, w in enumerate((0.0, 0.5, 1.0, 2.0, 4.0)) for leg, w in ((0, 2.0), (1, w))]


@query(
    f"WITH {CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 50, 'bm')}, {_GRAM_SQL.replace('{n}', '50')}, {_LEGS_SQL},"
    f" grid AS (SELECT * FROM {values(_GRID, 'setting, leg, w', 'g')}), weighed AS (SELECT * FROM legs JOIN grid USING (leg)),"
    + _FUSE_SQL.format(keys="setting, ", legs="weighed", n=10)
    + f" {TRUTH_SQL}, {EVAL_SQL}"
)
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase weights 0 to 4 evaluated in one job: the grid is a table joined to the legs."""
    legs = two_legs(spark, sf_dir)
    grid = relation(spark, _GRID, "setting int, leg int, weight double")
    results = rt.fused(legs, grid, 10, ("setting", "query_id"))
    truth = sought(spark, sf_dir)
    return mt.evaluated(results, truth, grid.select("setting").distinct())


_PROBE_SQL = (
    f"WITH {CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 2000, 'bm')}, {_GRAM_SQL.replace('{n}', '2000')},"
    " legs AS (SELECT query_id, doc_id, 0 AS leg, rank FROM bm UNION ALL SELECT query_id, doc_id, 1, rank FROM ph), weighed AS (SELECT *, 2.0 AS w FROM legs WHERE rank <= 50),"
    + _FUSE_SQL.format(keys="", legs="weighed", n=30)
    + """, truth AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
  t AS (SELECT query_id, min(f.rank) AS fr, min(b.rank) AS br, min(p.rank) AS pr FROM truth LEFT JOIN fused f USING (query_id, doc_id) LEFT JOIN bm b USING (query_id, doc_id) LEFT JOIN ph p USING (query_id, doc_id) GROUP BY query_id)"""
)
PROBE_DEPTH = 2000


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, fr, br, pr): the best rank of a sought document in the pool of 30 and, to a depth of 2000, in each leg."""
    bm, ph = bm25_leg(spark, sf_dir, PROBE_DEPTH), phrase_leg(spark, sf_dir, PROBE_DEPTH)
    legs = rt.union_of_legs([bm, ph]).where(F.col("rank") <= DEPTH)
    pool, on = rt.fused(legs, [2.0, 2.0], 30), ["query_id", "doc_id"]
    ranks = sought(spark, sf_dir)
    for leg, name in ((pool, "fr"), (bm, "br"), (ph, "pr")):
        ranks = ranks.join(leg.select(*on, F.col("rank").alias(name)), on, "left")
    return ranks.groupBy("query_id").agg(*(F.min(c).alias(c) for c in ("fr", "br", "pr")))


@query(
    _PROBE_SQL
    + """, k AS (SELECT *, CASE WHEN fr <= 10 THEN 'shown' WHEN br IS NULL AND pr IS NULL THEN 'unreachable' WHEN fr IS NULL THEN 'not in pool' ELSE 'below slate' END AS reason, least(br, pr) AS nearest FROM t)
  SELECT reason, CASE WHEN nearest <= 50 THEN '<=50' WHEN nearest <= 500 THEN '51-500' WHEN nearest <= 2000 THEN '501-2000' ELSE 'none' END AS reach, count(*) AS n FROM k GROUP BY ALL"""
)
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a sought document is missing from the slate, and how near the best leg ranks it."""
    reason = F.when(F.col("fr") <= 10, "shown").when(F.col("br").isNull() & F.col("pr").isNull(), "unreachable").when(F.col("fr").isNull(), "not in pool").otherwise("below slate")
    nearest = F.least("br", "pr")
    reach = F.when(nearest <= 50, "<=50").when(nearest <= 500, "51-500").when(nearest <= 2000, "501-2000").otherwise("none")
    return probes(spark, sf_dir).groupBy(reason.alias("reason"), reach.alias("reach")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _PROBE_SQL
    + """, u AS (SELECT 'bm25' AS leg, br AS r FROM t UNION ALL SELECT 'phrase', pr FROM t UNION ALL SELECT 'pool', fr FROM t), o AS (SELECT leg, list_sort(list(r)) AS rs, count(*) AS asked FROM u WHERE r IS NOT NULL GROUP BY leg)
  SELECT leg, len(rs) AS n, rs[len(rs) // 2 + 1]::INT AS upper_median FROM o"""
)
def leg_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leg and the pool: how many sought documents it found, and their upper median rank."""
    ranks = F.array(*(F.struct(F.lit(name).alias("leg"), F.col(c).alias("r")) for name, c in (("bm25", "br"), ("phrase", "pr"), ("pool", "fr"))))
    return mt.upper_median(probes(spark, sf_dir).select(F.inline(ranks)), "r", "leg")


@query("""WITH RECURSIVE pool AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, d.vec_id) AS rank
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 40),
sims AS (SELECT a.query_id, a.rank AS i, b.rank AS j, round(list_dot_product(a.v, b.v), 6) AS s FROM pool a JOIN pool b USING (query_id)),
pick AS (SELECT DISTINCT query_id, [1, 2, 3] AS chosen FROM pool
  UNION ALL SELECT query_id, list_append(chosen, best) FROM (
    SELECT query_id, chosen, (SELECT arg_min(r, (-round(0.5 / r - 0.5 * m, 9), r)) FROM (SELECT s.i AS r, max(s.s) AS m FROM sims s WHERE s.query_id = pick.query_id AND NOT list_contains(pick.chosen, s.i::INT) AND list_contains(pick.chosen, s.j::INT) GROUP BY s.i))::INT AS best
    FROM pick WHERE len(chosen) < 10))
SELECT p.query_id, p.doc_id, list_position(c.chosen, p.rank::INT)::INT AS rank FROM pick c JOIN pool p USING (query_id) WHERE len(c.chosen) = 10 AND list_contains(c.chosen, p.rank::INT)""")
def mmr_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of the forty nearest vectors of each query, by maximal marginal relevance."""
    e = table(spark, sf_dir, "embeddings")
    pool = _nearest(spark, sf_dir, 40).join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id").withColumn("repel", F.lit(-1e9))
    return rt.diversified(pool, 10, 0.5).where("rank <= 10")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), pool AS (SELECT query_id, vec_id AS doc_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(embedding::DOUBLE[], q.v), 6) DESC, vec_id)::INT AS rank
  FROM embeddings JOIN q ON query_id <> vec_id QUALIFY rank <= 40)
SELECT p.query_id, p.doc_id, p.rank, round(max(list_dot_product(p.v, s.v)), 6) AS repel FROM pool p JOIN pool s ON p.query_id = s.query_id AND s.rank <= 5 GROUP BY ALL""")
def shown_repel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each candidate is to the likest of what a query was shown (here its first five)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    pool = _nearest(spark, sf_dir, 40).select("query_id", "doc_id", "rank")
    return rt.repelled(pool.join(e, "doc_id"), pool.where("rank <= 5").join(e, "doc_id")).select("query_id", "doc_id", "rank", "repel")


@query()
def repel_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slates that keep away from what was shown before, by maximal marginal relevance against it."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    pool = _nearest(spark, sf_dir, 40).select("query_id", "doc_id", "rank").join(e, "doc_id")
    return rt.diversified(rt.repelled(pool, pool.where("rank <= 5")), 10, 0.5, within=False)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query_id, unnest(range(0, 12)) AS pos, v FROM q), i AS (SELECT query_id, pos, (query_id * 31 + pos * 977 + 1) % ((SELECT max(vec_id) FROM embeddings) + 500) AS doc_id, v FROM c),
s AS (SELECT i.query_id, i.pos, i.doc_id, round(list_dot_product(e.embedding::DOUBLE[], i.v), 6) AS score FROM i LEFT JOIN embeddings e ON i.doc_id = e.vec_id)
SELECT query_id, doc_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, pos)::INT AS rank FROM s""")
def subset_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given candidates (some without a vector) ranked by likeness; unknown ones follow in their order."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    last = e.agg(F.max("vec_id").alias("last"))
    cand = queries.crossJoin(F.broadcast(last)).select("query_id", "last", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))  # one row
    cand = cand.select("query_id", F.col("pos").cast("long").alias("pos"), ((F.col("query_id") * 31 + F.col("pos") * 977 + 1) % (F.col("last") + 500)).alias("doc_id"))
    return rt.ranked_subset(cand, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), queries)


_RERANK_SQL = """
docs AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(left(coalesce(text, ''), 400)), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS dw FROM documents),
ask AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS qw FROM benchmark),
m AS (SELECT f.query_id, f.doc_id, f.rank, len(list_intersect(qw, dw)) / greatest(1, len(qw)) AS model FROM fused f JOIN ask USING (query_id) JOIN docs USING (doc_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY model DESC, rank) AS again FROM m WHERE rank <= 20),
v AS (SELECT query_id, doc_id, rank, round(1.0 / (60 + rank) + 3.0 / (60 + again), 9) AS value FROM h UNION ALL SELECT query_id, doc_id, rank, NULL FROM m WHERE rank > 20)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC NULLS LAST, rank)::INT AS rank FROM v"""


@query(f"WITH {CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 50, 'bm')}, {_GRAM_SQL.replace('{n}', '50')}, {_LEGS_SQL}, weighed AS (SELECT *, 2.0 AS w FROM legs)," + _FUSE_SQL.format(keys="", legs="weighed", n=30) + "," + _RERANK_SQL)
def rerank_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused pool with its head re-ordered by an injected pair scorer (here: shared words)."""
    pool = rt.fused(two_legs(spark, sf_dir), [2.0, 2.0], 30)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(400)).alias("document"))
    asked = searches(spark, sf_dir).withColumnRenamed("text", "query")
    return rt.reranked(pool.join(asked, "query_id").join(docs, "doc_id"), shared_words)


def shared_words(query: pd.Series, document: pd.Series) -> pd.Series:
    return pd.Series([len(set(q.lower().split()) & set((d or "").lower().split())) / max(1, len(set(q.lower().split()))) for q, d in zip(query, document)], dtype=float)


@query("""WITH pool AS (SELECT user_id AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
shown AS (SELECT user_id AS query_id, event_id AS doc_id FROM events WHERE event_type = 'view')
SELECT query_id, doc_id, rank::INT AS rank, (s.doc_id IS NULL) AS fresh, row_number() OVER (PARTITION BY query_id ORDER BY (s.doc_id IS NULL) DESC, rank)::INT AS place FROM pool p LEFT JOIN shown s USING (query_id, doc_id) QUALIFY place <= 10""")
def slate_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events by value, those not viewed first, ten each."""
    e = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    pool = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), rank.alias("rank"))
    return rt.slate(pool, e.where("event_type = 'view'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id")))


_RAW = [(1, ["3", " 1 ", "3", "", "x", "2"]), (2, [str(i) for i in range(1, 16)]), (3, [])]


@query(f"""WITH e AS (SELECT query_id, trim(ids[i]) AS id, i FROM {values(_RAW, 'query_id, ids')}, unnest(range(1, len(ids) + 1)) u(i)),
f AS (SELECT query_id, id, min(i) - 1 AS pos FROM e WHERE id IN (SELECT p_partkey::VARCHAR FROM part) GROUP BY ALL)
SELECT query_id, id, pos::INT AS pos, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS rank FROM f QUALIFY rank <= 10""")
def answer_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = relation(spark, _RAW, "query_id int, ids array<string>")
    return rt.answers(raw, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))).select("query_id", "id", "pos", "rank")


@query(rf"""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS n_tokens,
len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains({_STOP}, t))) AS n_terms,
len(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+')) AS n_index FROM documents""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda c: F.size(c).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(tx.phrase_tokens(text)).alias("n_tokens"), count(tx.terms(text)).alias("n_terms"), count(tx.index_tokens(text)).alias("n_index"))

"""Parameter sweeps: settings are rows of a small table, and all points of a sweep are evaluated in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import text as tx
from ..functions import vocab
from ..operators import detectors as de
from ..operators import dialogue as dg
from ..operators import index as ix
from ..operators import metrics as mt
from ..operators import policy as po
from ..operators import retrieval as rt
from .analytics import _COLOR_SQL, _ENTROPY_SQL, _ANSWERABLE, entropies, parts
from .language import _TURNS, _plain, all_turns
from .registry import _sql, query, relation, table, values
from .search import (
    _FUSE_SQL, _GRAM_SQL, _LEGS_SQL, _PRF_SQL, _RERANK_SQL, CORPUS_SQL, DEPTH, EVAL_SQL, TERMS_SQL, TRUTH_SQL, WEIGHTS, _bm25_sql, _nearest, _prf_leg, bm25_leg, corpus_index, phrase_leg, searches, shared_words, sought,
    two_legs,
)

_BOTH = f"{CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 50, 'bm')}, {_GRAM_SQL.replace('{n}', '50')}, {_LEGS_SQL}"


_PRF_GRID = [(s, leg, w) for s, x in enumerate((0.0, 0.25, 0.5, 1.0, 2.0)) for leg, w in ((0, 2.0), (1, 2.0), (2, x))]


@query(
    f"WITH {_BOTH}, {_PRF_SQL}, {_bm25_sql('more', 50, 'pr')}, three AS (SELECT * FROM legs UNION ALL SELECT query_id, doc_id, 2, rank FROM pr), grid AS (SELECT * FROM {values(_PRF_GRID, 'setting, leg, w', 'g')}), weighed AS (SELECT * FROM three JOIN grid USING (leg)),"
    + _FUSE_SQL.format(keys="setting, ", legs="weighed", n=10) + f" {TRUTH_SQL}, {EVAL_SQL}"
)
def feedback_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 0 to 2 of the feedback leg."""
    three = rt.union_of_legs([bm25_leg(spark, sf_dir, DEPTH), phrase_leg(spark, sf_dir, DEPTH), _prf_leg(spark, sf_dir, DEPTH)])
    grid = relation(spark, _PRF_GRID, "setting int, leg int, weight double")
    return mt.evaluated(rt.fused(three, grid, 10, ("setting", "query_id")), sought(spark, sf_dir), grid.select("setting").distinct())


_SIZES = [(k, n) for k, n in enumerate((3, 4, 5, 6, 8))]


def _sized_sql() -> str:
    """The phrase leg for each longest gram: its own grams, one list of what documents hold."""
    lists = " UNION ALL ".join(
        f"SELECT query_id, {k} AS setting, list_filter(flatten(list_transform({_sql(list(range(n, 1, -1)))}, lambda n: list_transform(range(0, greatest(0, len(ts) - n + 1)), lambda i: ts[i + 1 : i + n]))), lambda g: len(list_filter(g, lambda t: NOT list_contains({_sql(list(vocab.STOPWORDS))}, t))) > 0) AS gs FROM qtok"
        for k, n in _SIZES
    )
    return f"""qtok AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM benchmark), qg AS ({lists}),
qj AS (SELECT query_id, setting, list_transform(gs, lambda g: array_to_string(g, ' ')) AS gs FROM qg),
qgram AS (SELECT query_id, setting, unnest(list_slice(list_sort(list_transform(list_distinct(gs), lambda g: {{'p': list_position(gs, g), 'g': g}})), 1, 24)) AS s FROM qj),
grams AS (SELECT query_id, setting, s.g AS gram, row_number() OVER (PARTITION BY query_id, setting ORDER BY s.p) - 1 AS k FROM qgram),
have AS (SELECT DISTINCT doc_id, unnest(list_distinct(flatten(list_transform([8, 7, 6, 5, 4, 3, 2], lambda n: list_transform(range(0, greatest(0, len(f) - n + 1)), lambda i: array_to_string(f[i + 1 : i + n], ' ')))))) AS gram FROM (SELECT doc_id, tt AS f FROM toks UNION ALL SELECT doc_id, bt FROM toks)),
hit AS (SELECT * FROM have WHERE gram IN (SELECT gram FROM grams)), rare AS (SELECT gram FROM hit GROUP BY gram HAVING count(*) <= 150),
ph_all AS (SELECT setting, query_id, doc_id, sum(len(string_split(gram, ' ')) * len(string_split(gram, ' ')))::DOUBLE AS score, min(k) AS k FROM grams JOIN hit USING (gram) JOIN rare USING (gram) GROUP BY ALL),
ph AS (SELECT setting, query_id, doc_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, k, doc_id)::INT AS rank FROM ph_all QUALIFY rank <= 50)"""


def _sized_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(setting, query_id, doc_id, rank) of BM25 and phrases up to each length."""
    asked, out = searches(spark, sf_dir), None
    for k, n in _SIZES:
        part = rt.query_grams(asked, sizes=tuple(range(n, 1, -1))).withColumn("setting", F.lit(k))
        out = part if out is None else out.unionByName(part)
    keys = ("setting", "query_id")
    ph = ix.phrases(corpus_index(spark, sf_dir), out, DEPTH, keys=keys).select(*keys, "doc_id", F.lit(1).alias("leg"), "rank")
    bm = bm25_leg(spark, sf_dir, DEPTH).crossJoin(F.broadcast(relation(spark, [(k,) for k, _ in _SIZES], "setting int")))
    return rt.fused(ph.unionByName(bm.select(*keys, "doc_id", F.lit(0).alias("leg"), "rank")), [2.0, 2.0], 10, keys)


_SIZED_SQL = (
    f"WITH {CORPUS_SQL}, {TERMS_SQL}, {_bm25_sql('qterm', 50, 'bm')}, {_sized_sql()}, grid AS (SELECT * FROM {values(_SIZES, 'setting, size', 'g')}),"
    " weighed AS (SELECT setting, query_id, doc_id, 0 AS leg, rank, 2.0 AS w FROM bm, grid UNION ALL SELECT setting, query_id, doc_id, 1, rank, 2.0 FROM ph),"
    + _FUSE_SQL.format(keys="setting, ", legs="weighed", n=10) + f" {TRUTH_SQL}"
)


@query(f"{_SIZED_SQL}, {EVAL_SQL}")
def phrase_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest grams of 3 to 8 tokens."""
    grid = relation(spark, [(k,) for k, _ in _SIZES], "setting int")
    return mt.evaluated(_sized_results(spark, sf_dir), sought(spark, sf_dir), grid)


@query(
    f"{_SIZED_SQL}, h AS (SELECT DISTINCT setting, query_id FROM fused JOIN truth USING (query_id, doc_id)), q AS (SELECT DISTINCT setting, query_id FROM grid, truth), o AS (SELECT setting, query_id, h.query_id IS NOT NULL AS hit FROM q LEFT JOIN h USING (setting, query_id))"
    " SELECT a.setting, count(CASE WHEN a.hit AND NOT b.hit THEN 1 END) AS won, count(CASE WHEN b.hit AND NOT a.hit THEN 1 END) AS lost, count(*) AS n FROM o a JOIN o b ON a.query_id = b.query_id AND b.setting = 3 GROUP BY a.setting"
)
def phrase_size_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries each length wins and loses against the shipped one of 6."""
    truth = sought(spark, sf_dir)
    hits = _sized_results(spark, sf_dir).join(truth, ["query_id", "doc_id"]).select("setting", "query_id").distinct().withColumn("hit", F.lit(True))
    grid = F.broadcast(relation(spark, [(k,) for k, _ in _SIZES], "setting int"))
    o = truth.select("query_id").distinct().crossJoin(grid).join(hits, ["setting", "query_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    base = F.max(F.when(F.col("setting") == 3, F.col("hit"))).over(Window.partitionBy("query_id"))
    n = lambda c: F.count(F.when(c, 1))
    return o.withColumn("base", base).groupBy("setting").agg(n(F.col("hit") & ~F.col("base")).alias("won"), n(F.col("base") & ~F.col("hit")).alias("lost"), F.count(F.lit(1)).alias("n"))


_FIELD_GRID = [(0, 6.0, 1.0), (1, 3.0, 1.0), (2, 12.0, 1.0), (3, 6.0, 0.5), (4, 6.0, 2.0)]


@query(
    f"""WITH corpus AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^([^\\n]*)', 1) AS title, regexp_replace(coalesce(text, ''), '^[^\\n]*\\n?', '') AS body FROM documents),
toks AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(title)), '[\\p{{L}}\\p{{N}}]+') AS tt, regexp_extract_all(strip_accents(lower(body)), '[\\p{{L}}\\p{{N}}]+') AS bt FROM corpus), size AS (SELECT count(*) AS n_docs, avg(len(tt) + len(bt)) AS mean_d FROM toks), {TERMS_SQL},
grid AS (SELECT * FROM {values(_FIELD_GRID, 'setting, wt, wb', 'g')}), post AS (SELECT doc_id, len(tt) + len(bt) AS d, unnest(list_concat(list_transform(tt, lambda x: {{'t': x, 'a': 1, 'b': 0}}), list_transform(bt, lambda x: {{'t': x, 'a': 0, 'b': 1}}))) AS p FROM toks),
tf AS (SELECT doc_id, p.t AS term, sum(p.a) AS a, sum(p.b) AS b, min(d) AS d FROM post GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT setting, q.query_id, tf.doc_id, a * wt + b * wb AS f, d, df, n_docs, mean_d FROM qterm q JOIN tf USING (term) JOIN df USING (term), size, grid),
t AS (SELECT setting, query_id, doc_id, round(sum(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean_d))), 6) AS score FROM s GROUP BY ALL),
fused AS (SELECT setting, query_id, doc_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, doc_id) AS rank FROM t QUALIFY rank <= 10) {TRUTH_SQL}, {EVAL_SQL}"""
)
def field_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field weight halved and doubled."""
    grid = relation(spark, [(s, [a, b]) for s, a, b in _FIELD_GRID], "setting int, weights array<double>")
    found = ix.bm25_grid(corpus_index(spark, sf_dir), rt.query_terms(searches(spark, sf_dir)), 10, grid)
    return mt.evaluated(found, sought(spark, sf_dir), grid)


@query()
def field_weight_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate descent over the field weights: every setting that was tried, its score and whether it was reached."""
    index, terms, truth = corpus_index(spark, sf_dir), rt.query_terms(searches(spark, sf_dir)), sought(spark, sf_dir)

    def evaluate(settings: list[list[float]]) -> list[float]:
        grid = relation(spark, list(enumerate(settings)), "setting int, weights array<double>")
        rows = mt.evaluated(ix.bm25_grid(index, terms, 10, grid), truth, grid).collect()  # one row a setting
        scores = {r["setting"]: 0.5 * r["hit_rate"] + 0.3 * r["mrr"] for r in rows}
        return [scores.get(k, 0.0) for k in range(len(settings))]

    reached, log = mt.coordinate_descent(evaluate, [WEIGHTS[f] for f in index.fields])
    return relation(spark, [(w, round(s, 6), w == reached) for w, s in log], "weights array<double>, score double, reached boolean")


_RATIOS = [(k, 0.25 * k) for k in range(7)]


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS doc_id, q.label = e.label AS same, round(list_dot_product(e.embedding::DOUBLE[], q.v), 6) AS a, round(list_dot_product((e.embedding::DOUBLE[])[1:32], q.v[1:32]), 6) AS b FROM embeddings e JOIN q ON query_id <> vec_id),
two AS (SELECT query_id, doc_id, same, 0 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, doc_id) AS rank FROM s QUALIFY rank <= 50 UNION ALL SELECT query_id, doc_id, same, 1, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS rank FROM s QUALIFY rank <= 50),
grid AS (SELECT * FROM {values([(k, 0, r) for k, r in _RATIOS] + [(k, 1, 2.0) for k, _ in _RATIOS], 'setting, leg, w', 'g')}), weighed AS (SELECT * FROM two JOIN grid USING (leg)),"""
    + _FUSE_SQL.format(keys="setting, ", legs="weighed", n=10)
    + " SELECT setting, round(avg((d.label = q.label)::INT), 6) AS same_label FROM fused JOIN embeddings d ON d.vec_id = doc_id JOIN q USING (query_id) GROUP BY setting"
)
def fusion_ratio_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios 0 to 1.5 of a leg on whole vectors to one on their first half: how many of ten share the query's label."""
    e = table(spark, sf_dir, "embeddings")
    half = F.slice("embedding", 1, 32)
    queries = e.where("vec_id % 100 = 0")
    second = rt.dense(e.select(F.col("vec_id").alias("doc_id"), half.alias("v")), queries.select(F.col("vec_id").alias("query_id"), half.alias("q")), 50)
    legs = rt.union_of_legs([_nearest(spark, sf_dir, 50), second])
    grid = relation(spark, [(k, 0, r) for k, r in _RATIOS] + [(k, 1, 2.0) for k, _ in _RATIOS], "setting int, leg int, weight double")
    top = rt.fused(legs, grid, 10, ("setting", "query_id"))
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("sought"))
    judged = top.join(own, "query_id").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return judged.groupBy("setting").agg(F.round(F.avg((F.col("label") == F.col("sought")).cast("int")), 6).alias("same_label"))


_BOOSTS = [(k, a, r) for k, (a, r) in enumerate((a, r) for a in (1.0, 2.0) for r in (0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0))]


@query(f"""WITH r AS (SELECT p_brand AS query_id, p_partkey AS doc_id, p_retailprice, {_COLOR_SQL} AS color, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
b AS (SELECT setting, query_id, doc_id, color, p_retailprice, rank, CASE WHEN color IS NULL THEN 0 WHEN color = 'red' THEN scale ELSE -scale * ratio END + CASE WHEN p_retailprice <= 950 THEN scale ELSE -scale * ratio END AS boost FROM r, {values(_BOOSTS, 'setting, scale, ratio')}),
t AS (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY boost DESC, rank) AS place FROM b)
SELECT setting, round(avg((color = 'red' AND p_retailprice <= 950)::INT), 6) AS both_met, round(avg((color IS NULL)::INT), 6) AS unknown FROM t WHERE place <= 10 GROUP BY setting""")
def boost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts of matches by penalties of mismatches: what the first ten of a brand's parts are like."""
    p = parts(spark, sf_dir).select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_retailprice", "color")
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p_retailprice"), "doc_id")))
    both = ranked.crossJoin(F.broadcast(relation(spark, _BOOSTS, "setting int, scale double, ratio double")))
    points = lambda n: F.when(n > 0, F.col("scale")).when(n < 0, -F.col("scale") * F.col("ratio")).otherwise(0.0)
    ok = ex.budget_met(F.lit("<=950"), F.col("p_retailprice"))
    boost = points(rt.match_points(F.lit("red"), F.col("color"))) + points(F.when(ok.isNull(), 0).when(ok, 1).otherwise(-1))
    place = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc("boost"), "rank"))
    top = both.withColumn("boost", boost).withColumn("place", place).where("place <= 10")
    met = (F.col("color") == "red") & ok
    return top.groupBy("setting").agg(F.round(F.avg(met.cast("int")), 6).alias("both_met"), F.round(F.avg(F.col("color").isNull().cast("int")), 6).alias("unknown"))


_ENTROPY_WEIGHTS = [(0, 0.0), (1, 0.5), (2, 1.0), (3, 2.0)]


@query(f"""WITH {_ENTROPY_SQL}, a AS (SELECT * FROM {values(_ANSWERABLE, 'attribute, ord, p')}), pools AS (SELECT DISTINCT pool FROM e), w AS (SELECT * FROM {values(_ENTROPY_WEIGHTS, 'setting, w', 'g')}),
s AS (SELECT setting, pool, attribute, ord, round(CASE WHEN entropy IS NULL THEN p ELSE (w * entropy + p) / (w + 1) END, 6) AS score FROM pools CROSS JOIN a CROSS JOIN w LEFT JOIN (SELECT * FROM e WHERE entropy > 0.1) e USING (pool, attribute)),
b AS (SELECT setting, attribute FROM s QUALIFY row_number() OVER (PARTITION BY setting, pool ORDER BY score DESC, ord) = 1) SELECT setting, attribute, count(*) AS n FROM b GROUP BY ALL""")
def question_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attributes are asked for as entropy weighs more."""
    entropy, answerable = entropies(spark, sf_dir), relation(spark, _ANSWERABLE, "attribute string, ord int, p double")
    out = None
    for k, w in _ENTROPY_WEIGHTS:
        part = po.weighted_question(entropy, answerable, 0.10, entropy_weight=w).select(F.lit(k).alias("setting"), "attribute")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("setting", "attribute").agg(F.count(F.lit(1)).alias("n"))


_DECAYS = [(k, d) for k, d in enumerate((1.0, 0.95, 0.9, 0.8, 0.7, 0.5))]


@query(f"""WITH o AS (SELECT o_custkey, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn, count(*) OVER (PARTITION BY o_custkey) AS last FROM orders),
w AS (SELECT setting, o_custkey, value, round(sum(pow(decay, last - turn)), 6) AS weight FROM o, {values(_DECAYS, 'setting, decay')} GROUP BY ALL), b AS (SELECT setting, o_custkey, value FROM w QUALIFY row_number() OVER (PARTITION BY setting, o_custkey ORDER BY weight DESC, value) = 1)
SELECT a.setting, count(*) AS n, count(CASE WHEN a.value <> z.value THEN 1 END) AS changed FROM b a JOIN b z ON a.o_custkey = z.o_custkey AND z.setting = 0 GROUP BY a.setting""")
def decay_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For how many profiles another value leads when older statements count less."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("value"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("turn"), F.count(F.lit(1)).over(w).alias("last"))
    weights = [F.round(F.sum(dg.decayed(F.col("last"), F.col("turn"), d)), 6).alias(f"w{k}") for k, d in _DECAYS]
    sums = o.groupBy("o_custkey", "value").agg(*weights)
    lead = sums.groupBy("o_custkey").agg(*(F.min_by("value", F.struct((-F.col(f"w{k}")).alias("w"), "value")).alias(f"v{k}") for k, _ in _DECAYS))
    each = F.array(*(F.struct(F.lit(k).alias("setting"), (F.col(f"v{k}") != F.col("v0")).alias("other")) for k, _ in _DECAYS))
    return lead.select(F.inline(each)).groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("other"), 1)).alias("changed"))


_WINDOWS = (10, 15, 20, 25, 30)


def _window_sql() -> str:
    places = f"(SELECT t, list_filter(range(2, len(t) + 1), lambda i: regexp_matches(substr(t, i, 1), '[\\p{{L}}\\p{{N}}_]') AND regexp_matches(substr(t, i - 1, 1), '[^\\p{{L}}\\p{{N}}_]')) AS starts FROM {_TURNS})"
    one = "SELECT {n} AS size, sum(len(list_filter(starts, lambda i: regexp_matches(regexp_replace(right(left(t, i - 1), {n}), '(?s)^.*(?:" + _plain(ex.CLAUSE_END).replace("{", "{{").replace("}", "}}") + ")', ''), '" + _plain(ex.NEGATION).replace("{", "{{").replace("}", "}}") + "'))))::BIGINT AS negated FROM places"
    return f"WITH places AS {places} " + " UNION ALL ".join(one.format(n=n) for n in _WINDOWS)


@query(_window_sql())
def negation_window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of all turns are negated by windows of 10 to 30 characters."""
    low = F.lower(F.coalesce("text", F.lit("")))
    places = ex.leads(low, F.lit(r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+"), max(_WINDOWS))
    leads = all_turns(spark, sf_dir).select(F.explode(places).alias("lead")).where(F.col("lead").rlike(ex.MAYBE_NEGATED))

    def count(n: int):
        return F.struct(F.lit(n).alias("size"), F.count(F.when(ex.negated_before(F.col("lead"), n), 1)).alias("negated"))

    return leads.agg(F.array(*(count(n) for n in _WINDOWS)).alias("a")).select(F.inline("a"))


_RERANKS = [(0, 0.0, 20), (1, 1.0, 10), (2, 1.0, 20), (3, 2.0, 20)]


@query(
    f"WITH {_BOTH}, weighed AS (SELECT *, 2.0 AS w FROM legs)," + _FUSE_SQL.format(keys="", legs="weighed", n=30).replace("fused AS", "pool AS") + ","
    + _RERANK_SQL[: _RERANK_SQL.index("h AS (")].replace("FROM fused f", "FROM pool f").replace("m AS (", "pairs AS (")
    + f"""grid AS (SELECT * FROM {values(_RERANKS, 'setting, w, depth', 'g')}), h AS (SELECT setting, w, query_id, doc_id, rank, row_number() OVER (PARTITION BY setting, query_id ORDER BY model DESC, rank) AS again FROM pairs, grid WHERE rank <= depth),
  v AS (SELECT setting, query_id, doc_id, rank, round(1.0 / (60 + rank) + w / (60 + again), 9) AS value FROM h UNION ALL SELECT setting, query_id, doc_id, rank, NULL FROM pairs, grid WHERE rank > depth),
  fused AS (SELECT setting, query_id, doc_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY value DESC NULLS LAST, rank) AS rank FROM v QUALIFY row_number() OVER (PARTITION BY setting, query_id ORDER BY value DESC NULLS LAST, rank) <= 10) {TRUTH_SQL}, {EVAL_SQL}"""
)
def rerank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking weights and depths: the model scores the deepest head once, settings are ranked from that."""
    pool = rt.fused(two_legs(spark, sf_dir), [2.0, 2.0], 30)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(400)).alias("document"))
    rows = pool.join(searches(spark, sf_dir).withColumnRenamed("text", "query"), "query_id").join(docs, "doc_id")
    grid = relation(spark, _RERANKS, "setting int, weight double, depth int")
    found = rt.reranked_grid(rows, shared_words, grid, 20)
    return mt.evaluated(found.where("rank <= 10"), sought(spark, sf_dir), grid.select("setting"))


_REPEATS = [(0, 0.0, False), (1, 2.0, False), (2, 2.0, True)]


@query(
    f"""WITH {_BOTH}, grid AS (SELECT * FROM {values(_REPEATS, 'setting, x, fresh', 'g')}), weighed AS (SELECT setting, query_id, doc_id, leg, rank, CASE WHEN leg = 0 THEN 2.0 ELSE x END AS w FROM legs, grid),"""
    + _FUSE_SQL.format(keys="setting, ", legs="weighed", n=30).replace("fused AS", "pool AS")
    + f""", shown AS (SELECT query_id, doc_id FROM bm WHERE rank <= 10), z AS (SELECT p.setting, p.query_id, p.doc_id, p.rank, g.fresh AND s.doc_id IS NOT NULL AS was FROM pool p JOIN grid g USING (setting) LEFT JOIN shown s USING (query_id, doc_id)),
  fused AS (SELECT setting, query_id, doc_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY was, rank) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY setting, query_id ORDER BY was, rank) <= 10) {TRUTH_SQL}, {EVAL_SQL}"""
)
def anti_repeat_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second slate without phrases, with them, and with them but without what the first slate showed."""
    grid = relation(spark, [(s, leg, 2.0 if leg == 0 else x, fresh) for s, x, fresh in _REPEATS for leg in (0, 1)], "setting int, leg int, weight double, fresh boolean")
    pool = rt.fused(two_legs(spark, sf_dir), grid.drop("fresh"), 30, ("setting", "query_id"))
    shown = bm25_leg(spark, sf_dir, 10).select("query_id", "doc_id", F.lit(True).alias("seen"))
    marked = pool.join(F.broadcast(grid.select("setting", "fresh").distinct()), "setting").join(shown, ["query_id", "doc_id"], "left")
    was = F.col("fresh") & F.col("seen").isNotNull()
    place = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(was, "rank"))
    found = marked.select("setting", "query_id", "doc_id", place.alias("rank")).where("rank <= 10")
    return mt.evaluated(found, sought(spark, sf_dir), grid.select("setting").distinct())


_LENGTHS = [(0, 1000), (1, 3), (2, 6), (3, 12), (4, 24)]


@query(
    f"""WITH {CORPUS_SQL}, grid AS (SELECT * FROM {values(_LENGTHS, 'setting, n', 'g')}),
  cut AS (SELECT setting, item_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[.?]+$', ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')[1:n], ' ') AS text FROM benchmark, grid),
  ts AS (SELECT setting, item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains({_sql(list(vocab.STOPWORDS))}, t)) AS ts FROM cut),
  qterm AS (SELECT setting, item_id AS query_id, unnest(list_slice(list_transform(list_sort(list_transform(list_distinct(ts), lambda x: {{'p': list_position(ts, x), 't': x}})), lambda x: x.t), 1, 40)) AS term FROM ts),
  s AS (SELECT setting, q.query_id, tf.doc_id, round(sum(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean_d))), 6) AS score FROM qterm q JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL),
  fused AS (SELECT setting, query_id, doc_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10) {TRUTH_SQL}, {EVAL_SQL}"""
)
def query_length_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages as queries, and their first 3 to 24 words."""
    sizes = F.array(*(F.struct(F.lit(k).alias("setting"), dg.first_words(F.col("text"), n).alias("cut")) for k, n in _LENGTHS))
    cut = searches(spark, sf_dir).select("query_id", F.inline(sizes))
    terms = cut.select("setting", "query_id", F.explode(F.slice(F.array_distinct(tx.terms(F.coalesce("cut", F.lit("")))), 1, vocab.MAX_QUERY_TERMS)).alias("term"))
    found = ix.bm25(corpus_index(spark, sf_dir), terms, 10, WEIGHTS, ("setting", "query_id"))
    return mt.evaluated(found, sought(spark, sf_dir), relation(spark, [(k,) for k, _ in _LENGTHS], "setting int"))


_BUDGETS = [(0, 24, True), (1, 24, False), (2, 12, False), (3, 6, False), (4, 0, False)]


@query()
def phrase_query_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases from whole passages or from what follows their lead clause, under several budgets of look-ups."""
    asked = searches(spark, sf_dir)
    rest = F.trim(F.substring(F.col("text"), F.length(ex.lead_clause(F.col("text"))) + 1, F.length("text")))
    out = None
    for k, budget, whole in _BUDGETS:
        text = F.col("text") if whole else F.coalesce(F.nullif(rest, F.lit("")), F.col("text"))
        part = rt.query_grams(asked.select("query_id", text.alias("text")), budget=max(1, budget)).withColumn("setting", F.lit(k)).where(F.col("k") < budget)
        out = part if out is None else out.unionByName(part)
    keys = ("setting", "query_id")
    ph = ix.phrases(corpus_index(spark, sf_dir), out, DEPTH, keys=keys).select(*keys, "doc_id", F.lit(1).alias("leg"), "rank")
    grid = relation(spark, [(k,) for k, *_ in _BUDGETS], "setting int")
    bm = bm25_leg(spark, sf_dir, DEPTH).crossJoin(F.broadcast(grid)).select(*keys, "doc_id", F.lit(0).alias("leg"), "rank")
    return mt.evaluated(rt.fused(ph.unionByName(bm), [2.0, 2.0], 10, keys), sought(spark, sf_dir), grid)


_POPULAR = [(k, v, w) for k, (v, w) in enumerate((v, w) for v in ("popularity", "rating", "closeness") for w in (0.0, 0.25, 0.5, 1.0, 2.0, 4.0))]


@query(f"""WITH x AS (SELECT p_brand AS query_id, p_partkey AS doc_id, p_size, {_COLOR_SQL} AS color, p_retailprice, (SELECT avg(nullif(p_size, 0)) FROM part) AS mean, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS sold FROM part),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p_retailprice, doc_id) AS base, row_number() OVER (PARTITION BY query_id ORDER BY sold DESC, doc_id) AS popularity, row_number() OVER (PARTITION BY query_id ORDER BY p_size DESC, doc_id) AS rating, row_number() OVER (PARTITION BY query_id ORDER BY round(abs(p_size - (mean + 0.25 * (10 - mean))), 6), doc_id) AS closeness FROM x),
s AS (SELECT setting, query_id, doc_id, sold, base, round(2.0 / (60 + base) + w / (60 + CASE kind WHEN 'popularity' THEN popularity WHEN 'rating' THEN rating ELSE closeness END), 9) AS score FROM l, {values(_POPULAR, 'setting, kind, w', 'g')}),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, base) <= 10) SELECT setting, round(avg(sold), 6) AS mean_sold, count(*) AS n FROM t GROUP BY setting""")
def prior_leg_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity, rating and closeness to a predicted rating as a further leg, with weights 0 to 4: how well the first ten sell."""
    p = table(spark, sf_dir, "part")
    mean = p.agg(F.avg(F.nullif("p_size", F.lit(0))).alias("mean"))
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("sold"))
    x = p.join(sold, "p_partkey", "left").crossJoin(F.broadcast(mean)).select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_size", "p_retailprice", F.coalesce("sold", F.lit(0)).alias("sold"), "mean")
    rank = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
    gap = F.round(F.abs(F.col("p_size") - (F.col("mean") + 0.25 * (10 - F.col("mean")))), 6)
    l = x.select("query_id", "doc_id", "sold", rank("p_retailprice", "doc_id").alias("base"), F.create_map(F.lit("popularity"), rank(F.desc("sold"), "doc_id"), F.lit("rating"), rank(F.desc("p_size"), "doc_id"), F.lit("closeness"), rank(gap, "doc_id")).alias("ranks"))  # noqa: E741
    both = l.crossJoin(F.broadcast(relation(spark, _POPULAR, "setting int, kind string, w double")))
    score = F.round(2.0 / (vocab.RRF_K + F.col("base")) + F.col("w") / (vocab.RRF_K + F.try_element_at("ranks", F.col("kind"))), 9)
    place = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "base"))
    top = both.withColumn("score", score).withColumn("place", place).where("place <= 10")
    return top.groupBy("setting").agg(F.round(F.avg("sold"), 6).alias("mean_sold"), F.count(F.lit(1)).alias("n"))


@query()
def diversify_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slates of ten without and with diversification: how many labels they hold, and how like they are to the query."""
    e = table(spark, sf_dir, "embeddings")
    near = _nearest(spark, sf_dir, 40).select("query_id", "doc_id", "rank", "score")
    pool = near.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id").withColumn("repel", F.lit(-1e9))
    varied = rt.diversified(pool.drop("score"), 10, 0.5).where("rank <= 10")
    slates = near.where("rank <= 10").select(F.lit(0).alias("setting"), "query_id", "doc_id").unionByName(varied.select(F.lit(1).alias("setting"), "query_id", "doc_id"))
    rows = slates.join(near.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]).join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    each = rows.groupBy("setting", "query_id").agg(F.countDistinct("label").alias("labels"), F.avg("score").alias("score"))
    return each.groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("labels"), 6).alias("labels"), F.round(F.avg("score"), 6).alias("score"))


@query()
def head_regularisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic heads of five strengths on two labels, judged on a fold of whole groups."""
    e = table(spark, sf_dir, "embeddings").where(F.col("label").isin(0, 1))
    rows = e.select((F.col("label") == 1).cast("int").alias("y"), F.col("embedding").alias("v"), (F.floor(F.col("vec_id") / 10) % 5 == 0).alias("held_out"))
    return de.logistic_head(rows, [0.001, 0.01, 0.1, 1.0, 10.0])


@query(
    f"WITH {_BOTH}, grid AS (SELECT * FROM (VALUES (0, 0, 2.0), (0, 1, 0.0), (1, 0, 2.0), (1, 1, 2.0)) g(setting, leg, w)), weighed AS (SELECT * FROM legs JOIN grid USING (leg)),"
    + _FUSE_SQL.format(keys="setting, ", legs="weighed", n=10)
    + f""" {TRUTH_SQL}, lang AS (SELECT query_id, min(lang) AS scenario FROM truth JOIN documents USING (doc_id) GROUP BY query_id), best AS (SELECT setting, query_id, min(rank) AS r FROM fused JOIN truth USING (query_id, doc_id) GROUP BY ALL),
  q AS (SELECT setting, query_id, scenario FROM (VALUES (0), (1)) s(setting), lang), a AS (SELECT setting, scenario, count(*) AS n, round(avg((r IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM q LEFT JOIN best USING (setting, query_id) GROUP BY GROUPING SETS ((setting), (setting, scenario)))
  SELECT b.scenario, b.n, round(b.hit_rate - a.hit_rate, 6) AS hit_gain, round(b.mrr - a.mrr, 6) AS mrr_gain FROM a JOIN a b ON a.setting = 0 AND b.setting = 1 AND a.scenario IS NOT DISTINCT FROM b.scenario"""
)
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What phrases gain over BM25 alone, overall and by language of the sought document."""
    grid = relation(spark, [(0, 0, 2.0), (0, 1, 0.0), (1, 0, 2.0), (1, 1, 2.0)], "setting int, leg int, weight double")
    truth = sought(spark, sf_dir)
    best = rt.fused(two_legs(spark, sf_dir), grid, 10, ("setting", "query_id")).join(truth, ["query_id", "doc_id"]).groupBy("setting", "query_id").agg(F.min("rank").alias("r"))
    lang = truth.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("query_id").agg(F.min("lang").alias("scenario"))
    q = lang.crossJoin(F.broadcast(relation(spark, [(0,), (1,)], "setting int"))).join(best, ["setting", "query_id"], "left")
    of = lambda k, x: F.round(F.avg(F.when(F.col("setting") == k, x)), 6)
    hit, rr = F.col("r").isNotNull().cast("int"), F.coalesce(1.0 / F.col("r"), F.lit(0.0))
    rates = q.groupingSets([[], ["scenario"]], "scenario").agg(F.countDistinct("query_id").alias("n"), F.round(of(1, hit) - of(0, hit), 6).alias("hit_gain"), F.round(of(1, rr) - of(0, rr), 6).alias("mrr_gain"))
    return rates.select("scenario", "n", "hit_gain", "mrr_gain")

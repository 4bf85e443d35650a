"""Turn, belief, question and prompt queries over events, conversations, parts and orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import vocab
from ..operators import detectors as de
from ..operators import dialogue as dg
from ..operators import policy as po
from .analytics import _ENTROPY_SQL, _NAMED_SQL, customers, entropies, named_turns
from .language import _TURNS, all_turns, detected_sql
from .registry import _sql, query, relation, table, values

_ASK_SQL = "CASE event_type WHEN 'view' THEN 'material' WHEN 'click' THEN 'color' WHEN 'purchase' THEN 'style' WHEN 'error' THEN NULL ELSE 'feature' END"
_RATIOS = [(a, b, x) for a, m in vocab.ANSWER_ODDS.items() for b, x in m.items()]
_PRIORS = [(a, i, p) for i, (a, p) in enumerate(vocab.ANSWERABILITY.items())]


def asked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as questions: the type says what was asked, the value whether it was answered."""
    kind = F.col("event_type")
    asked = F.when(kind == "view", "material").when(kind == "click", "color").when(kind == "purchase", "style").when(kind == "error", F.lit(None)).otherwise("feature")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), asked.alias("asked"), (F.col("value") >= 50).alias("answered"))


@query(f"""WITH o AS (SELECT user_id AS session, {_ASK_SQL} AS asked, value >= 50 AS answered FROM events), r AS (SELECT * FROM {values(_RATIOS, 'asked, attribute, ratio')}), p AS (SELECT * FROM {values(_PRIORS, 'attribute, ord, prior')}),
m AS (SELECT session, attribute, sum(CASE WHEN answered THEN ln(ratio) ELSE -ln(ratio) END) AS moved FROM o JOIN r USING (asked) GROUP BY ALL), g AS (SELECT DISTINCT session, asked AS attribute, true AS gone FROM o WHERE asked IS NOT NULL),
b AS (SELECT s.session, p.attribute, ord, round(CASE WHEN gone THEN 0 ELSE 1 / (1 + exp(-(ln(prior / (1 - prior)) + coalesce(moved, 0)))) END, 6) AS p FROM (SELECT DISTINCT session FROM o) s CROSS JOIN p LEFT JOIN m ON m.session = s.session AND m.attribute = p.attribute LEFT JOIN g ON g.session = s.session AND g.attribute = p.attribute)
SELECT session, attribute, p, (row_number() OVER w)::INT AS rank, row_number() OVER w = 1 AND p >= 0.0005 AS best, max(p) OVER (PARTITION BY session) < 0.0005 AS exhausted FROM b WINDOW w AS (PARTITION BY session ORDER BY p DESC, ord)""")
def belief_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.ranked_beliefs(dg.beliefs(asked_events(spark, sf_dir)))


@query(f"WITH {_ENTROPY_SQL} SELECT pool, attribute, entropy FROM e WHERE entropy > 0.15 QUALIFY row_number() OVER (PARTITION BY pool ORDER BY entropy DESC, CASE attribute WHEN 'style' THEN 1 ELSE 2 END) = 1")
def entropy_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.entropy_question(entropies(spark, sf_dir), ("style", "color"))


@query(f"""WITH {_NAMED_SQL}, c AS (SELECT session, turn, t, coalesce(categories, []) AS categories FROM turns LEFT JOIN named USING (session, turn)),
p AS (SELECT *, coalesce(lag(categories) OVER (PARTITION BY session ORDER BY turn), []) AS before FROM c)
SELECT session, turn, array_to_string(list_sort(list_filter(categories, lambda x: NOT list_contains(before, x))), ',') AS new_categories,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN turn % 2 = 0 THEN ['material'] ELSE ['color', 'size'] END, list_filter(string_split({detected_sql('t')}, ','), lambda x: x <> '')))), ',') AS excluded FROM p""")
def question_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn names that the one before did not, and what is asked or stated and so needs no question."""
    from pyspark.sql import Window

    none = F.array().cast("array<string>")
    before = F.coalesce(F.lag("categories").over(Window.partitionBy("session").orderBy("turn")), none)
    asked = F.when(F.col("turn") % 2 == 0, F.array(F.lit("material"))).otherwise(F.array(F.lit("color"), F.lit("size")))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    rows = named_turns(spark, sf_dir).withColumn("new", F.array_except("categories", before))
    return rows.select("session", "turn", join(F.col("new")).alias("new_categories"), join(F.array_union(asked, ex.detected_attributes(F.col("text")))).alias("excluded"))


@query("""WITH r AS (SELECT CASE WHEN conv_id % 5 = 0 THEN '' ELSE conv_id::VARCHAR END AS session, turn, text AS message, CASE WHEN turn % 3 = 0 THEN 'many' ELSE (turn - 1)::VARCHAR END AS top_k FROM conversations), k AS (SELECT DISTINCT conv_id::VARCHAR AS session FROM conversations WHERE role = 'assistant' AND conv_id % 7 <> 0)
SELECT session, turn, coalesce(message, '') AS message, CASE WHEN try_cast(top_k AS INT) > 0 THEN try_cast(top_k AS INT) ELSE 10 END AS top_k, CASE WHEN trim(session) = '' THEN 'empty session' WHEN session NOT IN (SELECT session FROM k) THEN 'unknown session' END AS error FROM r""")
def coerced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    name = F.col("conv_id").cast("string")
    known = c.where((F.col("role") == "assistant") & (F.col("conv_id") % 7 != 0)).select(name.alias("session"))
    k = F.when(F.col("turn") % 3 == 0, "many").otherwise((F.col("turn") - 1).cast("string"))
    rows = c.select(F.when(F.col("conv_id") % 5 == 0, "").otherwise(name).alias("session"), "turn", F.col("text").alias("message"), k.alias("top_k"))
    return dg.coerced(rows, known).select("session", "turn", "message", "top_k", "error")


_QUESTION_SQL = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {_sql(q)}" for a, q in vocab.QUESTIONS.items()) + f" ELSE {_sql(vocab.NO_QUESTION)} END"


@query(f"""WITH c AS (SELECT p_partkey AS id, p_name, p_brand, CASE p_size % 6 WHEN 0 THEN 'material' WHEN 1 THEN 'budget' WHEN 2 THEN 'brand' WHEN 3 THEN 'sparkle' WHEN 4 THEN NULL ELSE 'use_case' END AS attribute, p_size FROM part), a AS (SELECT *, CASE WHEN list_contains({_sql(list(vocab.ASKABLE))}, attribute) THEN attribute END AS ask FROM c)
SELECT id, ask, {_QUESTION_SQL} AS message, 'Here are the closest matches. (' || CASE WHEN p_size % 2 = 0 THEN 'matching on brand=' || p_brand || ', name=' || p_name ELSE 'no hard constraints stated yet' END || '; ' || CASE WHEN p_size % 3 = 0 THEN 'buying' ELSE 'browsing' END || ' track' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '; showing a deliberately varied slate' END
|| CASE WHEN p_size % 10 = 0 THEN '; you''ve told me all you need to, so this is my best match on what I have' WHEN ask IS NOT NULL THEN '; asking about ' || ask || ' because it still splits these 10 options' ELSE '' END || '.)' AS why FROM a""")
def worded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every part, null where it may not be asked, and the line that explains the slate."""
    size = F.col("p_size")
    attribute = F.when(size % 6 == 0, "material").when(size % 6 == 1, "budget").when(size % 6 == 2, "brand").when(size % 6 == 3, "sparkle").when(size % 6 == 5, "use_case")
    slots = F.when(size % 2 == 0, F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), dg.question(attribute).alias("q"), slots.alias("slots"), "p_size")
    why = dg.explanation(F.col("slots"), F.when(size % 3 == 0, "buying").otherwise("browsing"), size % 3 != 0, size % 10 == 0, F.col("q.ask"), F.lit(10))
    return rows.select("id", "q.ask", "q.message", why.alias("why"))


@query("""WITH c AS (SELECT p_partkey AS session, p_type AS category, list_concat(CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_brand || ' ' || p_name, 'size ' || p_size] END, CASE WHEN p_size % 5 = 0 THEN [] ELSE ['budget around $' || p_size, 'color: ' || split_part(p_name, ' ', 1)] END) AS cs FROM part)
SELECT session, 'I''m looking for ' || category || '. ' || array_to_string(cs, '. ') || '.' AS message FROM c""")
def everything_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    return c.select("session", dg.everything_told(F.col("category"), F.concat("hard", "soft")).alias("message"))


_CONTEXT_SQL = "right(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 600)"
_LM_VALUES = ("die", "les", "the", "an")


@query(f"""WITH v AS (SELECT conv_id, turn, value, {_CONTEXT_SQL} || ' The shopper wants item of colour ' || value || '.' AS prompt FROM conversations, {values([(x,) for x in _LM_VALUES], 'value')}),
s AS (SELECT *, (len(prompt) - len(replace(prompt, value, ''))) / len(value)::DOUBLE AS score FROM v), x AS (SELECT *, exp(score - max(score) OVER w) AS e FROM s WINDOW w AS (PARTITION BY conv_id, turn)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY conv_id, turn) AS p FROM x)
SELECT conv_id, turn, arg_min(value, (-round(p, 9), value)) AS best, round(max(p), 6) AS p, round(-sum(p * log2(p)) / 2, 6) AS entropy FROM p GROUP BY ALL""")
def value_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a few values a turn is likest to mean, by an injected scorer of prompts (here: how often it occurs)."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    b = po.softmax_entropy(dg.scored_values(turns, "color", _LM_VALUES, occurrences), "key")
    best = F.min_by("value", F.struct((-F.col("p")).alias("p"), F.col("value").alias("v")))
    return b.groupBy("key").agg(best.alias("best"), F.max("p").alias("p"), F.first("entropy").alias("entropy")).select("key.conv_id", "key.turn", "best", "p", "entropy")


def occurrences(prompts: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([float(p.count(v)) for p, v in zip(prompts, values)])


@query("""SELECT item_id, n, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[.?]+$', ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')[1:n], ' ') AS opening FROM benchmark, (VALUES (3), (6), (12)) t(n)""")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(*(F.struct(F.lit(n).alias("n"), dg.first_words(F.col("text"), n).alias("opening")) for n in (3, 6, 12)))
    return table(spark, sf_dir, "benchmark").select("item_id", F.inline(sizes))


@query("SELECT p_partkey, left(p_name || ' ' || p_type, 12) AS title, CASE WHEN p_size % 4 <> 0 THEN round(p_retailprice / 3, 2) END AS price FROM part")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("p_size") % 4 == 0, "on request").otherwise((F.col("p_retailprice") / 3).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.left(F.concat_ws(" ", "p_name", "p_type"), F.lit(12)).alias("title"), dg.shown_price(price).alias("price"))


@query("""WITH o AS (SELECT o_custkey, map_from_entries(list({'k': p, 'v': c})) AS m FROM (SELECT o_custkey, left(o_orderpriority, 1) AS p, count(*)::VARCHAR AS c FROM orders GROUP BY ALL) GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_sort(list_concat(list_transform(list_filter(map_entries(m), lambda e: e.key NOT IN ('5', '1', 'key')), lambda e: e.key || '=' || e.value), ['1=new', 'key=' || o_custkey])), ',') AS slots FROM o""")
def replaced_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by priority as a map, with one key dropped, one replaced and one added."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey", F.left("o_orderpriority", F.lit(1)).alias("p")).agg(F.count(F.lit(1)).cast("string").alias("c"))
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("p", "c"))).alias("m"))
    new = F.create_map(F.lit("1"), F.lit("new"), F.lit("key"), F.col("o_custkey").cast("string"))
    slots = F.map_entries(dg.replaced_slots(F.col("m"), F.array(F.lit("5")), new))
    return m.select("o_custkey", F.array_join(F.array_sort(F.transform(slots, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("slots"))


@query("SELECT coalesce(sum(CASE WHEN try_cast(v AS BIGINT) >= 0 AND v NOT LIKE '%.%' THEN v::BIGINT END), 0)::BIGINT AS prompt, coalesce(sum(CASE WHEN k >= 0 THEN k END), 0)::BIGINT AS completion FROM (SELECT CASE WHEN event_id % 3 = 0 THEN value::VARCHAR WHEN event_id % 3 = 1 THEN event_id::VARCHAR ELSE (-event_id)::VARCHAR END AS v, try_cast(props->>'$.k' AS BIGINT) AS k FROM events)")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of counts, those that are no whole numbers or below zero left out."""
    e = table(spark, sf_dir, "events")
    prompt = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("."))).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise((-F.col("event_id")).cast("string"))
    whole = F.when(~F.contains(prompt, F.lit(".")), prompt)
    return dg.usage(e.select(whole.alias("prompt"), F.get_json_object("props", "$.k").alias("completion")), "prompt", "completion")


@query("SELECT e.user_id, e.event_id, p.p_name || ' ' || p.p_type AS target FROM events e JOIN part p ON (e.props->>'$.k')::BIGINT = p.p_partkey WHERE event_type = 'purchase'")
def session_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions joined to the card of what they look for."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("p_partkey"))
    return e.join(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("target")), "p_partkey").select("user_id", "event_id", "target")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY md5('seed-1|' || o_orderkey::VARCHAR), o_orderkey LIMIT 40")
def seeded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty sessions of two scenarios in a seeded order: the limit is the feature."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderpriority")
    return dg.seeded_sample(o, 40, "o_orderkey", "seed-1")


@query("SELECT p_partkey, greatest(0.0, least(20.0, p_size::DOUBLE)) AS clipped, round(2.0 / (60 + p_size), 9) AS gain, p_retailprice <= 950 AS cheap FROM part")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators called from SQL by their registered names."""
    dg.register(spark)
    part = table(spark, sf_dir, "part")
    return part.selectExpr("p_partkey", "clip(p_size, 0, 20) AS clipped", "round(rrf(2, p_size), 9) AS gain", "budget_met('<=950', p_retailprice) AS cheap")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, (vec_id // 10) % 5 AS fold FROM embeddings), d AS (SELECT fold, label, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM e), s AS (SELECT label, dim, fold, sum(x) AS x FROM d GROUP BY ALL),
t AS (SELECT label, dim, sum(x) AS x FROM s GROUP BY ALL), f AS (SELECT DISTINCT fold FROM e), m AS (SELECT f.fold, t.label, list(t.x - coalesce(s.x, 0) ORDER BY t.dim) AS c FROM t CROSS JOIN f LEFT JOIN s ON s.label = t.label AND s.dim = t.dim AND s.fold = f.fold GROUP BY ALL),
b AS (SELECT e.fold, e.vec_id, e.label AS truth, m.label AS guess FROM e JOIN m USING (fold) QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) DESC, m.label) = 1)
SELECT fold, count(*) AS n, round(avg((truth = guess)::INT), 6) AS accuracy FROM b GROUP BY fold""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of nearest centroids over five folds of whole groups, each judged by the other four."""
    fold = F.floor(F.col("vec_id") / 10) % 5
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), F.col("embedding").alias("v"), fold.cast("long").alias("fold"))
    return de.folded_accuracy(e, "vec_id")


_COMPONENTS = [("documents", True), ("benchmark", True), ("embeddings", False), ("conversations", False), ("reranker", False), ("masked_model", False)]


@query(f"SELECT component, required, available, CASE WHEN available THEN 'live' WHEN required THEN 'missing' ELSE 'dark' END AS state FROM (SELECT component, required, component IN ('documents', 'benchmark', 'embeddings', 'conversations') AS available FROM {values(_COMPONENTS, 'component, required')})")
def component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of the retrieval are live: tables that can be read, models that are injected."""
    jvm = spark._jvm.org.apache.hadoop.fs

    def there(name: str) -> bool:
        path = jvm.Path(f"{sf_dir}/{name}.parquet")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    rows = [(c, r, there(c)) for c, r in _COMPONENTS]
    state = F.when(F.col("available"), "live").when(F.col("required"), "missing").otherwise("dark")
    return relation(spark, rows, "component string, required boolean, available boolean").withColumn("state", state)

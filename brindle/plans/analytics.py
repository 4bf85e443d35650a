"""Policy, metric, session and offline-analytics queries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import vocab
from ..operators import detectors as de
from ..operators import metrics as mt
from ..operators import policy as po
from ..operators import retrieval as rt
from ..operators import sessions as se
from ..streaming import live
from .language import _M, PIVOTS, budget_sql, defer_sql, disclosed_sql, messages, override_sql, reply_sql, spelling_sql
from .registry import _sql, query, relation, table, values

_COLOR_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '(?:^|[^a-z0-9_])(?:{c})(?:$|[^a-z0-9_])') THEN '{c}'" for c in vocab.COLORS) + " END"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("color", ex.vocab_value(F.col("p_name"), vocab.COLORS))


@query(f"""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, {_COLOR_SQL} AS color, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank FROM part QUALIFY rank <= 30),
b AS (SELECT *, CASE WHEN color IS NULL THEN 0 WHEN color = 'red' THEN 1 ELSE -1 END + CASE WHEN p_retailprice <= 910 THEN 1 ELSE -1 END AS boost FROM r)
SELECT p_brand AS query_id, p_partkey AS doc_id, boost, row_number() OVER (PARTITION BY p_brand ORDER BY boost DESC, rank)::INT AS rank FROM b""")
def disclosed_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's cheapest parts moved by a stated color (red) and budget (<=910)."""
    p = parts(spark, sf_dir).select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_retailprice", "color")
    ranked = rt.top_n(p, 30, F.col("p_retailprice"), F.col("doc_id"))
    ok = ex.budget_met(F.lit("<=910"), F.col("p_retailprice"))
    boost = rt.match_points(F.lit("red"), F.col("color")) + F.when(ok.isNull(), 0).when(ok, 1).otherwise(-1)
    return rt.boosted(ranked, boost).select("query_id", "doc_id", "boost", "rank")


_ENTROPY_SQL = f"""v AS (SELECT p_brand AS pool, 'color' AS attribute, {_COLOR_SQL} AS value FROM part UNION ALL SELECT p_brand, 'style', split_part(p_name, ' ', 2) FROM part),
c AS (SELECT pool, attribute, value, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT pool, attribute, sum(n) AS t, count(*) AS k FROM c GROUP BY ALL),
e AS (SELECT pool, attribute, CASE WHEN k < 2 THEN 0.0 ELSE round(-sum((n / t) * log2(n / t)) / log2(k), 6) END AS entropy FROM c JOIN t USING (pool, attribute) GROUP BY pool, attribute, k)"""


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    both = F.array(F.struct(F.lit("color").alias("attribute"), F.col("color").alias("value")), F.struct(F.lit("style").alias("attribute"), F.split("p_name", " ")[1].alias("value")))
    return po.pool_entropy(p.select(F.col("p_brand").alias("pool"), F.inline(both)))


@query(f"WITH {_ENTROPY_SQL} SELECT pool, attribute, entropy FROM e")
def pool_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropies(spark, sf_dir)


_ANSWERABLE = [(a, i, p) for i, (a, p) in enumerate(vocab.ANSWERABILITY.items()) if a in ("material", "color", "style", "budget")]


@query(f"""WITH {_ENTROPY_SQL}, a AS (SELECT * FROM {values(_ANSWERABLE, 'attribute, ord, p')}), pools AS (SELECT DISTINCT pool FROM e),
s AS (SELECT pool, attribute, ord, round(CASE WHEN entropy IS NULL THEN p ELSE (entropy + p) / 2 END, 6) AS score FROM pools CROSS JOIN a LEFT JOIN (SELECT * FROM e WHERE entropy > 0.1) e USING (pool, attribute))
SELECT pool, attribute, score FROM s QUALIFY row_number() OVER (PARTITION BY pool ORDER BY score DESC, ord) = 1""")
def next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.weighted_question(entropies(spark, sf_dir), relation(spark, _ANSWERABLE, "attribute string, ord int, p double"), 0.10)


_ASKED = [(1, 1, "material", True), (1, 2, "color", False), (2, 1, "color", True), (2, 2, "style", True), (3, 1, None, True), (3, 2, "budget", False), (4, 1, "feature", True)]


@query(
    f"""WITH o AS (SELECT * FROM {values(_ASKED, 'session, seq, asked, answered')}), r AS (SELECT * FROM {values([(a, b, x) for a, m in vocab.ANSWER_ODDS.items() for b, x in m.items()], 'asked, attribute, ratio')}),
p AS (SELECT * FROM {values(list(vocab.ANSWERABILITY.items()), 'attribute, prior')}),
m AS (SELECT session, attribute, product(CASE WHEN answered THEN ratio ELSE 1 / ratio END) AS f FROM o JOIN r USING (asked) GROUP BY ALL)
SELECT s.session, p.attribute, round(CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.session = s.session AND o.asked = p.attribute) THEN 0 ELSE (prior / (1 - prior) * coalesce(f, 1)) / (1 + prior / (1 - prior) * coalesce(f, 1)) END, 6) AS p
FROM (SELECT DISTINCT session FROM o) s, p LEFT JOIN m ON m.session = s.session AND m.attribute = p.attribute"""
)
def belief_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.belief(relation(spark, _ASKED, "session int, seq int, asked string, answered boolean"))


@query("""WITH s AS (SELECT lang AS key, source AS value, ln(1 + sum(n_chars)) AS score FROM documents GROUP BY ALL), x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY key)) AS e, count(*) OVER (PARTITION BY key) AS n FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY key) AS p FROM x), h AS (SELECT key, CASE WHEN n = 1 THEN 1.0 ELSE -sum(p * log2(p)) / log2(n) END AS h FROM p GROUP BY key, n)
SELECT key, value, round(p, 6) AS p, round(h, 6) AS entropy, round(h, 6) < 0.60 AS confident FROM p JOIN h USING (key)""")
def softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("key"), F.col("source").alias("value")).agg(F.log(1 + F.sum("n_chars")).alias("score"))
    return po.softmax_entropy(d, "key")


_OUTCOME_SQL = """e AS (SELECT user_id, ts::DATE AS day, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT user_id, day, arg_min(event_type, pos) AS scenario, min(CASE WHEN event_type = 'purchase' AND pos <= 10 THEN pos END) AS hit FROM e GROUP BY ALL)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a session; its first event the scenario, its first purchase within ten events the hit."""
    day = F.to_date("ts")
    pos = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("day", day).withColumn("pos", pos)
    hit = F.min(F.when((F.col("event_type") == "purchase") & (F.col("pos") <= 10), F.col("pos")))
    return e.groupBy("user_id", "day").agg(F.min_by("event_type", "pos").alias("scenario"), hit.cast("int").alias("hit"))


@query(f"""WITH {_OUTCOME_SQL}, a AS (SELECT scenario, count(*) AS n, round(avg((hit IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr, round(avg(coalesce(hit, 11)), 6) AS mttc FROM s GROUP BY GROUPING SETS ((), (scenario))),
f AS (SELECT *, round(greatest(0.0, least(1.0, (11 - mttc) / 10)), 6) AS efficiency FROM a) SELECT *, round(0.5 * hit_rate + 0.3 * mrr + 0.2 * efficiency, 6) AS score FROM f""")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.session_report(outcomes(spark, sf_dir).select("scenario", F.col("hit").alias("hit_turn"), F.col("hit").alias("hit_rank")))


@query("""WITH w AS (SELECT user_id, event_id, event_type, value, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment, ts FROM events)
SELECT user_id, event_id, segment::INT AS segment, array_to_string(list(event_type) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS recent,
first_value(event_type) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) AS opening, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_buy,
coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true) AS changed FROM w""")
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events start a new segment; within it: the last ten types, the first, the last purchase, and changes."""
    whole = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("segment", F.sum((F.col("event_type") == "error").cast("int")).over(whole).cast("int"))
    inside = Window.partitionBy("user_id", "segment").orderBy("ts", "event_id")
    recent = F.array_join(F.collect_list("event_type").over(inside.rowsBetween(-9, 0)), ",")
    return e.select(
        "user_id", "event_id", "segment", recent.alias("recent"), F.first("event_type").over(inside).alias("opening"),
        F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("last_buy"),
        F.coalesce(F.lag("event_type").over(whole) != F.col("event_type"), F.lit(True)).alias("changed"),
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", "text")
    own = messages(spark).select(F.lit(-1).cast("long").alias("session"), F.col("id").cast("long").alias("turn"), "text")
    return c.unionByName(own)


_VOCAB_SQL = "words AS (SELECT word FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE regexp_full_match(word, '[a-z]+') GROUP BY word HAVING count(*) >= 20)"
_TURNS_SQL = f"""turns AS (SELECT session, turn, coalesce(text, '') AS text, lower(coalesce(text, '')) AS t FROM (SELECT conv_id AS session, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1, id, text FROM {_M} UNION ALL SELECT session, turn, text FROM {values(PIVOTS, 'session, turn, text')}))"""
_NAMED_SQL = f"""{_VOCAB_SQL}, {_TURNS_SQL},
ft AS (SELECT session, turn, unnest(list_distinct(list_filter(regexp_extract_all(lower({spelling_sql('text')}), '[a-z0-9]+'), lambda x: len(x) > 1 AND NOT list_contains({_sql(list(vocab.STOPWORDS))}, x)))) AS term FROM turns),
fk AS (SELECT session, turn, term, CASE WHEN term IN (SELECT word FROM words) THEN term WHEN term || 's' IN (SELECT word FROM words) THEN term || 's' WHEN term || 'es' IN (SELECT word FROM words) THEN term || 'es' END AS word FROM ft
  WHERE NOT list_contains({_sql(sorted({w for v in (*vocab.CATALOG_MATERIALS, *vocab.COLORS) for w in v.split()}))}, term)),
named AS (SELECT session, turn, list_sort(list_distinct(list(word))) AS categories FROM fk WHERE word IS NOT NULL GROUP BY ALL)"""


def category_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= vocab.CATEGORY_LEAST_DF)


def named_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivots = relation(spark, PIVOTS, "session long, turn long, text string")
    return se.named_categories(chat_turns(spark, sf_dir).unionByName(pivots), category_words(spark, sf_dir))


@query(f"WITH {_NAMED_SQL} SELECT session, turn, array_to_string(coalesce(categories, []), ',') AS categories FROM turns LEFT JOIN named USING (session, turn)")
def named_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the parts' vocabulary that a turn names, also in the singular."""
    return named_turns(spark, sf_dir).select("session", "turn", F.array_join("categories", ",").alias("categories"))


@query(
    f"""WITH {_NAMED_SQL}, c AS (SELECT session, turn, {override_sql('text')} AS override, coalesce(categories, []) AS categories, row_number() OVER (PARTITION BY session ORDER BY turn) AS i FROM turns LEFT JOIN named USING (session, turn)),
p AS (SELECT *, override AND i > 1 AND len(list_filter(categories, lambda x: NOT list_contains(coalesce(flatten(list(categories) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []), x))) > 0 AS pivots FROM c)
SELECT session, turn, pivots, max(CASE WHEN pivots THEN turn END) OVER (PARTITION BY session ORDER BY turn) AS latest FROM p"""
)
def category_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides that name a category new to their session."""
    turns = named_turns(spark, sf_dir)
    return se.category_pivots(turns.withColumn("override", ex.override_cue(F.coalesce("text", F.lit("")))))


@query()
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after every user turn, by the shared transition function (its native twin: session_state)."""
    return se.fold(se.turn_signals(named_turns(spark, sf_dir)))


@query()
def scoped_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with overrides that clear only the slots they state."""
    return se.fold(se.turn_signals(named_turns(spark, sf_dir)), scoped=True)


@query(
    f"""WITH {_TURNS_SQL}, g AS (SELECT session, turn, {override_sql('text')} AS override, {defer_sql('t')} AS defer, {reply_sql('t')} = 'non_answer' AS contentless, {disclosed_sql('t', vocab.COLORS)} AS color, {disclosed_sql('t', vocab.CATALOG_MATERIALS)} AS material,
  {budget_sql('t')} AS budget, row_number() OVER (PARTITION BY session ORDER BY turn) = 1 AS opens FROM turns),
s AS (SELECT *, sum((override AND NOT opens)::INT) OVER (PARTITION BY session ORDER BY turn) AS segment FROM g)
SELECT session, turn, segment::INT AS segment, max((contentless AND defer AND NOT opens)::INT) OVER w = 1 AS boundary, last_value(color IGNORE NULLS) OVER w AS color, last_value(material IGNORE NULLS) OVER w AS material, last_value(budget IGNORE NULLS) OVER w AS budget,
least(sum((NOT contentless AND NOT opens)::INT) OVER w, 10)::INT AS informative FROM s WINDOW w AS (PARTITION BY session, segment ORDER BY turn ROWS UNBOUNDED PRECEDING)"""
)
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivots = relation(spark, PIVOTS, "session long, turn long, text string")
    return se.fold_native(se.turn_signals(chat_turns(spark, sf_dir).unionByName(pivots)))


_ASKS = ["size", None, "weird", "material", "other"]
_KIND_SQL = "CASE p_size % 4 WHEN 0 THEN 'buying' WHEN 1 THEN 'browsing' WHEN 2 THEN 'boundary' ELSE 'intent_override' END"


def _simulation_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    low = "lower(c)"
    kind_of = f"CASE WHEN contains({low}, 'budget') OR regexp_matches({low}, {q(ex.CONSTRAINT_PRICE)}) THEN 'budget' " + " ".join(f"WHEN {' OR '.join(f'contains({low}, {q(w)})' for w in ws)} THEN '{k}'" for k, ws in ex.CONSTRAINT_WORDS.items()) + " ELSE 'feature' END"
    old, new = q(se.NO_OLD_VALUE), q(se.NO_NEW_VALUE)
    o = se.OPENING
    parts = [
        f"""c AS (SELECT p_partkey AS session, {_KIND_SQL} AS kind, p_type AS category, CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_brand || ' ' || p_name, 'size ' || p_size] END AS hard, CASE WHEN p_size % 5 = 0 THEN [] ELSE ['budget around $' || p_size, 'color: ' || split_part(p_name, ' ', 1)] END AS soft FROM part),
b AS (SELECT *, list_concat(hard, soft) AS every, CASE WHEN session % 2 = 0 THEN 3 ELSE 4 END AS at_turn, coalesce(soft[-1], {old}) AS old, coalesce(hard[1], {new}) AS new FROM c),
s1 AS (SELECT *, CASE WHEN kind = 'buying' AND len(hard) > 0 THEN {q(o['buying'][0])} || category || {q(o['buying'][1])} || hard[1] || {q(o['buying'][2])} WHEN kind = 'intent_override' THEN {q(o['intent_override'][0])} || category || {q(o['intent_override'][1])} || old
  ELSE {q(o['other'][0])} || category || {q(o['other'][2])} END AS message, CASE WHEN kind = 'buying' THEN hard[1:1] ELSE [] END AS told, CASE WHEN kind = 'buying' THEN hard[1:1] ELSE [] END AS seen, false AS back, kind <> 'intent_override' AS ovr FROM b)"""
    ]
    keep = "session, kind, category, hard, soft, every, at_turn, old, new"
    for turn, ask in enumerate(_ASKS, 2):
        about = q(ask if ask in vocab.ASKABLE else "other")
        fits = f"list_filter(every, lambda c: NOT list_contains(seen, c) AND ({about} = 'other' OR {kind_of} = {about}))[1:2]"
        gives = "false" if ask is None else "(kind = 'boundary' AND NOT back)"
        reply = q(se.NO_QUESTION) if ask is None else f"CASE WHEN gives THEN {q(se.HANDS_BACK[0] + ask + se.HANDS_BACK[1])} WHEN len(m) = 0 THEN {q(se.NOTHING_MORE[0])} || {about} || {q(se.NOTHING_MORE[1])} ELSE {q(se.DISCLOSES[0])} || array_to_string(m, {q(se.DISCLOSES[1])}) || {q(se.DISCLOSES[2])} END"
        told = "[]" if ask is None else "CASE WHEN gives THEN [] ELSE m END"
        parts.append(
            f"""r{turn} AS (SELECT *, {fits} AS m, {gives} AS gives, NOT ovr AND at_turn = {turn} AS now FROM s{turn - 1}),
n{turn} AS (SELECT {keep}, CASE WHEN now THEN {q(se.OVERRIDES[0])} || new || {q(se.OVERRIDES[1])} ELSE {reply} END AS message, CASE WHEN now THEN [new] ELSE {told} END AS told, seen, CASE WHEN now THEN back ELSE back OR gives END AS back, ovr OR now AS ovr FROM r{turn}),
s{turn} AS (SELECT {keep}, message, told, list_concat(seen, told) AS seen, back, ovr FROM n{turn})"""
        )
    rows = " UNION ALL ".join(f"SELECT session, {t} AS turn, message, len(told)::INT AS n_told, ovr AS overridden FROM s{t}" for t in range(1, len(_ASKS) + 2))
    return f"WITH {', '.join(parts)} {rows}"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulated customer for every part."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "buying").when(size % 4 == 1, "browsing").when(size % 4 == 2, "boundary").otherwise("intent_override")
    none, number = F.array().cast("array<string>"), size.cast("string")
    hard = F.when(size % 7 == 0, none).otherwise(F.array(F.concat("p_brand", F.lit(" "), "p_name"), F.concat(F.lit("size "), number)))
    soft = F.when(size % 5 == 0, none).otherwise(F.array(F.concat(F.lit("budget around $"), number), F.concat(F.lit("color: "), F.split("p_name", " ")[0])))
    return p.select(F.col("p_partkey").alias("session"), kind.alias("kind"), F.col("p_type").alias("category"), hard.alias("hard"), soft.alias("soft"))


@query(_simulation_sql())
def simulated_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer says when asked for a size, nothing, something unknown, a material and anything else."""
    return se.simulate(customers(spark, sf_dir), _ASKS, turn_of=F.when(F.col("session") % 2 == 0, 3).otherwise(4))


@query("""WITH f AS (SELECT user_id AS session, (props->>'$.k')::INT AS id, min(ts::DATE) AS turn FROM events GROUP BY ALL), n AS (SELECT session, turn, count(*) AS c FROM f WHERE id IS NOT NULL GROUP BY ALL),
t AS (SELECT DISTINCT user_id AS session, ts::DATE AS turn FROM events)
SELECT session, turn::VARCHAR AS turn, coalesce(c, 0) AS new, sum(coalesce(c, 0)) OVER (PARTITION BY session ORDER BY turn)::BIGINT AS seen FROM t LEFT JOIN n USING (session, turn)""")
def running_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.to_date("ts").alias("turn"), F.get_json_object("props", "$.k").cast("int").alias("id")).where("id is not null")
    return se.running_slate(e).withColumn("turn", F.col("turn").cast("string"))


_COOC_SQL = """x AS (SELECT p_partkey AS id, unnest([{'a': 'category', 'v': p_type}, {'a': 'material', 'v': p_brand}, {'a': 'color', 'v': split_part(p_name, ' ', 1)}]) AS s FROM part), v AS (SELECT id, s.a AS attribute, s.v AS value FROM x),
m AS (SELECT attribute, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY attribute) AS total, count(*) OVER (PARTITION BY attribute) AS kinds FROM v GROUP BY attribute, value),
j AS (SELECT e.attribute AS given, e.value AS evidence, t.attribute AS target, t.value AS value, count(*) AS joint FROM v e JOIN v t ON e.id = t.id AND e.attribute <> t.attribute GROUP BY ALL),
l AS (SELECT given, evidence, target, j.value, joint, g.n AS support, round((joint + 1.0) / (g.n + t.kinds), 6) AS posterior, round(((joint + 1.0) / (g.n + t.kinds)) / (t.n / t.total), 6) AS lift
  FROM j JOIN m g ON g.attribute = given AND g.value = evidence JOIN m t ON t.attribute = target AND t.value = j.value WHERE g.n >= 50)"""


def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, attribute, value): type, brand and first name word of every part, in long form."""
    named = (("category", F.col("p_type")), ("material", F.col("p_brand")), ("color", F.split("p_name", " ")[0]))
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), c.alias("value")) for a, c in named))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.inline(pairs))


@query(f"WITH {_COOC_SQL} SELECT given, evidence, target, value, joint, support, posterior, lift FROM l")
def cooccurrence_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all ordered pairs of attributes: how much likelier a value is given another's, smoothed by one, where seen."""
    return mt.cooccurrence(attribute_values(spark, sf_dir))


@query(f"WITH {_COOC_SQL} SELECT given, evidence, target, CASE WHEN lift > 1.5 THEN value END AS predicted, lift FROM l QUALIFY row_number() OVER (PARTITION BY given, evidence, target ORDER BY lift DESC, value) = 1")
def cooccurrence_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value with the best lift for each piece of evidence and target, if it lifts enough."""
    return mt.predicted_values(mt.cooccurrence(attribute_values(spark, sf_dir)))


@query(f"""WITH {_COOC_SQL}, w AS (SELECT v.id, c.value, count(*) AS k, sum(ln((coalesce(j.joint, 0) + 1.0) / (c.n + s.kinds))) + max(ln(c.n / c.total)) AS score FROM v JOIN (SELECT DISTINCT attribute, kinds FROM m) s USING (attribute) JOIN (SELECT value, n, total FROM m WHERE attribute = 'color') c ON true
  LEFT JOIN j ON j.given = v.attribute AND j.evidence = v.value AND j.target = 'color' AND j.value = c.value JOIN m g ON g.attribute = v.attribute AND g.value = v.value AND g.n >= 50 WHERE v.attribute <> 'color' GROUP BY v.id, c.value),
b AS (SELECT id, value AS guess, k FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, value) = 1)
SELECT k, count(*) AS n, round(avg((b.guess = v.value)::INT), 6) AS accuracy FROM b JOIN v ON v.id = b.id AND v.attribute = 'color' GROUP BY k""")
def naive_bayes_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name word from its type and brand together: accuracy by how many of them have enough support."""
    v = attribute_values(spark, sf_dir)
    truth = v.where("attribute = 'color'").select("id", F.col("value").alias("truth"))
    g = mt.naive_bayes(v, "color").join(truth, "id")
    return g.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("guess") == F.col("truth")).cast("int")), 6).alias("accuracy"))


@query("""WITH u AS (SELECT DISTINCT user_id, ts::DATE AS d, event_type FROM events), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, d FROM u)), c AS (SELECT event_type, count(*) AS c FROM u GROUP BY ALL),
b AS (SELECT a.event_type AS x, b.event_type AS y, count(*) AS both_n FROM u a JOIN u b USING (user_id, d) WHERE a.event_type <> b.event_type GROUP BY ALL)
SELECT x, y, both_n, round(((both_n + 0.5) * (n - p.c - q.c + both_n + 0.5)) / ((p.c - both_n + 0.5) * (q.c - both_n + 0.5)), 3) AS odds FROM b JOIN c p ON p.event_type = x JOIN c q ON q.event_type = y, n WHERE p.c >= 15 AND q.c >= 15""")
def odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds ratios of two event types on a user's day, each cell raised by one half."""
    u = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_type").distinct()
    sets = u.groupBy("user_id", "d").agg(F.collect_set("event_type").alias("s"))  # a handful of types
    n = sets.agg(F.count(F.lit(1)).alias("n"))
    c = u.groupBy("event_type").agg(F.count(F.lit(1)).alias("c"))
    b = sets.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")).where("x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("both_n"))
    p, q = c.select(F.col("event_type").alias("x"), F.col("c").alias("cx")), c.select(F.col("event_type").alias("y"), F.col("c").alias("cy"))
    k = F.col("both_n")
    odds = ((k + 0.5) * (F.col("n") - F.col("cx") - F.col("cy") + k + 0.5)) / ((F.col("cx") - k + 0.5) * (F.col("cy") - k + 0.5))
    return b.join(p, "x").join(q, "y").crossJoin(F.broadcast(n)).where("cx >= 15 and cy >= 15").select("x", "y", "both_n", F.round(odds, 3).alias("odds"))


@query("""WITH t AS (SELECT o_orderpriority AS tag, c_mktsegment AS bucket FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT count(*) AS n FROM t), a AS (SELECT tag, count(*) AS support FROM t GROUP BY tag), b AS (SELECT bucket, count(*) / (SELECT n FROM n) AS share FROM t GROUP BY bucket),
o AS (SELECT tag, bucket, count(*) AS observed FROM t GROUP BY ALL), g AS (SELECT tag, bucket, support, coalesce(observed, 0) AS observed, share FROM a CROSS JOIN b LEFT JOIN o USING (tag, bucket))
SELECT tag, bucket, support, observed, round(support * share, 6) AS expected, round((observed - support * share) / sqrt(support * share * (1 - share)), 6) AS sigma, round(observed / (support * share), 6) AS lift, support >= 30 AND abs(round((observed - support * share) / sqrt(support * share * (1 - share)), 6)) > 2 AS flagged FROM g""")
def tag_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial deviation of each segment among the orders of each priority."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("bucket"))
    t = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("tag")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    o = t.groupBy("tag", "bucket").agg(F.count(F.lit(1)).alias("observed"))
    a, b = o.groupBy("tag").agg(F.sum("observed").alias("support")), o.groupBy("bucket").agg(F.sum("observed").alias("in_bucket"))
    n = o.agg(F.sum("observed").alias("n"))
    g = a.crossJoin(b).crossJoin(F.broadcast(n)).join(o, ["tag", "bucket"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    share = F.col("in_bucket") / F.col("n")
    expected = F.col("support") * share
    sigma = F.round((F.col("observed") - expected) / F.sqrt(expected * (1 - share)), 6)
    return g.select("tag", "bucket", "support", "observed", F.round(expected, 6).alias("expected"), sigma.alias("sigma"), F.round(F.col("observed") / expected, 6).alias("lift"), ((F.col("support") >= 30) & (F.abs(sigma) > 2)).alias("flagged"))


@query("WITH g AS (SELECT c_mktsegment AS field, n_regionkey AS scenario, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY field), 6) AS share FROM g")
def field_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("scenario"))
    t = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("field"), "scenario").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))


@query("""WITH c AS (SELECT p_brand AS key, p_type AS value, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT key, sum(n) AS t, sum(n * (n - 1)) / 2 AS same FROM c GROUP BY key), v AS (SELECT value, sum(n) AS n FROM c GROUP BY value)
SELECT sum(t * (t - 1) / 2)::BIGINT AS pairs, round(sum(same) / sum(t * (t - 1) / 2), 6) AS agreement, round((SELECT sum(n * (n - 1)) FROM v) / (sum(t) * (sum(t) - 1)), 6) AS baseline,
round(sqrt(((SELECT sum(n * (n - 1)) FROM v) / (sum(t) * (sum(t) - 1))) * (1 - (SELECT sum(n * (n - 1)) FROM v) / (sum(t) * (sum(t) - 1))) / sum(t * (t - 1) / 2)), 6) AS spread FROM k""")
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two parts of a brand share a type, against any two parts and the spread of as many random pairs: from counts."""
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    two = lambda x: F.col(x) * (F.col(x) - 1)
    k = c.groupBy("p_brand").agg(F.sum("n").alias("t"), F.sum(two("n")).alias("same"))
    v = c.groupBy("p_type").agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("any_same"))
    base = F.col("any_same") / two("n")
    return k.agg((F.sum(two("t")) / 2).cast("long").alias("pairs"), F.round(F.sum("same") / F.sum(two("t")), 6).alias("agreement"), F.sum("t").alias("n")).crossJoin(F.broadcast(v)).select(
        "pairs", "agreement", F.round(base, 6).alias("baseline"), F.round(F.sqrt(base * (1 - base) / F.col("pairs")), 6).alias("spread")
    )


@query("""SELECT lang, count(CASE WHEN quality = 1 AND p THEN 1 END) AS tp, count(CASE WHEN quality = 0 AND p THEN 1 END) AS fp, count(CASE WHEN quality = 1 AND NOT p THEN 1 END) AS fn, count(CASE WHEN quality = 0 AND NOT p THEN 1 END) AS tn,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision
FROM (SELECT lang, quality, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY lang""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return mt.confusion(d, F.col("quality") == 1, F.col("n_chars") > 800, "lang")


_THRESHOLDS = [(k, t) for k, t in enumerate((0.0, 100.0, 200.0, 400.0, 600.0, 800.0, 1200.0, 2000.0))]


@query(f"""WITH d AS (SELECT CASE WHEN quality = 0 THEN 'answer' WHEN lang = 'en' THEN 'template' ELSE 'other' END AS pool, n_chars AS x FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), t AS (SELECT * FROM {values(_THRESHOLDS, 'k, threshold')}),
r AS (SELECT k, round(1 - count(CASE WHEN pool = 'answer' AND x > threshold THEN 1 END) / nullif(count(CASE WHEN pool = 'answer' THEN 1 END), 0), 6) AS precision, round(count(CASE WHEN pool = 'template' AND x > threshold THEN 1 END) / nullif(count(CASE WHEN pool = 'template' THEN 1 END), 0), 6) AS template_recall,
  round(count(CASE WHEN pool = 'other' AND x > threshold THEN 1 END) / nullif(count(CASE WHEN pool = 'other' THEN 1 END), 0), 6) AS other_recall FROM d, t GROUP BY k)
SELECT *, template_recall = 1 AND row_number() OVER (ORDER BY template_recall = 1 DESC, round(precision + other_recall, 9) DESC NULLS LAST, k) = 1 AS chosen FROM r""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold in one pass; of those that catch all templates the best sum of precision and other recall is chosen."""
    d = table(spark, sf_dir, "labels").where("quality is not null").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    pool = F.when(F.col("quality") == 0, "answer").when(F.col("lang") == "en", "template").otherwise("other")
    return mt.threshold_choice(d.select(pool.alias("pool"), F.col("n_chars").alias("value")), _THRESHOLDS)


_EDGES = (0.0, 0.6, 0.75, 0.85, 0.95, 1.01)


@query("""WITH d AS (SELECT quality, (n_chars % 1000) / 1000.0 AS e, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN e < 0.6 THEN 0 WHEN e < 0.75 THEN 1 WHEN e < 0.85 THEN 2 WHEN e < 0.95 THEN 3 ELSE 4 END AS band, count(*) AS n, round(avg((p = (quality = 1))::INT), 6) AS accuracy, round(greatest(avg(quality), 1 - avg(quality)), 6) AS baseline FROM d GROUP BY band""")
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    e = (F.col("n_chars") % 1000) / 1000.0
    right = ((F.col("n_chars") > 800) == (F.col("quality") == 1)).cast("int")
    return d.groupBy(mt.band(e, _EDGES).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.greatest(F.avg("quality"), 1 - F.avg("quality")), 6).alias("baseline"))


@query("""WITH z AS (SELECT p_type, count(*) AS size FROM part GROUP BY ALL), x AS (SELECT p_partkey, p_size <= 25 AS hit, size FROM part JOIN z USING (p_type)), o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM x),
q AS (SELECT max(CASE WHEN i = n // 4 THEN size END) AS q1, max(CASE WHEN i = n // 2 THEN size END) AS q2, max(CASE WHEN i = 3 * n // 4 THEN size END) AS q3 FROM o)
SELECT CASE WHEN size < q1 THEN 1 WHEN size < q2 THEN 2 WHEN size < q3 THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate FROM x, q GROUP BY ALL""")
def quartile_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of parts by how crowded their type is."""
    p = table(spark, sf_dir, "part")
    x = p.join(p.groupBy("p_type").agg(F.count(F.lit(1)).alias("size")), "p_type")
    q = x.crossJoin(F.broadcast(mt.quartile_cuts(x, "size")))
    quartile = F.when(F.col("size") < F.col("q1"), 1).when(F.col("size") < F.col("q2"), 2).when(F.col("size") < F.col("q3"), 3).otherwise(4)
    return q.groupBy(quartile.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p_size") <= 25).cast("int")), 6).alias("hit_rate"))


@query("SELECT hit, count(*) AS n, median(size)::DOUBLE AS median FROM (SELECT p_size <= 25 AS hit, count(*) OVER (PARTITION BY p_type) AS size FROM part) GROUP BY hit")
def crowding_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How crowded the types of hits and of misses are in the middle."""
    p = table(spark, sf_dir, "part")
    x = p.join(p.groupBy("p_type").agg(F.count(F.lit(1)).alias("size")), "p_type").select((F.col("p_size") <= 25).alias("hit"), "size")
    return mt.medians(x, "size", "hit")


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, round(avg(value), 1) AS mean, round(median(value), 1) AS p50, round(max(CASE WHEN i = CASE WHEN n >= 20 THEN floor(n * 0.95) ELSE n END THEN value END), 1) AS p95, round(max(value), 1) AS max FROM o GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.latency(table(spark, sf_dir, "events"), "value", "event_type")




@query("SELECT label, dim, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding) AS v FROM embeddings) GROUP BY ALL")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(F.round(F.avg("v"), 6).alias("mean")).withColumn("dim", F.col("dim").cast("long"))


@query("""WITH m AS (SELECT label, dim, avg(v) AS x FROM (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY dim) AS c FROM m GROUP BY label),
u AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c), s AS (SELECT vec_id, e.label AS truth, u.label AS guess, round(list_dot_product(embedding::DOUBLE[], c), 6) AS score FROM embeddings e, u)
SELECT vec_id, truth, guess, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, guess) = 1""")
def centroid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector by the nearest normalised mean of a label."""
    e = table(spark, sf_dir, "embeddings")
    return de.nearest_centroid(e.select("vec_id", F.col("label").alias("truth"), F.col("embedding").alias("v")), de.centroids(e.select("label", F.col("embedding").alias("v"))), "vec_id").select("vec_id", "truth", "guess", "score")


#: Each label's prototypes: so many vectors with the lowest ids.
_PROTOTYPES = 12
_PROTO_SQL = f"p AS (SELECT vec_id AS pid, label, embedding::DOUBLE[] AS c FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {_PROTOTYPES})"
_TOP_SQL = f"""{_PROTO_SQL}, s AS (SELECT e.vec_id, p.label, list_dot_product(e.embedding::DOUBLE[], c) AS d FROM embeddings e, p),
k AS (SELECT vec_id, label, d FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, label ORDER BY d DESC) <= 4), t AS (SELECT vec_id, label, round(avg(d), 6) AS score FROM k GROUP BY ALL)"""


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, v): a declared number of prototypes for each label."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("v"))
    return rt.top_n(e, _PROTOTYPES, F.col("vec_id"), key="label").select("label", "v")


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return de.prototype_scores(e, prototypes(spark, sf_dir))


@query(f"WITH {_TOP_SQL} SELECT vec_id, label, score FROM t")
def topk_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector and label, the mean of the four nearest prototypes."""
    return similarities(spark, sf_dir)


# The vectors' labels stand for utterance classes: buying, browsing, override, continuation, non-answer.
_CLASSES = {"buying": 0, "browsing": 1, "override": 2, "continuation": 3, "non_answer": 4}


@query("""WITH m AS (SELECT label, dim, avg(v) AS x FROM (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label IN (0, 1)) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY dim) AS c FROM m GROUP BY label),
u AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c),
s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT c FROM u WHERE label = 0)) - list_dot_product(embedding::DOUBLE[], (SELECT c FROM u WHERE label = 1)), 6) AS score FROM embeddings) SELECT vec_id, score, CASE WHEN score > 0 THEN 'buying' ELSE 'browsing' END AS label FROM s""")
def intent_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buying or browsing by the difference of the similarities to two centroids."""
    e = table(spark, sf_dir, "embeddings")
    protos = e.where(F.col("label").isin(_CLASSES["buying"], _CLASSES["browsing"])).select(F.when(F.col("label") == _CLASSES["buying"], "buying").otherwise("browsing").alias("label"), F.col("embedding").alias("v"))
    return de.intent(e.select("vec_id", F.col("embedding").alias("v")), protos, "vec_id")


@query(f"WITH {_TOP_SQL}, w AS (SELECT vec_id, max(CASE WHEN label = 2 THEN score END) AS o, max(CASE WHEN label IN (0, 1, 3) THEN score END) AS r, max(CASE WHEN label = 4 THEN score END) AS n FROM t GROUP BY vec_id) SELECT vec_id, o > r AS override, n > 0.68 AS non_answer FROM w")
def detector_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override: nearer to its prototypes than to those of any other kind of turn; non-answer: near enough to its own."""
    s = similarities(spark, sf_dir)
    name = F.create_map(*(x for k, v in _CLASSES.items() for x in (F.lit(v), F.lit(k))))
    return de.votes(s.withColumn("label", F.try_element_at(name, F.col("label").cast("int"))).where("label is not null"), "vec_id")


_RULES = (("centroid", 0), ("top", 1), ("top", 3), ("top", 4), ("top", 6), ("top", 12))


@query(
    f"""WITH {_PROTO_SQL}, s AS (SELECT e.vec_id, e.label AS truth, p.label, list_dot_product(e.embedding::DOUBLE[], c) AS d, row_number() OVER (PARTITION BY e.vec_id, p.label ORDER BY list_dot_product(e.embedding::DOUBLE[], c) DESC) AS i FROM embeddings e, p),
m AS (SELECT label, list(x ORDER BY dim) AS c FROM (SELECT label, dim, avg(v) AS x FROM (SELECT label, unnest(range(0, 64)) AS dim, unnest(c) AS v FROM p) GROUP BY ALL) GROUP BY label),
z AS (SELECT 'centroid' AS rule, 0 AS k, vec_id, e.label AS truth, m.label, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(c, c)), 6) AS score FROM embeddings e, m
  UNION ALL SELECT 'top', k, vec_id, truth, label, round(avg(d), 6) FROM s, (VALUES (1), (3), (4), (6), (12)) r(k) WHERE i <= k GROUP BY ALL),
b AS (SELECT rule, k, truth, label FROM z QUALIFY row_number() OVER (PARTITION BY rule, k, vec_id ORDER BY score DESC, label) = 1)
SELECT rule, k, count(*) AS n, round(avg((truth = label)::INT), 6) AS accuracy FROM b GROUP BY ALL"""
)
def rule_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest centroid against the mean of the nearest 1 to 12 prototypes: one job for all rules."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), F.col("embedding").alias("v"))
    p = prototypes(spark, sf_dir)
    out = None
    for rule, k in _RULES:
        if rule == "centroid":
            scored = de.nearest_centroid(e, de.centroids(p), "vec_id")
        else:
            scored = rt.top_n(de.prototype_scores(e, p, k, ("vec_id", "truth")).withColumnRenamed("label", "guess"), 1, F.desc("score"), F.col("guess"), key="vec_id")
        part = scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("guess")).cast("int")), 6).alias("accuracy")).select(F.lit(rule).alias("rule"), F.lit(k).alias("k"), "n", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS session FROM orders), c AS (SELECT o_custkey, value, count(*) AS n, min(session) AS first_seen FROM o GROUP BY ALL),
s AS (SELECT o_custkey, max(session) AS sessions FROM o GROUP BY ALL)
SELECT o_custkey, sessions, value, n FROM s LEFT JOIN (SELECT * FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first_seen) = 1) c USING (o_custkey)""")
def profile_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each profile, and the value it repeated most (at least twice; first seen wins ties)."""
    session = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("value"), session.alias("session"))
    s = o.groupBy("o_custkey").agg(F.max("session").cast("long").alias("sessions"))
    c = o.groupBy("o_custkey", "value").agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first_seen")).where("n >= 2")
    best = rt.top_n(c, 1, F.desc("n"), F.col("first_seen"), key="o_custkey").drop("rank", "first_seen")
    return s.join(best, "o_custkey", "left")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM orders),
h AS (SELECT a.o_custkey, a.run, max(n) AS n FROM o a LEFT JOIN (SELECT x.o_custkey, x.run, y.value, count(*) AS n FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND y.run < x.run GROUP BY ALL) b ON a.o_custkey = b.o_custkey AND a.run = b.run GROUP BY ALL)
SELECT run, count(*) AS sessions, count(CASE WHEN n >= 2 THEN 1 END) AS carried FROM h GROUP BY run""")
def store_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first, second, ... sessions of all profiles: how many start with a value that earlier ones corroborate."""
    order = ("o_orderdate", "o_orderkey")
    run = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))
    again = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*order))
    o = table(spark, sf_dir, "orders").select("o_custkey", run.cast("long").alias("run"), again.alias("again"))
    since = F.min(F.when(F.col("again") == 2, F.col("run"))).over(Window.partitionBy("o_custkey"))
    o = o.withColumn("since", since)
    return o.groupBy("run").agg(F.count(F.lit(1)).alias("sessions"), F.count(F.when(F.col("run") > F.col("since"), 1)).alias("carried"))


@query("""WITH p AS (SELECT p_brand AS query_id, p_partkey AS doc_id, p_size, p_retailprice, (SELECT avg(nullif(p_size, 0)) FROM part) AS mean FROM part)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY p_size DESC, doc_id)::INT AS by_rating, row_number() OVER (PARTITION BY query_id ORDER BY round(abs(p_size - (mean + 0.25 * (10 - mean))), 6), doc_id)::INT AS by_closeness FROM p""")
def prior_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings by rating and by closeness to the rating that a profile predicts."""
    p = table(spark, sf_dir, "part")
    mean = p.agg(F.avg(F.nullif("p_size", F.lit(0))).alias("mean"))
    x = p.crossJoin(F.broadcast(mean)).select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_size", F.round(F.abs(F.col("p_size") - (F.col("mean") + 0.25 * (10 - F.col("mean")))), 6).alias("gap"))
    rank = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
    return x.select("query_id", "doc_id", rank(F.desc("p_size"), "doc_id").alias("by_rating"), rank("gap", "doc_id").alias("by_closeness"))


@query("""WITH h AS (SELECT user_id, len(list_distinct(list(event_type))) AS n FROM events GROUP BY ALL) SELECT n AS kinds, count(*) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(n * count(*)) OVER () / sum(count(*)) OVER (), 6) AS mean FROM h GROUP BY n""")
def remaining_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))
    n = h.groupBy("kinds").agg(F.count(F.lit(1)).alias("users"))
    total = n.agg(F.sum("users").alias("t"), F.sum(F.col("users") * F.col("kinds")).alias("all"))
    return n.crossJoin(F.broadcast(total)).select("kinds", "users", F.round(F.col("users") / F.col("t"), 6).alias("share"), F.round(F.col("all") / F.col("t"), 6).alias("mean"))


@query("""WITH a AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS x, max((event_type = 'purchase')::INT) AS hit FROM events WHERE ts::DATE <= DATE '2024-01-10' GROUP BY ALL), b AS (SELECT user_id, max((event_type = 'purchase')::INT) AS hit FROM events WHERE ts::DATE > DATE '2024-01-10' GROUP BY ALL)
SELECT coalesce(a.hit, 0) AS before, coalesce(b.hit, 0) AS after, count(*) AS n FROM a FULL JOIN b USING (user_id) GROUP BY ALL""")
def outcome_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-key comparison of two runs: who hit in both, lost or won."""
    e = table(spark, sf_dir, "events").withColumn("early", F.to_date("ts") <= F.lit("2024-01-10").cast("date"))
    hit = F.max((F.col("event_type") == "purchase").cast("int"))
    a, b = e.where("early").groupBy("user_id").agg(hit.alias("a")), e.where("not early").groupBy("user_id").agg(hit.alias("b"))
    joined = a.join(b, "user_id", "full")
    return joined.groupBy(F.coalesce("a", F.lit(0)).alias("before"), F.coalesce("b", F.lit(0)).alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 day, ts)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = live.windowed_counts(table(spark, sf_dir, "events"), "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 hour, true) AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 hour) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = live.user_sessions(table(spark, sf_dir, "events"), "6 hours")
    return w.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@query(f"SELECT id AS missing FROM {values([(1,), (7,), (999999999,)], 'id')} WHERE id NOT IN (SELECT p_partkey FROM part)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = relation(spark, [(1,), (7,), (999999999,)], "missing int")
    return asked.join(table(spark, sf_dir, "part"), F.col("missing") == F.col("p_partkey"), "left_anti")



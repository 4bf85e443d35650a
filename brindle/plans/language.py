"""Text, attribute, budget and cue queries on literal messages and on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extract as ex
from ..functions import text as tx
from ..functions.text import NOT_AFTER, NOT_BEFORE
from ..functions import vocab
from .registry import _sql, query, relation, table, values

MESSAGES = [
    (1, "I must have a red cotton shirt under $40"),
    (2, "not sure, just browsing for whatever looks good"),
    (3, "I dont want black, show me something in navy"),
    (4, "never mind, I need size 9 boots made of leather"),
    (5, "I don't have a preference, please use your judgment."),
    (6, "Actually, no. Forget that and find silk scarves, at least 120 dollars"),
    (7, "no more than sixty five bucks please"),
    (8, "over two hundred dollars is fine, silver or gold"),
    (9, "it's up to you"),
    (10, ""),
    (11, "The embroidered one is lovely; COLOUR and Jewellery matter, favourite colours too"),
    (12, "I don't have a preference, but black is fine"),
    (13, "anything goes, without leather though"),
    (14, "I'm not picky. Exactly this beige with a zip, 12 inches"),
    (15, "starting at $19.99, wool or cashmere"),
    (16, "hundred usd"),
    (17, None),
]
_M = values(MESSAGES, "id, text")

# Fixed turns of their own session that change the category.
PIVOTS = [(-2, 1, "I want a small widget"), (-2, 2, "never mind, show me a gear instead"), (-2, 3, "Actually, ignore the gear. A red widget"), (-2, 4, "it's up to you, no preference"), (-2, 5, "forget that, blue gears and bolts")]

# Word edges for an engine without look-around.
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _plain(pattern: str) -> str:
    """A pattern of the library with its look-arounds as edges that are consumed."""
    return pattern.replace(NOT_BEFORE, _L).replace(NOT_AFTER, _R).replace("'", "''")


def _has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{_L}(?:{pattern}){_R}')"


def negated_sql(lead: str) -> str:
    return f"regexp_matches(regexp_replace(right({lead}, {vocab.NEGATION_WINDOW}), '(?s)^.*(?:{_plain(ex.CLAUSE_END)})', ''), '{_plain(ex.NEGATION)}')"


def asserted_sql(t: str, pattern: str) -> str:
    """Whether some match of a word pattern is not negated: tried at every place where a word can begin."""
    p = pattern.replace("'", "''")
    at = f"regexp_matches(substr({t}, i), '^(?:{p}){_R}') AND (i = 1 OR regexp_matches(substr({t}, i - 1, 1), '[^\\p{{L}}\\p{{N}}_]')) AND NOT {negated_sql(f'left({t}, i - 1)')}"
    return f"CASE WHEN {_has(t, p)} THEN len(list_filter(range(1, len({t}) + 1), lambda i: {at})) > 0 ELSE false END"


def disclosed_sql(t: str, words) -> str:
    lead = lambda w: f"regexp_extract({t}, '(?s)^(.*?{_L})(?:{w}){_R}', 1)"
    return "CASE " + " ".join(f"WHEN {_has(t, w)} AND NOT {negated_sql(lead(w))} THEN '{w}'" for w in words) + " END"


def detected_sql(t: str) -> str:
    any_of = lambda words: "(" + " OR ".join(asserted_sql(t, w) for w in words) + ")"
    flags = (("material", any_of(vocab.MESSAGE_MATERIALS)), ("color", any_of(vocab.COLORS)), ("size", f"regexp_matches({t}, '{_plain(ex.SIZE)}')"), ("budget", f"regexp_matches({t}, '{_plain(ex.PRICE)}')"))
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {f} THEN '{n}' END" for n, f in flags) + ")"


def defer_sql(t: str) -> str:
    return f"regexp_matches({t}, '{_plain(ex.DEFER_CUE)}')"


def reply_sql(t: str) -> str:
    return f"CASE WHEN trim({t}) = '' OR {detected_sql(t)} <> '' THEN 'answer' WHEN regexp_matches({t}, '{_plain(ex.DECLINE_CUE)}') THEN 'non_answer' ELSE 'answer' END"


def override_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower({text}), '[.,;:!?]+'), lambda c: regexp_matches(c, '^\\s*(?:{_plain(ex.OVERRIDE_CUE)})'))) > 0"


def messages(spark: SparkSession) -> DataFrame:
    return relation(spark, MESSAGES, "id int, text string")


#: Every turn of the conversations, and the messages as one of their own.
_TURNS = f"(SELECT conv_id, turn, text, lower(coalesce(text, '')) AS t FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, id, text FROM {_M}))"


def all_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = messages(spark).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(own)


def budget_sql(t: str = "t") -> str:
    units = "one|two|three|four|five|six|seven|eight|nine"
    heads = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|" + units + "|" + "|".join(w for w, n in vocab.UNITS.items() if n > 9)
    word = rf"\b((?:{units})\s+hundred|hundred|{heads})(?:[\s-]+({units}))?\s*(?:dollars?|bucks?|usd)\b"
    digit = r"\$\s?(\d+(?:\.\d+)?)|\b(\d+(?:\.\d+)?)\s*(?:dollars?|bucks?|usd)\b"
    number = "map {" + ", ".join(f"'{w}': {n}" for w, n in {**vocab.UNITS, **vocab.TENS}.items()) + "}"
    amount = f"""CASE WHEN regexp_matches({t}, '{digit}') THEN (regexp_extract({t}, '{digit}', 1) || regexp_extract({t}, '{digit}', 2))::DOUBLE
      WHEN regexp_matches({t}, '{word}') THEN CASE WHEN regexp_extract({t}, '{word}', 1) = 'hundred' THEN 100 WHEN suffix(regexp_extract({t}, '{word}', 1), 'hundred') THEN 100 * {number}[string_split(regexp_extract({t}, '{word}', 1), ' ')[1]]
      WHEN {number}[regexp_extract({t}, '{word}', 1)] >= 20 THEN {number}[regexp_extract({t}, '{word}', 1)] + coalesce({number}[regexp_extract({t}, '{word}', 2)], 0) ELSE {number}[regexp_extract({t}, '{word}', 1)] END END"""
    lead = f"left({t}, instr({t}, CASE WHEN regexp_matches({t}, '{digit}') THEN regexp_extract({t}, '{digit}') ELSE regexp_extract({t}, '{word}') END)::INT - 1)"
    cue = lambda cues: "(" + " OR ".join(f"contains({lead}, '{c}')" for c in cues) + ")"
    return f"CASE WHEN {amount} IS NOT NULL THEN CASE WHEN {cue(vocab.NEGATED_FLOOR_CUES)} THEN '<=' WHEN {cue(vocab.FLOOR_CUES)} THEN '>=' ELSE '<=' END || printf('%g', {amount}) END"


@query(f"SELECT conv_id, turn, {budget_sql()} AS budget FROM {_TURNS}")
def budget_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_turns(spark, sf_dir).select("conv_id", "turn", ex.budget(F.col("text")).alias("budget"))


_BOUNDS = [("<=950",), (">=950",), ("<=900.5",), ("around 10",), (">=",)]


@query(f"""SELECT token, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS met, count(ok) AS known FROM (SELECT token,
CASE WHEN left(token, 2) = '<=' THEN p_retailprice <= try_cast(substr(token, 3) AS DOUBLE) WHEN left(token, 2) = '>=' THEN p_retailprice >= try_cast(substr(token, 3) AS DOUBLE) END AS ok FROM part, {values(_BOUNDS, 'token')}) GROUP BY token""")
def budget_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "part").crossJoin(F.broadcast(relation(spark, _BOUNDS, "token string")))
    ok = ex.budget_met(F.col("token"), F.col("p_retailprice"))
    return both.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("met"), F.count(ok).alias("known"))


def _first_word_sql(col: str, words) -> str:
    return "CASE " + " ".join(f"WHEN {_has(col, w)} THEN '{w}'" for w in words) + " END"


@query(f"SELECT p_partkey, {_first_word_sql('lower(p_name)', vocab.COLORS)} AS color, {_first_word_sql('lower(p_type)', vocab.CATALOG_MATERIALS)} AS material FROM part")
def attr_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", ex.vocab_value(F.col("p_name"), vocab.COLORS).alias("color"), ex.vocab_value(F.col("p_type"), vocab.CATALOG_MATERIALS).alias("material"))


@query(f"SELECT conv_id, turn, {disclosed_sql('t', vocab.COLORS)} AS color, {disclosed_sql('t', vocab.CATALOG_MATERIALS)} AS material FROM {_TURNS}")
def disclosed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return all_turns(spark, sf_dir).select("conv_id", "turn", ex.disclosed_value(text, vocab.COLORS).alias("color"), ex.disclosed_value(text, vocab.CATALOG_MATERIALS).alias("material"))


# Windows of the negation rule that are compared.
_WINDOWS = (10, 15, 20, 25, 30)


@query(f"""WITH w AS (SELECT conv_id, turn, t, list_filter(range(2, len(t) + 1), lambda i: regexp_matches(substr(t, i, 1), '[\\p{{L}}\\p{{N}}_]') AND regexp_matches(substr(t, i - 1, 1), '[^\\p{{L}}\\p{{N}}_]')) AS starts FROM {_TURNS})
SELECT conv_id, turn, len(starts) AS words, len(list_filter(starts, lambda i: {negated_sql('left(t, i - 1)')})) AS negated FROM w""")
def negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a turn's words (but one at its very beginning) are negated."""
    low = F.lower(F.coalesce("text", F.lit("")))
    places = ex.leads(low, F.lit(r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+"))
    turns = all_turns(spark, sf_dir).select("conv_id", "turn", places.alias("leads"))
    return turns.select("conv_id", "turn", F.size("leads").cast("long").alias("words"), F.size(F.filter("leads", lambda x: ex.negated_before(x))).cast("long").alias("negated"))


def _intent_sql(t: str) -> str:
    hits = lambda ps: " + ".join(f"({asserted_sql(t, p)})::INT" for p in ps)
    plain = lambda ws: " + ".join(f"({_has(t, w)})::INT" for w in ws)
    buying = f"greatest({hits(ex.BUYING_PHRASES)}, {plain(vocab.COLORS)}, {plain(vocab.MESSAGE_MATERIALS)}, regexp_matches({t}, '{_plain(ex.SIZE)}')::INT, regexp_matches({t}, '{_plain(ex.PRICE)}')::INT)"
    return f"{buying} AS buying, {hits(ex.BROWSING_PHRASES)} AS browsing"


@query(f"SELECT conv_id, turn, buying, browsing, CASE WHEN buying > browsing THEN 'buying' ELSE 'browsing' END AS label FROM (SELECT conv_id, turn, {_intent_sql('t')} FROM {_TURNS})")
def lexical_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_turns(spark, sf_dir).select("conv_id", "turn", ex.lexical_intent(F.col("text")).alias("i"))
    return rows.select("conv_id", "turn", "i.label", "i.buying", "i.browsing")


@query(f"SELECT conv_id, turn, {detected_sql('t')} AS attributes FROM {_TURNS}")
def detected_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_turns(spark, sf_dir).select("conv_id", "turn", F.array_join(ex.detected_attributes(F.col("text")), ",").alias("attributes"))


@query(
    "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[.,;:!?]+'), lambda c: regexp_matches(c, '^\\s*(?:" + ex.OVERRIDE_CUE.replace("'", "''") + ")'))) > 0 AS override, "
    "regexp_matches(lower(text), '" + ex.DEFER_CUE.replace("'", "''") + "') AS defer, regexp_matches(lower(text), '" + ex.DECLINE_CUE.replace("'", "''") + "') AS decline "
    f"FROM (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT -1, id, text FROM {_M} WHERE text IS NOT NULL)"
)
def reply_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(messages(spark).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), "text"))
    text = F.col("text")
    return c.where(text.isNotNull()).select("conv_id", "turn", ex.override_cue(text).alias("override"), ex.defer_cue(text).alias("defer"), F.lower(text).rlike(ex.DECLINE_CUE).alias("decline"))


@query(f"SELECT conv_id, turn, {reply_sql('t')} AS label FROM {_TURNS}")
def reply_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_turns(spark, sf_dir).select("conv_id", "turn", ex.reply_class(F.col("text")).alias("label"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text), '^[^\n]{0,60}?[.,;:!?]\s') THEN regexp_extract(trim(text), '^([^\n]{0,60}?)[.,;:!?]\s', 1) ELSE text END AS lead FROM conversations")
def lead_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ex.lead_clause(F.col("text")).alias("lead"))


def spelling_sql(text: str = "coalesce(text, '')") -> str:
    out = text
    for word, new in vocab.SPELLINGS.items():
        for pattern, form in ((word.upper(), new.upper()), (f"{word[0].upper()}(?i:{word[1:]})", new.capitalize()), (f"{word[0]}(?i:{word[1:]})", new)):
            out = f"regexp_replace({out}, '\\b{pattern}\\b', '{form}', 'g')"
    return out


@query(f"SELECT conv_id, turn, {spelling_sql()} AS text FROM {_TURNS}")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_turns(spark, sf_dir).select("conv_id", "turn", tx.normalized_query(F.col("text")).alias("text"))


_CONSTRAINTS = [(s,) for s in ("budget around $12", "under 40", "100% Cotton fabric", "Color: red", "wide width", "Department: Mens", "good for hiking", "machine washable", "<= 9 wide", "sleeveless", "workwear")]


def class_sql(c: str) -> str:
    low = f"lower({c})"
    any_of = lambda words: " OR ".join(f"contains({low}, '{w}')" for w in words)
    each = " ".join(f"WHEN {any_of(words)} THEN '{kind}'" for kind, words in ex.CONSTRAINT_WORDS.items())
    return f"CASE WHEN contains({low}, 'budget') OR regexp_matches({low}, '{ex.CONSTRAINT_PRICE}') THEN 'budget' {each} ELSE 'feature' END"


@query(f"SELECT value, {class_sql('value')} AS kind, count(*) AS n FROM (SELECT value FROM {values(_CONSTRAINTS, 'value')} UNION ALL SELECT p_name FROM part UNION ALL SELECT lower(p_type) || ' under ' || p_size FROM part) GROUP BY value")
def constraint_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    stated = relation(spark, _CONSTRAINTS, "value string").unionByName(p.select(F.col("p_name").alias("value"))).unionByName(p.select(F.concat(F.lower("p_type"), F.lit(" under "), F.col("p_size").cast("string")).alias("value")))
    return stated.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select("value", ex.constraint_class(F.col("value")).alias("kind"), "n")


@query(r"""SELECT p_partkey, trim(regexp_replace(coalesce(p_name, '') || ' | ' || p_brand || ' | ' || p_type, '\s+', ' ', 'g')) AS passage, trim(p_name || ' ' || p_brand || ' ' || p_type) AS searchable,
CASE WHEN p_type LIKE 'ECONOMY%' THEN 'first' ELSE 'other' END AS kind FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part)""")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.StringType()
    fields = [(F.col(c), s) for c in ("p_name", "p_brand", "p_type")]
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.passage(fields).alias("passage"), tx.searchable(fields).alias("searchable"), F.when(F.col("p_type").startswith("ECONOMY"), "first").otherwise("other").alias("kind")
    )


_PATHS = [
    (1, ["Clothing, Shoes & Jewelry", "Women", "Shoes", "Boots"]), (2, ["clothing"]), (3, []), (4, ["Clothing", "Men, Shirts"]), (5, ["Root", " Watches "]),
    (6, ["Clothing, Shoes & Jewelry", "Men"]),
]


@query(f"""WITH p AS (SELECT id, list_filter(flatten(list_transform(path, lambda v: list_transform(string_split(v, ','), lambda x: trim(x)))), lambda x: x <> '' AND lower(x) NOT IN ('clothing', 'clothing shoes & jewelry', 'clothing, shoes & jewelry')) AS parts FROM {values(_PATHS, 'id, path')})
SELECT id, CASE WHEN len(parts) = 0 THEN 'clothing item' ELSE array_to_string(parts[greatest(1, len(parts) - 1) : len(parts)], ' ') END AS category FROM p""")
def coarse_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, _PATHS, "id int, path array<string>").select("id", tx.coarse_category(F.col("path"), F.lit("clothing item")).alias("category"))


@query("""WITH first AS (SELECT * FROM documents ORDER BY doc_id LIMIT 1000), n AS (SELECT lang, count(*) AS c FROM first GROUP BY lang)
SELECT lang AS label, c AS n, round(c / (SELECT count(*) FROM first), 6) AS share, (c / (SELECT count(*) FROM first)) >= 0.95 AS is_root FROM n ORDER BY c DESC, lang LIMIT 1""")
def root_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common first label of a fixed sample of the catalog, and whether it is universal."""
    sample = table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(vocab.ROOT_SAMPLE)
    n = sample.groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = sample.agg(F.count(F.lit(1)).alias("total"))
    share = F.col("n") / F.col("total")
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.round(share, 6).alias("share"), (share >= vocab.ROOT_SHARE).alias("is_root")).orderBy(F.desc("n"), "label").limit(1)


@query("""WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) SELECT word, count(*) AS df FROM w WHERE regexp_full_match(word, '[a-z]+') AND NOT list_contains(""" + _sql(list(vocab.DEMOGRAPHIC_WORDS)) + """, word) GROUP BY word HAVING count(*) >= 20""")
def category_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]+$") & ~F.col("word").isin(*vocab.DEMOGRAPHIC_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= vocab.CATEGORY_LEAST_DF)


_CARDS = [
    (1, "Soft Shirt", ["100% cotton", " machine washable; ", "100% cotton"], 19.5), (2, None, [], None), (3, "Red  boot,", ["leather upper", "rubber sole", "zip", "warm"], None), (4, "Watch", [], 80.0),
]
_CARD_RESULT = [
    (1, "Soft Shirt", ["cotton", "100% cotton"], ["machine washable", "budget around $19.5"]), (2, "product", ["product"], ["product"]),
    (3, "Red boot", ["leather", "color: red"], ["leather upper", "rubber sole"]), (4, "Watch", ["budget around $80.0"], ["budget around $80.0"]),
]


@query(f"SELECT id, category, array_to_string(hard, '|') AS hard, array_to_string(soft, '|') AS soft FROM {values(_CARD_RESULT, 'id, category, hard, soft')}")
def intent_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, _CARDS, "id int, title string, features array<string>, price double")
    features = F.col("features")
    kind = T.ArrayType(T.StringType())
    corpus = tx.searchable([(F.col("title"), T.StringType()), (features, kind)])
    card = ex.intent_card(F.col("title"), tx.flat_values(features, kind), corpus, F.col("price"))
    rows = rows.select("id", card.alias("c"))
    return rows.select("id", F.col("c.target_category").alias("category"), F.array_join("c.hard_constraints", "|").alias("hard"), F.array_join("c.soft_preferences", "|").alias("soft"))


@query("""SELECT 'documents' AS name, max(n) AS n, sha256(string_agg(part, ',' ORDER BY k)) AS sha FROM (SELECT k, count(*) AS n, sum(('0x' || substr(h, 1 + 15 * k, 15))::BIGINT)::VARCHAR AS part
FROM (SELECT sha256(doc_id::VARCHAR || '|' || coalesce(text, '')) AS h FROM documents), (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY k)""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's content digest, an index build's staleness check: sums of parts of row digests, in any order."""
    rows = table(spark, sf_dir, "documents").select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return rows.agg(F.lit("documents").alias("name"), F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", *parts), 256).alias("sha"))


@query("""SELECT c_custkey, left(sha256('{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}'), 16) AS profile_key FROM customer""")
def profile_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.left(F.sha2(body, 256), F.lit(16)).alias("profile_key"))

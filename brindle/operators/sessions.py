"""The per-session state machine: one pure transition, and native columns that give the same fold."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import text as tx
from ..functions import vocab

RECENT = 10
#: Characters of a query.
QUERY_CHARS = 2000
SLOTS = ("material", "color", "budget")
FOLDED = (
    "session long, turn long, segment int, query string, phrase_query string, boundary boolean, color string, material string, budget string, "
    "retracted string, informative int"
)


def turn_signals(turns: DataFrame, text: str = "text") -> DataFrame:
    """(session, turn, text) with what the transition needs, all from native expressions.

    ``turns`` may carry ``categories``, the category words that a turn names (``named_categories``).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce("categories", F.array().cast("array<string>")) if "categories" in turns.columns else F.array().cast("array<string>")
    return turns.select(
        "session", "turn", t.alias("text"), ex.override_cue(t).alias("override"), ex.defer_cue(t).alias("defer"),
        (ex.reply_class(t) == "non_answer").alias("contentless"), ex.disclosed_value(t, vocab.COLORS).alias("color"),
        ex.disclosed_value(t, vocab.CATALOG_MATERIALS).alias("material"), ex.budget(t).alias("budget"), named.alias("categories"),
    )


def named_categories(turns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``turns`` with ``categories``: the words of ``vocabulary`` (word) that a turn names, as they are or in the plural.

    Words of attributes name no category; of a term, its plural by s and that by es, the first that
    is in the vocabulary counts.
    """
    attribute = tx.literals(sorted({w for v in (*vocab.CATALOG_MATERIALS, *vocab.COLORS) for w in v.split()}))
    terms = F.array_distinct(tx.terms(tx.normalized_query(F.col("text"))))
    forms = turns.select("session", "turn", F.explode(terms).alias("term")).where(~F.array_contains(attribute, F.col("term")))
    each = forms.select("session", "turn", "term", F.posexplode(F.array("term", F.concat("term", F.lit("s")), F.concat("term", F.lit("es")))).alias("k", "word"))
    known = each.join(vocabulary.select("word").distinct(), "word").groupBy("session", "turn", "term").agg(F.min_by("word", "k").alias("word"))
    found = known.groupBy("session", "turn").agg(F.array_sort(F.collect_set("word")).alias("categories"))
    return turns.join(found, ["session", "turn"], "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def fresh() -> dict:
    return {"first": None, "recent": [], "informative": [], "slots": {}, "stated": {}, "retracted": [], "asked": [], "shown": [], "boundary": False, "segment": 0}


def _named(message: dict) -> set:
    return set(message["categories"])


def step(state: dict, row: dict, scoped: bool = False) -> dict:
    """One turn: a new state.

    An override clears what was disclosed, asked, shown and retracted; one that names a category not
    named before also becomes the first message and drops the recent ones, then is itself a recent
    one.  With ``scoped``, an override that states slots and names no new category clears only these
    slots and retracts the values that they had.
    """
    s = {k: list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v for k, v in state.items()}
    told = {k: row[k] for k in SLOTS if isinstance(row[k], str)}
    message = {"text": row["text"], "categories": list(row["categories"]) if row.get("categories") is not None else []}
    if s["first"] is None:
        s["first"] = message
    else:
        if row["override"]:
            new = _named(message) - _named(s["first"]).union(*map(_named, s["recent"]))
            if scoped and told and not new:
                s["retracted"] += [s["slots"][k] for k in told if k != "budget" and s["slots"].get(k, told[k]) != told[k]]
                for k in told:
                    s["slots"].pop(k, None)
                    s["stated"].pop(k, None)
            else:
                s |= {"informative": [], "slots": {}, "stated": {}, "retracted": [], "asked": [], "shown": [], "boundary": False, "segment": s["segment"] + 1}
            if new:
                s |= {"first": message, "recent": []}
        s["boundary"] = s["boundary"] or bool(row["contentless"] and row["defer"])
        if not row["contentless"]:
            s["recent"] = (s["recent"] + [message])[-RECENT:]
            s["informative"] = (s["informative"] + [row["text"]])[-RECENT:]
    for slot, value in told.items():
        s["retracted"] = [x for x in s["retracted"] if x != value]
        s["slots"][slot], s["stated"][slot] = value, row["turn"]
    return s


def query_text(state: dict, recent: list[str]) -> str:
    """The first message and as much of the recent ones as there is room for, without retracted values."""

    def bare(text: str) -> str:
        for value in state["retracted"]:
            text = re.sub(r"(?<!\w)" + re.escape(value) + r"(?!\w)", " ", text, flags=re.IGNORECASE)
        return re.sub(r"\s{2,}", " ", text).strip() if state["retracted"] else text

    first = bare((state["first"] or {"text": ""})["text"])
    tail = bare(" ".join(recent))[-QUERY_CHARS:]
    return " ".join(x for x in (first, tail[: max(0, QUERY_CHARS - len(first) - 1)]) if x)


def view(state: dict, session, turn) -> dict:
    return {
        "session": session, "turn": turn, "segment": state["segment"], "query": query_text(state, [m["text"] for m in state["recent"]]),
        "phrase_query": query_text(state, state["informative"]), "boundary": state["boundary"], **{k: state["slots"].get(k) for k in ("color", "material", "budget")},
        "retracted": ",".join(state["retracted"]), "informative": len(state["informative"]),
    }


def spelled(folded: DataFrame) -> DataFrame:
    """Folded rows with their queries in normal spelling."""
    return folded.withColumn("query", tx.normalized_query(F.col("query"))).withColumn("phrase_query", tx.normalized_query(F.col("phrase_query")))


def fold(signals: DataFrame, scoped: bool = False) -> DataFrame:
    """The state after every turn, by running the transition over each session's turns in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = fresh(), []
        for row in rows.sort_values("turn", kind="stable").to_dict("records"):
            state = step(state, row, scoped)
            out.append(view(state, row["session"], row["turn"]))
        return pd.DataFrame(out)

    return spelled(signals.groupBy("session").applyInPandas(run, FOLDED))


def fold_native(signals: DataFrame) -> DataFrame:
    """What the fold knows but the queries, with window functions: segments by running overrides, last values and counts within each."""
    session = Window.partitionBy("session").orderBy("turn")
    opening = F.row_number().over(session) == 1
    s = signals.withColumn("opens", opening).withColumn("segment", F.sum((F.col("override") & ~F.col("opens")).cast("int")).over(session).cast("int"))
    inside = Window.partitionBy("session", "segment").orderBy("turn")
    told = ~F.col("contentless") & ~F.col("opens")
    last = lambda c: F.last(c, ignorenulls=True).over(inside)
    return s.select(
        "session", "turn", "segment", F.max(F.col("contentless") & F.col("defer") & ~F.col("opens")).over(inside).alias("boundary"), last("color").alias("color"),
        last("material").alias("material"), last("budget").alias("budget"), F.least(F.sum(told.cast("int")).over(inside), F.lit(RECENT)).cast("int").alias("informative"),
    )


def category_pivots(turns: DataFrame) -> DataFrame:
    """(session, turn, pivots, latest): overrides that name a category new to the session's turns so far, and the last of them.

    ``turns`` has (session, turn, override, categories).
    """
    before = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("session").orderBy("turn")
    seen = F.coalesce(F.array_distinct(F.flatten(F.collect_list("categories").over(before))), F.array().cast("array<string>"))
    new = F.array_except("categories", seen)
    pivot = F.col("override") & (F.size(new) > 0) & (F.row_number().over(upto) > 1)
    rows = turns.withColumn("pivots", pivot)
    return rows.select("session", "turn", "pivots", F.last(F.when(F.col("pivots"), F.col("turn")), ignorenulls=True).over(upto).alias("latest"))


# What the simulated customer says.
OPENING = {"buying": ("I'm looking for ", ". A key requirement is: ", "."), "intent_override": ("I'm looking for ", ". ", ""), "other": ("I'm looking for ", "", ", but I'm still exploring.")}
HANDS_BACK = ("I don't have a preference for ", "; please use your judgment.")
NO_QUESTION = "Those options are not quite right yet. Ask me about one specific attribute."
NOTHING_MORE = ("I don't have an additional preference for ", ".")
DISCLOSES = ("For that, what matters is: ", "; ", ".")
OVERRIDES = ("Actually, ignore my earlier preference. What I need is: ", ".")
NO_OLD_VALUE, NO_NEW_VALUE = "I prefer a different style.", "Please prioritize the target requirements."


def behaviour(hard: Column, soft: Column, seed: Column) -> Column:
    """Struct of the turn (3 or 4, by a hash of ``seed``) at which a customer overrides, and the old and new values."""
    turn = F.when(F.crc32(seed.cast("binary")) % 2 == 0, 3).otherwise(4)
    old = F.coalesce(F.try_element_at(soft, F.lit(-1)), F.lit(NO_OLD_VALUE))
    return F.struct(turn.alias("turn"), old.alias("old"), F.coalesce(F.get(hard, F.lit(0)), F.lit(NO_NEW_VALUE)).alias("new"))


def opening_message(kind: Column, category: Column, hard: Column, old: Column) -> Column:
    """Struct of a customer's first message and the constraints that it discloses."""
    none = F.array().cast("array<string>")
    stated = (kind == "buying") & (F.size(hard) > 0)
    a, b, c = OPENING["buying"]
    says = (
        F.when(stated, F.concat(F.lit(a), category, F.lit(b), F.get(hard, F.lit(0)), F.lit(c)))
        .when(kind == "intent_override", F.concat(F.lit(OPENING["intent_override"][0]), category, F.lit(OPENING["intent_override"][1]), old))
        .otherwise(F.concat(F.lit(OPENING["other"][0]), category, F.lit(OPENING["other"][2])))
    )
    return F.struct(says.alias("message"), F.when(stated, F.slice(hard, 1, 1)).otherwise(none).alias("told"))


def customer_reply(kind: Column, constraints: Column, disclosed: Column, ask: Column, handed_back: Column) -> Column:
    """A simulated customer's answer: struct of message and the constraints it discloses.

    A question about something that may not be asked is one about anything ("other").
    """
    none = F.array().cast("array<string>")
    gives_back = (kind == "boundary") & ~handed_back & ask.isNotNull()
    about = F.when(ask.isin(*vocab.ASKABLE), ask).otherwise(F.lit("other"))
    matches = F.slice(F.filter(constraints, lambda c: ~F.array_contains(disclosed, c) & ((about == "other") | (ex.constraint_class(c) == about))), 1, 2)

    def reply(told: Column) -> Column:
        says = (
            F.when(gives_back, F.concat(F.lit(HANDS_BACK[0]), ask, F.lit(HANDS_BACK[1])))
            .when(ask.isNull(), F.lit(NO_QUESTION))
            .when(F.size(told) == 0, F.concat(F.lit(NOTHING_MORE[0]), about, F.lit(NOTHING_MORE[1])))
            .otherwise(F.concat(F.lit(DISCLOSES[0]), F.array_join(told, DISCLOSES[1]), F.lit(DISCLOSES[2])))
        )
        return F.struct(says.alias("message"), F.when(gives_back | ask.isNull(), none).otherwise(told).alias("told"), (handed_back | gives_back).alias("handed_back"))

    return _bound(matches, reply)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; a column used in several places is computed in each when projections are merged."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with(use: Callable, *known) -> Callable[[Column], Column]:
    return lambda x: use(*known, x)


def simulate(customers: DataFrame, asks: list[str | None], turn_of: Column | None = None) -> DataFrame:
    """(session, turn, message, n_told, overridden) of every customer: turn 1 opens, the next ones answer ``asks`` in order.

    ``customers`` has (session, kind, category, hard, soft); ``turn_of`` says at which turn one overrides
    (else a hash of the session and kind).  Turn-synchronous: each round is one
    bound value of one projection, so ten rounds are one plan without a shuffle whose work grows with their number; a policy that needs a
    search between rounds checkpoints after each.
    """
    empty = F.array().cast("array<string>")
    state = customers.withColumn("b", behaviour(F.col("hard"), F.col("soft"), F.concat_ws("|", F.col("session").cast("string"), "kind")))
    if turn_of is not None:
        state = state.withColumn("b", F.col("b").withField("turn", turn_of))
    state = state.withColumn("o", opening_message(F.col("kind"), F.col("category"), F.col("hard"), F.col("b.old")))
    line = lambda turn, message, told, over: F.struct(F.lit(turn).alias("turn"), message.alias("message"), F.size(told).alias("n_told"), over.alias("overridden"))
    rows = state.select("session", "kind", "b", "o", F.concat("hard", "soft").alias("all"), (F.col("kind") != "intent_override").alias("over"))
    first = F.struct(F.col("o.told").alias("disclosed"), F.lit(False).alias("back"), F.col("over").alias("over"), F.array(line(1, F.col("o.message"), F.col("o.told"), F.col("over"))).alias("log"))

    def turned(turn: int, ask: str | None, s: Column) -> Column:
        def after(r: Column) -> Column:
            now = ~s["over"] & (F.col("b.turn") == turn)
            message = F.when(now, F.concat(F.lit(OVERRIDES[0]), F.col("b.new"), F.lit(OVERRIDES[1]))).otherwise(r["message"])
            told = F.when(now, F.array("b.new")).otherwise(F.coalesce(r["told"], empty))
            over, back = s["over"] | now, F.when(now, s["back"]).otherwise(r["handed_back"])
            return F.struct(F.array_union(s["disclosed"], told).alias("disclosed"), back.alias("back"), over.alias("over"), F.array_append(s["log"], line(turn, message, told, over)).alias("log"))

        return _bound(customer_reply(F.col("kind"), F.col("all"), s["disclosed"], F.lit(ask).cast("string"), s["back"]), after)

    for turn, ask in enumerate(asks[: vocab.MAX_TURNS - 1], 2):
        first = _bound(first, _with(turned, turn, ask))
    return rows.select("session", F.inline(first["log"]))


def running_slate(shown: DataFrame) -> DataFrame:
    """(session, turn, new, seen): how many ids a turn shows first, and how many were seen until then; repeats count once.

    ``shown`` has (session, turn, id).  Only first sightings are counted, so no set is carried along.
    """
    first = shown.groupBy("session", "id").agg(F.min("turn").alias("turn"))
    n = first.groupBy("session", "turn").agg(F.count(F.lit(1)).alias("new"))
    turns = shown.select("session", "turn").distinct().join(n, ["session", "turn"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return turns.withColumn("seen", F.sum("new").over(Window.partitionBy("session").orderBy("turn")))

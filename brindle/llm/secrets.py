"""Incremental secret scanning over a ledger of blobs, in DataFrame operations only.

A blob is the content of any version of any path, addressed by its SHA-256.  The ledger says which
(blob, rule version) pairs have been scanned, and holds their findings.  A run hashes the versions,
keeps one text for each blob whose pair with some rule is not in the ledger, scans only those, adds
their pairs and findings to the ledger, and joins findings back to every path that ever held the blob.

Matches are the leftmost non-overlapping ones.  A native expression gives their places: splitting a
text at a pattern and extracting the pattern's matches yields alternating gaps and matches, whose
running lengths are the starts and ends (in code points).

Cases: a null text is an empty one; empty texts have no finding but are in the ledger; a hot blob is
scanned once and its (small) findings meet its many paths in a salted join; repeated rows and ties repeat their findings; an empty table gives empty results; columns
other than the path, version and text columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import text_or_empty


class Rule(NamedTuple):
    """``pattern`` finds places, ``value`` (a group, 0 the whole match) must have ``least`` code points; ``near`` is a cheap needle."""

    kind: str
    version: int
    pattern: str
    value: int
    least: int
    near: str


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i)(?:pass(?:word|wd)|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}"),
    # runs shorter than 32 would be dropped, and a longest run is the same with or without the bound
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
)
#: Further kinds of this operator.
MORE_RULES = (
    # from BEGIN through the END line, or to the end of the text if there is none
    Rule("private_key", 2, r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\z)", 0, 1, "-----BEGIN [A-Z0-9 ]*PRIVATE KEY"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("hosted_token", 1, r"(?:gh[oprsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,})", 0, 1, r"gh[oprsu]_|xox[abp]-"),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 1, r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES
#: Keys over which the paths and the copies of a blob are dealt, and code points of a text that are cut at once.
SALTS, TEXT_SALTS, CHUNK = 32, 8, 4096

PAIRS = "blob binary, kind string, version int"
FINDINGS = "blob binary, kind string, version int, start long, end long"


def blob_address(text):
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _all_kinds(rules: tuple[Rule, ...]):
    return F.array(*(F.lit(r.kind) for r in rules))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings in (blob, text, todo) rows, by those of ``rules`` whose kind is in ``todo``."""
    hits = (F.when(F.array_contains("todo", r.kind) & F.col("text").rlike(r.near), F.lit(r.kind)) for r in rules)
    likely = blobs.withColumn("kinds", F.array_compact(F.array(*hits))).where(F.size("kinds") > 0)

    def lengths(r: Rule):
        """Gap, match and value lengths in turn; the text itself is not copied to every match."""
        found = [F.regexp_extract_all("text", F.lit(r.pattern), F.lit(g)) for g in (0, r.value)]
        parts = [F.split("text", r.pattern), *found]
        return F.arrays_zip(*(F.transform(x, F.length).alias(n) for x, n in zip(parts, ("gap", "own", "val"))))

    per_rule = F.array(
        *(
            F.struct(
                F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                F.when(F.array_contains("kinds", r.kind), lengths(r)).alias("m"),
            )
            for r in rules
        )
    )
    each = likely.select("blob", F.explode(per_rule).alias("r")).select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.m").alias("k", "m"))
    run = Window.partitionBy("blob", "kind").orderBy("k")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.own")).over(run)
    return (
        each.where(F.col("m.own").isNotNull())
        .withColumn("end", end)
        .where(F.col("m.val") >= F.col("least"))
        .select("blob", "kind", "version", (F.col("end") - F.col("m.own")).alias("start"), "end")
    )


def paths_of(versions: DataFrame, path_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(path columns, blob): which content every version of a path has."""
    return versions.select(*path_cols, blob_address(text_or_empty(text_col)).alias("blob"))


def _current(rules: tuple[Rule, ...]):
    """Whether a row of the ledger is of one of these rule versions."""
    out = F.lit(False)
    for r in rules:
        out = out | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return out


def unseen(versions: DataFrame, text_col: str = "text", pairs: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo), once for each blob that some rule version has not scanned.

    With a ledger, what is left to do is found on addresses alone; only then are texts fetched, and
    if few blobs are new, adaptive execution sends their addresses out instead of moving texts.  The
    copies of a blob meet its address under TEXT_SALTS keys.
    """
    text = text_or_empty(text_col)
    contents = versions.select(blob_address(text).alias("blob"), text.alias("text"))
    todo = _all_kinds(rules)
    if pairs is None:
        return contents.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", todo)
    done = pairs.where(_current(rules)).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    left = contents.select("blob").distinct().join(done, "blob", "left")
    left = left.select("blob", F.when(F.col("done").isNull(), todo).otherwise(F.array_except(todo, "done")).alias("todo")).where(F.size("todo") > 0)
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TEXT_SALTS - 1))))
    contents = contents.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(TEXT_SALTS)).cast("int"))
    return contents.join(left, ["blob", "salt"]).groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def update(versions: DataFrame, text_col: str = "text", pairs: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """What a run over ``versions`` adds to a ledger that has ``pairs``: new (pairs, findings), both lazy."""
    blobs = unseen(versions, text_col, pairs, rules)
    versions_of = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    new_pairs = blobs.select("blob", F.explode("todo").alias("kind")).withColumn("version", versions_of[F.col("kind")])
    return new_pairs, scan(blobs, rules)


class Ledger:
    """A ledger kept as two Parquet tables under ``path``; a run appends to both.

    Findings are written before the pairs that say they are complete.  A run that dies in between
    leaves findings that the next run writes again, so they are read without repeats.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    @property
    def pairs(self) -> DataFrame:
        """(blob, kind, version): what has been scanned."""
        return self._table("pairs", PAIRS)

    @property
    def findings(self) -> DataFrame:
        """(blob, kind, version, start, end)."""
        return self._table("findings", FINDINGS).distinct()

    def run(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what the ledger has not seen of these versions, and add it."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pairs")
        known = self.pairs if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder) else None
        pairs, findings = update(versions, text_col, known, rules)
        findings.write.mode("append").parquet(f"{self.path}/findings")
        pairs.write.mode("append").parquet(f"{self.path}/pairs")


def findings_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): the spans of every blob that has any, by start and then kind as listed."""
    rank = F.lit(len(rules))
    for i, r in enumerate(rules):
        rank = F.when(F.col("kind") == r.kind, F.lit(i)).otherwise(rank)
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    return findings.where(_current(rules)).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("found"))


def path_findings(versions: DataFrame, path_cols: tuple[str, ...], findings: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path columns, blob, found): every version of every path with the spans of its blob (empty if none).

    The paths of one blob may be many, so they are dealt over SALTS keys; only blobs with findings
    have rows on the other side, which are repeated for each.
    """
    spans = findings_by_blob(findings, rules)
    none = F.array().cast(spans.schema["found"].dataType)
    each = spans.select(F.col("blob").alias("__of"), "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    own = versions.select(F.struct(*path_cols).alias("path"), blob_address(text_or_empty(text_col)).alias("blob"))
    own = own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = own.join(each, (F.col("blob") == F.col("__of")) & (F.col("salt") == F.col("__salt")), "left")
    return joined.select(*(F.col("path")[c].alias(c) for c in path_cols), "blob", F.coalesce("found", none).alias("found"))


def _between(chunks, a, b):
    """The code points [a, b) of a text that is cut into ``chunks`` of CHUNK each."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    at = (a - i * CHUNK + 1).cast("int")
    same = F.substring(F.get(chunks, i), at, (b - a).cast("int"))
    inner = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    apart = F.concat(F.substring(F.get(chunks, i), at, F.lit(CHUNK)), inner, F.substring(F.get(chunks, j), F.lit(1), (b - j * CHUNK).cast("int")))
    return F.when(b <= a, F.lit("")).when(i == j, same).otherwise(apart)


def redacted(versions: DataFrame, text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with every finding's code points in the text column replaced by ``mark``; nulls stay.

    Texts are shuffled once, as blobs: those with findings are rewritten where they are (from chunks,
    so that the work grows with the text and not with its square), and each path's other columns,
    carried as one, fetch the text of their blob.
    """
    blobs = unseen(versions, text_col, None, rules)
    spans = findings_by_blob(scan(blobs, rules), rules)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:long,b:long>>").alias("gaps"))

    def step(acc, x):
        gap = F.array(F.struct(acc["at"].alias("a"), x["start"].alias("b")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["gaps"]).otherwise(F.concat(acc["gaps"], gap)).alias("gaps"))

    def finish(acc):
        return F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("a"), F.length("text").cast("long").alias("b"))))

    both = blobs.join(spans, "blob", "left").select("blob", "text", "found")
    both = both.withColumn("gaps", F.when(F.col("found").isNotNull(), F.aggregate("found", begin, step, finish)))
    both = both.withColumn("chunks", F.when(F.col("found").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    cleaned = F.array_join(F.transform("gaps", lambda g: _between(F.col("chunks"), g["a"], g["b"])), mark)
    clean = both.select(F.col("blob").alias("of"), F.coalesce(cleaned, "text").alias("clean"))
    names = versions.columns
    others = [F.col(c) for c in names if c != text_col] or [F.lit(0).alias("none")]
    keyed = versions.select(F.struct(*others).alias("row"), F.col(text_col).isNull().alias("empty"), blob_address(text_or_empty(text_col)).alias("blob"))
    found = keyed.join(clean, F.col("blob") == F.col("of"))
    return found.select(*(F.when(~F.col("empty"), F.col("clean")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names))

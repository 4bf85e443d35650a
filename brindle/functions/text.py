"""Text operators as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

#: Word edges that mean the same in every engine: letters, digits and the underscore of any script.
NOT_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_AFTER = r"(?![\p{L}\p{N}_])"


def literals(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def terms(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs of two or more characters that are no stop words; order and repeats kept."""
    return F.filter(phrase_tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(literals(vocab.STOPWORDS), t))


def phrase_tokens(text: Column) -> Column:
    """All lower-case ASCII alphanumeric runs."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Text without accents."""
    marked, bare = _accents()
    return F.translate(text, marked, bare)


def index_tokens(text: Column) -> Column:
    """Tokens of the index: runs of letters and digits of any script, lower case, without accents."""
    return F.regexp_extract_all(fold(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalized_query(text: Column) -> Column:
    """Spelling variants replaced as whole words, in the case they are written in."""
    out = F.coalesce(text, F.lit(""))
    for word, new in vocab.SPELLINGS.items():
        for pattern, form in ((word.upper(), new.upper()), (f"{word[0].upper()}(?i:{word[1:]})", new.capitalize()), (f"{word[0]}(?i:{word[1:]})", new)):
            out = F.regexp_replace(out, NOT_BEFORE + pattern + NOT_AFTER, form)
    return out


def retracted(text: Column, value: Column) -> Column:
    """Text without whole-word mentions of a value, blanks collapsed."""
    gone = F.regexp_replace(text, F.concat(F.lit("(?i)" + NOT_BEFORE + r"\Q"), value, F.lit(r"\E" + NOT_AFTER)), F.lit(""))
    return F.trim(F.regexp_replace(gone, r"\s+", " "))


def built_query(first: Column, recent: Column, limit: int = 2000) -> Column:
    """The first message and, of the last ``limit`` characters of the recent ones, as many from their beginning as there is room for."""
    tail = F.right(F.array_join(recent, " "), F.lit(limit))
    kept = F.left(tail, F.greatest(F.lit(limit) - F.length(first) - 1, F.lit(0)))
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(kept, F.lit("")))


def flat(col: Column, kind: T.DataType) -> Column:
    """A field of any shape as text: null is empty, maps are "key value" pairs, lists are joined."""
    if isinstance(kind, T.MapType):
        text = F.array_join(F.transform(F.map_entries(col), lambda e: F.concat_ws(" ", e["key"].cast("string"), e["value"].cast("string"))), " ")
    elif isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(col, lambda x: x.cast("string")), " ")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def flat_values(col: Column, kind: T.DataType) -> Column:
    """A field as a list of values: "key: value" for maps; nulls and empty strings are left out."""
    if isinstance(kind, T.MapType):
        return F.transform(F.filter(F.map_entries(col), lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    if isinstance(kind, T.ArrayType):
        return F.filter(F.transform(col, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != ""))
    return F.filter(F.array(col.cast("string")), lambda x: x.isNotNull() & (x != ""))


def searchable(fields: list[tuple[Column, T.DataType]]) -> Column:
    return F.trim(F.concat_ws(" ", *(F.when(c.isNotNull(), flat(c, k)) for c, k in fields)))


def passage(fields: list[tuple[Column, T.DataType]], limit: int = 700) -> Column:
    """What is embedded of a product: its non-empty fields joined by bars, cut to ``limit`` characters."""
    return F.left(F.concat_ws(" | ", *(F.nullif(flat(c, k), F.lit("")) for c, k in fields)), F.lit(limit))


def coarse_category(values: Column, default: Column) -> Column:
    """The last two parts of a category path, generic labels left out."""
    parts = F.transform(F.flatten(F.transform(values, lambda v: F.split(v, ","))), lambda p: F.trim(p))
    generic = literals(vocab.GENERIC_CATEGORIES)
    kept = F.filter(parts, lambda p: (p != "") & ~F.array_contains(generic, F.lower(p)))
    last = F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(kept) > 0, F.array_join(last, " ")).otherwise(default)


def without_root(categories: Column, root: Column) -> Column:
    """A category list without the universal root label in front."""
    return F.when(F.get(categories, F.lit(0)) == root, F.slice(categories, F.lit(2), F.greatest(F.size(categories), F.lit(1)))).otherwise(categories)


def grams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by blanks."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "))


def query_grams(tokens: Column, sizes: tuple[int, ...] = vocab.GRAM_SIZES, budget: int = vocab.MAX_GRAMS) -> Column:
    """Grams of all sizes, longest first, repeats and all-stopword grams left out, cut to the budget of look-ups."""
    stop = literals(vocab.STOPWORDS)
    at = lambda n: F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    every = [F.transform(at(n), lambda i: F.slice(tokens, i + 1, F.lit(n))) for n in sizes]
    useful = F.filter(F.concat(*every), lambda g: F.exists(g, lambda t: ~F.array_contains(stop, t)))
    return F.slice(F.array_distinct(F.transform(useful, lambda g: F.array_join(g, " "))), F.lit(1), F.lit(budget))

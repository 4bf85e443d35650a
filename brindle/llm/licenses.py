"""License scans by exact set-similarity join of text blocks with templates.

For templates of up to n words a text is cut into overlapping blocks of 2 * n words that start every
n words, so that any of them that stands in the text lies whole in one block; n is STEP, 2 * STEP and
so on, whatever length the templates have.  A block holds a template when it has at least
``threshold`` of the template's distinct words.

The join is the usual filter cascade over sets whose tokens follow one global order, rarest first,
counted over the whole corpus.  With T a template, B a block and a = ceil(threshold * |T|):

* prefix: B can reach a common tokens only if the first |B| - a + 1 tokens of B meet the first
  |T| - a + 1 tokens of T;
* length: |B| >= a;
* position: where they first meet at places i of T and j of B, the overlap is at most
  1 + min(|T| - i - 1, |B| - j - 1).

What passes is counted exactly, so every block over the threshold is found.  Only words of some
template can count towards an overlap, so blocks keep just those; templates are a fixed list, hence
the order has a few hundred entries at any input size and is the only thing sent to the tasks.
A phrase is a template that needs all its words, and then its places are checked word by word.

Cases: a null or empty text has no word and no label; texts of any length are read whole, block by
block; repeated rows, ties and hot keys need no care as rows are independent after the count; an
empty corpus gives an empty order and result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, slices, span_hash, word_bounds
from .shared import text_or_empty

STEP = 64
THRESHOLD = 0.8


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    exact: bool = False


# The base phrases.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Opening sentences and bodies of common public licenses and notices, as words.
NOTICES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
        "from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special "
        "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
        "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised "
        "of the possibility of such damage",
    ),
)
TEMPLATES = tuple(Template(label, tuple(text.split()), True) for label, text in PHRASES) + tuple(Template(label, tuple(text.split())) for label, text in NOTICES)


def word_ids(words: list[str]) -> np.ndarray:
    """Ids of given words, as the kernels compute them from a text."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    return span_hash(buf, ends - [len(w) for w in raw], ends)


def _vocabulary(templates: tuple[Template, ...]) -> tuple[list[str], np.ndarray]:
    """Template words and their ids, by ascending id."""
    words = sorted({w for t in templates for w in t.words})
    ids = word_ids(words)
    order = np.argsort(ids)
    return [words[i] for i in order], ids[order]


def _known(buf: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and vocabulary indices of the template words of a slice, and where each row's words begin."""
    low = LOWER[buf]
    starts, ends, first = word_bounds(low, off, ALNUM)
    h = span_hash(low, starts, ends)
    at = np.minimum(np.searchsorted(ids, h), len(ids) - 1)
    hit = np.flatnonzero(ids[at] == h) if len(h) else np.zeros(0, np.int64)
    return hit, at[hit], first


def word_counts(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """How often each template word stands in the whole corpus: at most one number a word."""
    words, ids = _vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0)):
                total += np.bincount(_known(buf, off, ids)[1], minlength=len(ids))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in seen], pa.string()), pa.array(total[seen])], names=["word", "n"])

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def step_of(template: Template) -> int:
    """The words by which blocks for a template advance: the next multiple of STEP."""
    return STEP * max(1, -(-len(template.words) // STEP))


class Index:
    """Templates of one step as token lists in the global order, with their prefixes inverted."""

    def __init__(self, templates: tuple[Template, ...], rank: dict[str, int], threshold: float):
        self.templates = templates
        self.step = step_of(templates[0])
        self.sets = [sorted({rank[w] for w in t.words}) for t in templates]
        self.need = [len(s) if t.exact else max(1, math.ceil(round(threshold * len(s), 9))) for t, s in zip(templates, self.sets)]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (s, a) in enumerate(zip(self.sets, self.need)):
            for i, token in enumerate(s[: len(s) - a + 1]):
                self.prefix.setdefault(token, []).append((k, i))
        self.prefix_tokens = np.array(sorted(self.prefix))
        self.phrases = {k: [rank[w] for w in t.words] for k, t in enumerate(templates) if t.exact}

    def matches(self, block: list[int]) -> list[tuple[int, int]]:
        """(template, overlap) of all templates that a block (its distinct tokens in order) holds."""
        seen, out = set(), []
        have = set(block)
        for j, token in enumerate(block):
            for k, i in self.prefix.get(token, ()):
                s, a = self.sets[k], self.need[k]
                if k in seen or len(block) < a or j > len(block) - a:
                    continue
                seen.add(k)
                if 1 + min(len(s) - i - 1, len(block) - j - 1) < a:
                    continue
                n = sum(x in have for x in s)
                if n >= a:
                    out.append((k, n))
        return out


SPANS = "n_words long, spans array<struct<label:string,phrase:boolean,start:long,end:long,containment:double>>"


def _row_spans(index: Index, places: np.ndarray, tokens: np.ndarray) -> list[tuple]:
    """Spans of one row from the places and ranks of its template words."""
    step = index.step
    first = places[np.isin(tokens, index.prefix_tokens)] // step
    out = []
    for b in np.unique(np.concatenate([first, first[first > 0] - 1])).tolist():
        x, y = np.searchsorted(places, [b * step, (b + 2) * step])
        at, inside = places[x:y], tokens[x:y]
        for k, n in index.matches(np.unique(inside).tolist()):
            t = index.templates[k]
            if t.exact:
                row = dict(zip(at.tolist(), inside.tolist()))
                for p in at[at < (b + 1) * step].tolist():
                    if all(row.get(p + q) == token for q, token in enumerate(index.phrases[k])):
                        out.append((t.label, True, p, p + len(t.words), 1.0))
            else:
                used = at[np.isin(inside, index.sets[k])]
                out.append((t.label, False, int(used[0]), int(used[-1]) + 1, n / len(index.sets[k])))
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, spans): every place of a phrase, and every block's match with a template."""
    counts = word_counts(docs, text_col, templates)
    words, ids = _vocabulary(templates)
    order = {w: i for i, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}
    rank = np.array([order[w] for w in words])
    indexes = [Index(tuple(t for t in templates if step_of(t) == s), order, threshold) for s in sorted(set(map(step_of, templates)))]
    starts = np.isin(rank, np.concatenate([x.prefix_tokens for x in indexes]))
    kept = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("__text"))
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {SPANS}"
    names = ("label", "phrase", "start", "end", "containment")
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                hit, at, first = _known(buf, off, ids)
                tokens = rank[at]
                edge = np.searchsorted(hit, first)
                likely = np.zeros(b - a, bool)
                likely[np.searchsorted(first, hit[starts[at]], "right") - 1] = True
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                for i in np.flatnonzero(likely).tolist():
                    places, own = hit[edge[i] : edge[i + 1]] - first[i], tokens[edge[i] : edge[i + 1]]
                    spans[i] = [dict(zip(names, s)) for s in sorted(s for x in indexes for s in _row_spans(x, places, own))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(spans, kind)], names=[id_col, "n_words", "spans"])

    return kept.mapInArrow(run, schema)

"""License scans: phrases, and template-markup matching.

A template is wording with `[[optional]]` and `{{least-most}}` (replaceable words) regions. It is
compiled into a token automaton whose states are sets of positions; a text is accepted at a place if
all mandatory words stand there exactly, in order. Places to try come from the codes of the words
that the template can begin with, found for a whole slice of documents at once.
"""

from __future__ import annotations

import re
import string
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM, Words, documents, slices, texts_of

#: (phrase, label), given by the query's contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: (label, template). Fixed wording of public license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("gpl-3", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3"),
    ("gpl-2", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2"),
    ("lgpl-3", "licensed under the [[terms of the]] gnu lesser general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v {{0-1}} 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under [[a]] cc by nc [[4 0]]"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial {{0-2}} international license"),
    ("cc-by-sa", "licensed under [[a]] cc by sa [[4 0]]"),
    ("cc0", "to the extent possible under law {{1-6}} has waived all copyright"),
    ("copyright", "copyright c {{1-6}} all rights reserved"),
)
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[a-z0-9]+")


class Automaton:
    """Positions 0 to n; words[i] is what must stand between i and i+1, None for any word.
    skip[i]: positions reached from i without a word."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        skip: list[tuple[int, int]] = []
        opened: list[int] = []
        for m in _MARK.finditer(template):
            if m[0] == "[[":
                opened.append(len(self.words))
            elif m[0] == "]]":
                skip.append((opened.pop(), len(self.words)))
            elif m[1]:
                least, most = int(m[1]), int(m[2])
                end = len(self.words) + most
                skip += [(len(self.words) + i, end) for i in range(least, most)]
                self.words += [None] * most
            else:
                self.words.append(m[0].encode())
        self.size = len(self.words)
        self.skip = [[b for a, b in skip if a == i] for i in range(self.size + 1)]
        self.anchors = self._anchors()

    def _reach(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for b in self.skip[todo.pop()]:
                if b not in states:
                    states.add(b)
                    todo.append(b)
        return states

    def _anchors(self) -> set[tuple[int, tuple[bytes, ...]]]:
        """(offset, words): an accepted text has one of these wordings (one or two words) `offset` words
        after its begin. A template that needs no certain word is refused, since it fits everywhere."""
        found, states, offset = set(), self._reach({0}), 0
        while states:
            if self.size in states:
                raise ValueError("a template needs a mandatory word")
            for i in states:
                if self.words[i] is not None:
                    plain = self._reach({i + 1}) == {i + 1} and i + 1 < self.size and self.words[i + 1] is not None
                    found.add((offset, (self.words[i], self.words[i + 1]) if plain else (self.words[i],)))
            states = self._reach({i + 1 for i in states if self.words[i] is None})
            offset += 1
        return found

    def accepts(self, words: list[bytes]) -> bool:
        """Whether some front part of words is accepted."""
        states = self._reach({0})
        for w in words:
            if self.size in states:
                return True
            states = self._reach({i + 1 for i in states if i < self.size and self.words[i] in (None, w)})
            if not states:
                return False
        return self.size in states


@cache
def _keys(words: tuple[bytes, ...]) -> np.ndarray:
    return Words([b" ".join(words)], ALNUM).hashes()[0]


def _places(h: np.ndarray, doc: np.ndarray, words: tuple[bytes, ...]) -> np.ndarray:
    """Numbers of the words at which `words` may stand consecutively in one document, by their keys."""
    at, k = np.flatnonzero(h == _keys(words)[0]), len(words)
    at = at[at + k <= len(h)]
    for j, x in enumerate(_keys(words)[1:], 1):
        at = at[h[at + j] == x]
    return at[doc[at] == doc[at + k - 1]]


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. n_base
    counts all places of all phrases; first_word and last_word are null without one. score is 1
    where a template is accepted, 0.6 for phrases alone, else 0. Null and empty texts have no words
    and no labels; texts are read whole, however long. Repeated and null ids are kept as they are. Other
    columns aren't read, whatever their names; an empty table gives no rows.
    """
    texts_to_find = [(tuple(p.encode().split()), label) for p, label in phrases]
    compiled = [(Automaton(t), label) for label, t in templates]

    def one(words: Words, doc: np.ndarray, n: int) -> list[pa.Array]:
        h = words.hashes()[0]
        count, low, high = np.zeros(n, np.int64), np.full(n, len(h)), np.full(n, -1)
        base, more, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
        for phrase, label in texts_to_find:
            for i in _places(h, doc, phrase):
                if words.text(i, i + len(phrase)) == b" ".join(phrase):
                    d = doc[i]
                    own = i - words.first[d]
                    count[d] += 1
                    low[d], high[d] = min(low[d], own), max(high[d], own)
                    base[d].add(label)
                    score[d] = max(score[d], 0.6)
        for auto, label in compiled:
            begins = {i - off for off, ws in auto.anchors for i in _places(h, doc, ws).tolist() if i - off >= words.first[doc[i]]}
            for i in sorted(begins):
                end = min(i + auto.size, words.first[doc[i] + 1])
                if auto.accepts([words.buf[s:e].tobytes() for s, e in zip(words.starts[i:end], words.ends[i:end], strict=True)]):
                    more[doc[i]].add(label)
                    score[doc[i]] = 1.0
        none = count == 0
        return [
            pa.array(np.diff(words.first), pa.int64()), pa.array(count), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none),
            pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b | m)) for b, m in zip(base, more, strict=True)]), pa.array(score),
        ]

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi], ALNUM, lower=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *one(words, words.doc, hi - lo)], names=names)

    schema = f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [id_col, *(c.split()[0] for c in schema.split(", ")[1:])]
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


#: The templates as regular expressions over words that each have a space behind them, written by hand
#: so that the SQL shares nothing with the automata.
_SQL_TEMPLATES = (
    ("mit", "released under the mit license "),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software )?to deal in the software without restriction "),
    ("apache-2", "licensed under the apache license version 2 "),
    ("gpl-3", "licensed under the (terms of the )?gnu general public license (as published by the free software foundation either )?version 3 "),
    ("gpl-2", "licensed under the (terms of the )?gnu general public license (as published by the free software foundation either )?version 2 "),
    ("lgpl-3", "licensed under the (terms of the )?gnu lesser general public license version 3 "),
    ("mpl-2", "subject to the terms of the mozilla public license v ([^ ]+ )?2 0 "),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "),
    ("cc-by-nc", "licensed under (a )?cc by nc "),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial ([^ ]+ ){0,2}international license "),
    ("cc-by-sa", "licensed under (a )?cc by sa "),
    ("cc0", "to the extent possible under law ([^ ]+ ){1,6}has waived all copyright "),
    ("copyright", "copyright c ([^ ]+ ){1,6}all rights reserved "),
)


def _sql() -> str:
    def lists(found: dict[str, str]) -> str:
        return "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for label, c in found.items()) + "], lambda x: x IS NOT NULL))), ',')"

    base = {"mit": "len(p0) > 0", "apache-2": "len(p1) > 0", "cc-by-nc": "len(p2) > 0"}
    every = dict(base)
    hits = {f"t{k}": f"regexp_matches(line, ' {x}')" for k, (_, x) in enumerate(_SQL_TEMPLATES)}
    for k, (label, _) in enumerate(_SQL_TEMPLATES):
        every[label] = f"{every[label]} OR t{k}" if label in every else f"t{k}"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
f AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line,
  list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'under' AND ws[i + 2] = 'the' AND ws[i + 3] = 'mit' AND ws[i + 4] = 'license') AS p0,
  list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license' AND ws[i + 3] = 'version' AND ws[i + 4] = '2') AS p1,
  list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'cc' AND ws[i + 2] = 'by' AND ws[i + 3] = 'nc') AS p2 FROM w),
g AS (SELECT *, list_concat(p0, p1, p2) AS ps, {', '.join(f'{x} AS {k}' for k, x in hits.items())} FROM f)
SELECT doc_id, len(ws) AS n_words, len(ps) AS n_base, list_min(ps) AS first_word, list_max(ps) AS last_word, {lists(base)} AS base_labels, {lists(every)} AS labels,
       CASE WHEN {' OR '.join(hits)} THEN 1.0::DOUBLE WHEN len(ps) > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM g"""


OP9_SQL = _sql()

"""License scans by a positional index of rare words. DataFrame functions only.

A template is a row of words with mandatory key phrases at known places. The words of
all key phrases are counted over all documents; a template is indexed under the word
of its key phrases with the highest IDF, and has the next one as a second posting. A
file's occurrences of indexed words are looked up: each gives a place where the
template would start, which stays if the second word stands at its relative place and
then all key phrases do. All of it happens within a row, so nothing is shuffled but a
few word counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``keys``: (first word, words) of the mandatory phrases; a base template is all key."""

    label: str
    text: str
    keys: tuple[tuple[int, int], ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        return [(a, self.words[a : a + n]) for a, n in self.keys or ((0, len(self.words)),)]


#: Phrases and labels of the base, and headers of common licences.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("all-rights-reserved", "all rights reserved"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ((0, 8),)),
    Template("cc-by-sa", "cc by sa"),
    Template("gpl", "licensed under the gnu general public license version 3", ((3, 4),)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ((3, 4), (7, 2))),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ((0, 7), (10, 3))),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", ((6, 3), (9, 2))),
)


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, letters and non-ASCII characters; null: none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows of ``docs`` (text) each of the words stands: a count for each word at most."""
    met = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, words)))).alias("word"))
    found = {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: found.get(w, 0) for w in words}


def _index(templates: tuple[Template, ...], count: dict[str, int]) -> list[tuple[str, int, int, str, int]]:
    """(rarest word, its place, template, second word, its place)."""
    rows = []
    for k, t in enumerate(templates):
        places = [(count[w], w, a + i) for a, phrase in t.phrases for i, w in enumerate(phrase)]
        first = min(places)
        second = min([p for p in places if p[1] != first[1]], default=first)
        rows.append((first[1], first[2], k, second[1], second[2]))
    return rows


def _word(words: Column, at: Column) -> Column:
    return F.get(words, at)


def _verified(t: Template, word: str, place: int, _: int, second: str, second_place: int) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Of a place of the rarest word: whether the template stands there, and its description."""
    words = F.col("words")

    def stands(p: Column) -> Column:
        start = p - place
        own = (_word(words, p) == word) & (_word(words, start + second_place) == second)
        for a, phrase in t.phrases:
            for i, w in enumerate(phrase):
                own &= _word(words, start + (a + i)) == w
        return F.coalesce(own, F.lit(False))

    def described(p: Column) -> Column:
        start = p - place
        same = sum((F.coalesce(_word(words, start + i) == w, F.lit(False)).cast("int") for i, w in enumerate(t.words)), F.lit(0))
        return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), start.cast("bigint").alias("start"), (same / len(t.words)).alias("score"))

    return stands, described


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``n_words`` and ``found`` of every row of ``docs`` (doc_id, text).

    ``found`` is an array of structs, by template and place: label, base, start (the
    first word of the template, counted from 0; below 0 if the file begins within
    it), score (share of the template's words that stand in their places). Null and
    empty texts have no words; each row is scanned by itself, repeated ones too."""
    vocabulary = sorted({w for t in templates for _, phrase in t.phrases for w in phrase})
    index = _index(templates, frequencies(docs, vocabulary))
    rare = sorted({row[0] for row in index})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("words"))
    at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(rare), i)))
    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "words", at.alias("at"))
    # Only rows with rare words go on to the templates.
    matches = [F.transform(F.filter("at", stands), described) for stands, described in (_verified(t, *index[k]) for k, t in enumerate(templates))]
    kind = "array<struct<label:string,base:boolean,start:bigint,score:double>>"
    found = F.when(F.size("at") > 0, F.concat(*[m.cast(kind) for m in matches])).otherwise(F.array().cast(kind))
    return rows.select("doc_id", "n_words", found.alias("found"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def labelled(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The digest of ``scan``: counts and places of the base's phrases, labels and the best score (else 0)."""
    base = F.filter("found", lambda x: x["base"])
    rows = scan(docs, templates).withColumn("base", base)
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"),
        F.array_max(F.col("base.start")).alias("last_word"),
        _joined(F.col("base.label")).alias("base_labels"),
        _joined(F.col("found.label")).alias("labels"),
        F.coalesce(F.array_max(F.col("found.score")), F.lit(0.0)).alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``labelled`` over the view ``documents``."""
    values, keys = [], []
    for k, t in enumerate(templates):
        values.append(f"({k}, '{t.label}', {str(t.base).lower()}, {t.words!r}, {t.phrases[0][0]}, '{t.phrases[0][1][0]}')")
        keys += [f"({k}, {a}, {phrase!r})" for a, phrase in t.phrases]
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
t(k, label, base, tw, first_at, first_word) AS (VALUES {", ".join(values)}),
keys(k, a, phrase) AS (VALUES {", ".join(keys)}),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
c AS (SELECT p.doc_id, p.w, t.*, p.i - t.first_at AS s FROM p JOIN t ON p.w[p.i + 1] = t.first_word),
v AS (SELECT c.doc_id, c.k, c.label, c.base, c.s, any_value(c.w) AS w, any_value(c.tw) AS tw
      FROM c JOIN keys ON keys.k = c.k GROUP BY c.doc_id, c.k, c.label, c.base, c.s
      HAVING bool_and(c.s + keys.a >= 0 AND c.w[c.s + keys.a + 1 : c.s + keys.a + len(keys.phrase)] = keys.phrase)),
f AS (SELECT *, len(list_filter(range(len(tw)), lambda j: s + j >= 0 AND coalesce(w[s + j + 1] = tw[j + 1], false))) / len(tw)::DOUBLE AS share FROM v)
SELECT d.doc_id, any_value(len(d.w))::BIGINT AS n_words, count(*) FILTER (f.base) AS n_base,
  min(f.s) FILTER (f.base) AS first_word, max(f.s) FILTER (f.base) AS last_word,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels,
  coalesce(max(f.share), 0.0) AS score
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""

"""License scans through a positional index of rare tokens, in SQL expressions only.

Templates are word sequences, each with a key phrase that must be there. Their
rarest words, by inverse document frequency over the scanned files, are the
index: word -> (template, position). A file is looked up by the indexed words
that it holds; a template all of whose rare key words occur gets the places of
the rarest one, which are intersected with the others' by relative position, and
the key phrase is then verified word by word. The rare words of the rest of the
template tell which of these places are scored: those where most of them stand.

Defined results: null text counts as empty (no word, no place, empty labels,
score 0). Texts of any length are scanned whole, each row on its own; extra
columns are kept by ``scan_licenses``, whose results go to one struct column,
``license``, with as many ``_`` behind as make its name free. No rows give no
rows; ties of rarity go to the word that comes first in the template.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, free_name, table

#: What parts words, in a text whose A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Indexed words of a key phrase, and of the rest of its template.
RARE = 3


@dataclass(frozen=True)
class Template:
    label: str
    key: str  # the phrase that must be there
    text: str = ""  # the whole text, which the key is part of; the key if empty
    base: bool = False

    @property
    def words(self) -> list[str]:
        return (self.text or self.key).split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: The base phrases with their labels, then those that the method adds.
TEMPLATES = [
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("mit", "mit license", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-3.0", "general public license version 3", "licensed under the gnu general public license version 3"),
    Template("gpl-2.0", "general public license version 2", "licensed under the gnu general public license version 2"),
    Template("lgpl", "lesser general public license", "gnu lesser general public license"),
    Template("agpl", "affero general public license", "gnu affero general public license"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "mozilla public license", "mozilla public license version 2 0"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
]


def normal_words(text: Column) -> Column:
    """The words of a text, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, " ")), F.lit(" "))


def _held(normal: Column, words: list[str]) -> Column:
    """Which of ``words`` a normal text has; it is cut into words once."""
    return F.array_intersect(F.split(F.trim(normal), " "), F.array(*map(F.lit, words)))


def inverse_frequencies(docs: DataFrame, text: str, templates: list[Template]) -> dict[str, float]:
    """ln((1 + files) / (1 + files with the word)) for each template word, over all files."""
    words = sorted({w for t in templates for w in t.words})
    held = F.explode(F.concat(_held(normal_words(F.col(text)), words), F.array(F.lit(""))))  # each file has the empty word
    counts = {r.word: r.n for r in docs.select(held.alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) for w in words}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_word(words: Column, starts: Column, distance: int, word: str) -> Column:
    return F.filter(starts, lambda s: F.get(words, s + distance) == word)


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """``docs`` with a struct column ``license``: n_words, and found: base (starts), base_labels, places, labels, score; found is null where no indexed word is.

    The score is the largest part of a template's words that stand in place around a verified key phrase, 0 to 1.
    """
    idf = inverse_frequencies(docs, text, templates)
    by_rarity = lambda t, places: sorted(places, key=lambda i: (-idf[t.words[i]], i))[:RARE]
    in_key = lambda t: range(t.key_at, t.key_at + len(t.key_words))
    rare = {t: by_rarity(t, in_key(t)) for t in templates}
    beside = {t: by_rarity(t, [i for i in range(len(t.words)) if i not in in_key(t)]) for t in templates}
    indexed = sorted({t.words[i] for t in templates for i in rare[t]})

    def places(t: Template, words: Column, held: Column) -> Column:
        """Starts of the key phrase."""
        first, others, own = rare[t][0], rare[t][1:], t.key_words
        # Postings of the rarest word, as starts of the key phrase.
        at = F.filter(F.transform(words, lambda w, i: F.when(w == t.words[first], i - (first - t.key_at))), lambda s: s.isNotNull() & (s >= 0) & (s + len(own) <= F.size(words)))
        for i in others:
            at = _with_word(words, at, i - t.key_at, t.words[i])
        sure = F.filter(at, lambda s: F.array_join(F.slice(words, s + 1, len(own)), " ") == " ".join(own))
        asked = {t.words[i] for i in rare[t]}
        return F.when(F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(asked))))) == len(asked), sure).otherwise(F.array().cast("array<int>"))

    def coverage(t: Template, words: Column, starts: Column) -> Column:
        there = lambda s, j: F.when(s - t.key_at + j >= 0, F.get(words, s - t.key_at + j)) == F.lit(t.words[j])
        agree = lambda s: sum((F.coalesce(there(s, j).cast("int"), F.lit(0)) for j in beside[t]), F.lit(0))
        same = lambda s: F.filter(F.transform(F.array(*map(F.lit, t.words)), lambda w, j: F.when(s - t.key_at + j >= 0, F.get(words, s - t.key_at + j)) == w), lambda x: x)
        scored = lambda some: F.coalesce(F.array_max(F.transform(some, lambda s: F.size(same(s)) / len(t.words))), F.lit(0.0))
        if not beside[t]:
            return F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return _let(F.array_max(F.transform(starts, agree)), lambda most: scored(F.filter(starts, lambda s: agree(s) == most)))

    def matches(words: Column, held: Column) -> Column:
        one = lambda t: _let(places(t, words, held), lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("starts"), coverage(t, words, s).alias("part")))
        return F.filter(F.array(*map(one, templates)), lambda m: F.size(m["starts"]) > 0)

    def result(found: Column) -> Column:
        base = F.filter(found, lambda m: m["base"])
        names = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda m: m["label"]))), ",")
        return F.struct(
            F.flatten(F.transform(base, lambda m: m["starts"])).alias("base"), names(base).alias("base_labels"),
            F.transform(found, lambda m: F.struct(m["label"], m["starts"])).alias("places"), names(found).alias("labels"),
            F.coalesce(F.array_max(F.transform(found, lambda m: m["part"])), F.lit(0.0)).alias("score"),
        )

    # Most files hold no indexed word, and need no more work.
    def license_of(normal: Column) -> Column:
        words = F.split(F.trim(normal), " ")
        n_words = F.when(F.length(normal) > 2, F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) - 1).otherwise(0)
        found = _let(_held(normal, indexed), lambda held: F.when(F.size(held) > 0, _let(words, lambda w: _let(matches(w, held), result))))
        return F.struct(n_words.cast("long").alias("n_words"), found.alias("found"))

    return docs.withColumn(free_name("license", docs.columns), _let(normal_words(F.col(text)), license_of))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, some = F.coalesce("license.found.base", F.array().cast("array<int>")), "license.found"
    return found.select(
        "doc_id", "license.n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        *[F.coalesce(f"{some}.{c}", F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce(f"{some}.score", F.lit(0.0)).alias("score"),
    )


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES: dict[str, str] = {}

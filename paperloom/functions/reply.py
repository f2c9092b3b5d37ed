"""Replies of models: the JSON in them, and metrics over them, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import round3


def json_candidate(reply: Column) -> Column:
    """What may be JSON: the first fenced part, even if it is none; else from the first brace to the last one."""
    fenced = F.regexp_extract(reply, r"(?is)```(?:json)?\s*(.*?)```", 1)
    has_fence = F.rlike(reply, F.lit(r"(?is)```(?:json)?\s*.*?```"))
    return F.when(has_fence, F.trim(fenced)).otherwise(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))


def valid_json(text: Column) -> Column:
    """One JSON value and nothing after it (the parser alone would ignore that): as the only item of an array."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.try_variant_get(wrapped, "$[0]", "variant").isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull()


def parsed_ok(reply: Column) -> Column:
    return F.coalesce(valid_json(json_candidate(reply)), F.lit(False))


def words_of(text: Column) -> Column:
    """Distinct words of more than two letters or digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2))


def text_agreement(a: Column, b: Column) -> Column:
    """Jaccard of two texts' words, to three places; 1 if both have none, 0 if one has none."""
    x, y = words_of(a), words_of(b)
    both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(round3(both))


def keyword_recall(text: Column, keywords: Column) -> Column:
    """(recall, found, missing) of keywords in a text; recall is null without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(keywords, lambda k: F.contains(low, F.lower(k)))
    missing = F.filter(keywords, lambda k: ~F.contains(low, F.lower(k)))
    recall = F.when(F.size(keywords) > 0, round3(F.size(found) / F.size(keywords)))
    return F.struct(recall.alias("recall"), found.alias("found"), missing.alias("missing"))

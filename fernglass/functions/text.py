"""Text functions of code search, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the reference behaviour.
BODY_CLIP = 500
MIN_TERM = 3
#: Where a name falls into words: other characters, before a capital after a small letter or digit, before the last capital of a run that a small letter follows.
NAME_BOUNDARY = r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: Types that never need context in a signature.
BUILT_IN_TYPES = [
    "string", "number", "boolean", "void", "null", "undefined", "never", "any",
    "unknown", "object", "symbol", "bigint", "Function", "Object", "Promise",
    "Array", "Map", "Set", "WeakMap", "WeakSet", "Record", "Partial", "Required",
    "Readonly", "Pick", "Omit", "Exclude", "Extract", "NonNullable", "ReturnType",
    "InstanceType", "Parameters", "ConstructorParameters", "Error",
]


def query_terms(query: Column) -> Column:
    """Search terms of a query: runs of letters, digits and underscore of three or more characters, repeats kept."""
    return F.filter(F.regexp_extract_all(query, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= MIN_TERM)


def identifier_words(query: Column) -> Column:
    """Camel, acronym and punctuation parts of an identifier, lower case, three or more characters, first seen kept."""
    parts = F.transform(F.split(query, NAME_BOUNDARY), lambda t: F.lower(t))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= MIN_TERM))


def phrase_tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens in order; underscore and dollar separate too."""
    return F.filter(F.split(F.lower(text), r"[^\p{Alnum}]+"), lambda t: t != "")


def contains_phrase(tokens: Column, phrase: list[str]) -> Column:
    """Whether ``phrase`` is a contiguous run of ``tokens``."""
    if not phrase:
        return F.lit(False)
    m = len(phrase)
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - m, F.lit(0)))
    hit = F.exists(at, lambda i: F.slice(tokens, (i + 1).cast("int"), m) == F.array(*[F.lit(p) for p in phrase]))
    return (F.size(tokens) >= m) & hit


def trigrams(text: Column) -> Column:
    low = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i.cast("int"), 3))
    return F.when(F.length(low) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct trigrams; 0 if either has none."""
    x, y = trigrams(a), trigrams(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def is_code_like(term: Column) -> Column:
    """Whether a query term looks like a declared name: a capital, ``_``, ``$``, or a digit next to a letter."""
    return term.rlike(r"[A-Z_$]|[A-Za-z][0-9]|[0-9][A-Za-z]")


def name_keys(symbol: Column) -> Column:
    """Lookup keys of a symbol, so that name matching is an equi-join: (key, kind) of the full name and its last segment."""
    low = F.lower(symbol)
    full = F.struct(low.alias("key"), F.lit("full").alias("kind"))
    segment = F.struct(F.substring_index(low, ".", -1).alias("key"), F.lit("segment").alias("kind"))
    return F.when(low.contains("."), F.array(full, segment)).otherwise(F.array(full))


def first_doc_comment(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"(?s)/\*\*.*?\*/", 0), F.lit(""))


def clip(text: Column, limit: int = BODY_CLIP) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def pascal_types(signature: Column) -> Column:
    """PascalCase type names in a signature, without the built-in ones."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(signature, F.lit(r"\b[A-Z][A-Za-z0-9]*\b"), F.lit(0))), F.array(*[F.lit(t) for t in BUILT_IN_TYPES]))


def identifiers(content: Column) -> Column:
    """Identifier bag of a chunk: every identifier-shaped run, keywords and comments included, once each."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"\b[A-Za-z_$][A-Za-z0-9_$]*\b"), F.lit(0)))


def version_key(version: Column) -> Column:
    """Struct that sorts as semantic versions do, prereleases before their release."""
    core = F.split(F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1), r"\.")
    part = lambda i: F.coalesce(F.get(core, F.lit(i)).cast("int"), F.lit(0))
    pre = F.regexp_extract(version, r"^v?[\d.]+-([0-9A-Za-z.-]+)", 1)
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"), (pre == "").alias("release"), pre.alias("pre"))

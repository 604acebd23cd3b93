"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vocabulary import SEPARATORS, STOP_WORDS, UNIT_WORDS


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: What stands between two words.
GAP = "[" + "".join(re.escape(c) for c in SEPARATORS) + r"\s]+"


def raw_words(text: Column | str) -> Column:
    """The pieces of a lower-case text between separators and white space, empty ones at the ends too."""
    return F.split(F.lower(text), GAP)


def words(text: Column | str) -> Column:
    """Lower-case words of a text, ended by separators or white space."""
    return F.filter(raw_words(text), lambda w: w != "")


def among(word: Column, names: Iterable[str]) -> Column:
    """Whether word is one of many fixed names (without commas). One literal keeps plans small where isin would add a node for each name."""
    return F.find_in_set(word, F.lit(",".join(sorted(names)))) > 0


def valid_token(word: Column) -> Column:
    """Neither empty, a stop or unit word, all digits, nor a single character."""
    return F.coalesce((F.length(word) > 1) & ~word.rlike("^[0-9]+$") & ~among(word, STOP_WORDS | UNIT_WORDS), F.lit(False))


def tokens(text: Column | str) -> Column:
    return F.filter(words(text), valid_token)


def valid_row(word: str) -> Column:
    """valid_token for a column of single words: what is left out is held in a hash set."""
    word = F.col(word)
    return (F.length(word) > 1) & ~word.isin(*sorted(STOP_WORDS | UNIT_WORDS)) & ~word.rlike("^[0-9]+$")


def term_prefix(term: Column | str) -> Column:
    term = F.col(term) if isinstance(term, str) else term
    return F.when(term.contains(":"), F.substring_index(term, ":", 1)).otherwise("other")


def term_phrase(term: Column | str) -> Column:
    term = F.col(term) if isinstance(term, str) else term
    return F.when(term.contains(":"), F.regexp_replace(term, "^[^:]*:", "")).otherwise(term)


def numeric_string(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.rlike(r"^-?[0-9]+(\.[0-9]+)?$")


def normal_name(name: Column | str) -> Column:
    """Lower case, underscores and hyphens as single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[_\-\s]+", " "))


def clean_alias(alias: Column | str) -> Column:
    return F.regexp_replace(F.trim(alias), r"\s+", "_")


def goal_parts(goal: Column | str) -> Column:
    """struct<object, path, op, value> of 'object.path=value' or 'object.path!=value'; null if it is neither."""
    goal = F.col(goal) if isinstance(goal, str) else goal
    pattern = r"^\s*([^.=!\s]+)\.([^=!]+?)\s*(!=|=)\s*(.*?)\s*$"
    part = lambda k: F.regexp_extract(goal, pattern, k)
    return F.when(goal.rlike(pattern), F.struct(part(1).alias("object"), part(2).alias("path"), F.when(part(3) == "!=", "ne").otherwise("eq").alias("op"), part(4).alias("value")))


def value_with_unit(value: Column, unit: Column) -> Column:
    return F.concat(value, F.coalesce(unit, F.lit("")))


def without_fences(text: Column | str) -> Column:
    """The body of a fenced code block, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def phrase_parts(phrase: Column | str) -> Column:
    """The words of a multi-word phrase; terms with a prefix or an equals sign stay whole."""
    phrase = F.col(phrase) if isinstance(phrase, str) else phrase
    return F.when(phrase.contains(":") | phrase.contains("="), F.array(phrase)).otherwise(F.split(phrase, r"\s+"))

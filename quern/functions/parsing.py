"""Parsing of model replies: objects, arrays, flags, scores, final lines, decisions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.text import strip

# --- fixed values -------------------------------------------------------------
#: A number from 0 to below 2 that stands alone.
UNIT_NUMBER = r"(?<![\d.])([01](?:\.\d+)?|\.\d+)(?![\d.])"
# ------------------------------------------------------------------------------


def json_object(text: Column, schema: str) -> Column:
    """From the first { to the last }, parsed; null if there is none or it does not parse."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema))


def json_array(text: Column, schema: str) -> Column:
    """From the first [ to the last ], parsed."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", F.from_json(found, schema))


def trailing_array(text: Column, schema: str) -> Column:
    """From the last [ of the text to the last ]."""
    found = F.regexp_extract(text, r"(?s)\[[^\[]*\]", 0)
    found = F.coalesce(F.element_at(F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]"), F.lit(0)), -1), found)
    return F.when(found != "", F.from_json(found, schema))


def _balanced(text: str | None) -> str | None:
    """The first complete JSON object; strings and escapes are respected."""
    if text is None:
        return None
    start = text.find("{")
    if start < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None


@F.pandas_udf(StringType())
def balanced_json(s: pd.Series) -> pd.Series:
    """The first balanced {...} of each text as JSON, whatever follows it; else null."""
    return s.map(_balanced)


def tier_verdict(text: Column) -> Column:
    """A verdict {tier, score, evidence} in optional code fences; null without a tier."""
    bare = F.regexp_replace(strip(text), r"^`+(?:json)?\s*|\s*`+$", "")
    v = F.from_json(bare, "tier string, score double, evidence string")
    return F.when(v["tier"].isNotNull(), v)


def _object_in(text: Column) -> Column:
    """The text itself if it is one object from end to end, else the first balanced one in it."""
    bare = F.coalesce(strip(text).rlike(r"(?s)^\{[^{}]*(\{[^{}]*\}[^{}]*)*\}$"), F.lit(False))
    return F.when(bare, text).otherwise(balanced_json(F.when(~bare, text)))


def parse_flag(text: Column) -> Column:
    """The boolean of {"flag": bool}, with prose or fences about it; null for anything but a JSON boolean."""
    return F.from_json(_object_in(text), "flag boolean")["flag"]


def parse_flags(text: Column, n: Column) -> Column:
    """n booleans from {"flags": [{"i": 1.., "flag": bool}, ...]}, with prose or fences about it.

    Null unless there are exactly n entries, each flag is a true JSON boolean and the
    numbers i are 1 to n, each once.
    """
    flags = F.from_json(_object_in(text), "flags array<struct<i:int,flag:boolean>>")["flags"]
    numbers = F.sort_array(F.transform(flags, lambda e: e["i"]))
    whole = (F.size(flags) == n) & F.forall(flags, lambda e: e["flag"].isNotNull() & e["i"].isNotNull()) & (numbers == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    put = F.transform(F.array_sort(F.transform(flags, lambda e: F.struct(e["i"].alias("i"), e["flag"].alias("flag")))), lambda e: e["flag"])
    return F.when(F.coalesce(whole, F.lit(False)), put)


def unit_score(text: Column) -> Column:
    """The first number that stands alone and reads 0, 1, 0.x, 1.x or .x, if it is within 0 to 1."""
    found = F.regexp_extract(strip(text), UNIT_NUMBER, 1)
    v = F.when(found != "", found.cast("double"))
    return F.when((v >= 0) & (v <= 1), v)


def final_answer(text: Column, key: str) -> Column:
    """What follows the colon in the last line that begins with ``key`` and a colon."""
    lines = F.filter(F.split(strip(text), "\n"), lambda x: F.startswith(F.upper(strip(x)), F.lit(f"{key.upper()}:")))
    last = F.element_at(F.when(F.size(lines) > 0, lines), -1)
    return strip(F.substring(last, F.locate(":", last) + 1, F.lit(2**31 - 1)))


def first_token_choice(tokens: Column, text: Column) -> Column:
    """struct(choice, p_a) from array<struct<token, logprob>> of the first place.

    A wins ties; without either token the text's first letter decides and p_a is null.
    """
    p = lambda name: F.coalesce(F.array_max(F.transform(F.filter(tokens, lambda t: strip(t["token"]) == name), lambda t: F.exp(t["logprob"]))), F.lit(0.0))
    pa, pb = p("A"), p("B")
    first = F.upper(F.substring(strip(text), 1, 1))
    seen = (pa + pb) > 0
    return F.struct(F.when(seen, F.when(pa >= pb, "A").otherwise("B")).when(first.isin("A", "B"), first).alias("choice"), F.when(seen, pa / (pa + pb + 1e-6)).alias("p_a"))


def canonical_answer(text: Column, vocabulary: list[tuple[str, str]], refusal: str, *, none: str = "(no preference)", other: str = "other") -> Column:
    """The first entry (label, pattern) of an ordered vocabulary that the normalised text names.

    Patterns stand between non-word characters and may take a plural s; refusals come
    first; case does not count.  Texts are expected without punctuation (``answer_norm``).
    """
    out = F.when(text.rlike(f"(?iu){refusal}"), none)
    for label, pattern in vocabulary:
        out = out.when(text.rlike(rf"(?iU)(?<!\w)(?:{pattern})s?(?!\w)"), label)
    return out.otherwise(other)


def headline_kinds(persona: Column) -> Column:
    """Kinds that make the headline rate: all (null) for personas, positive for entities."""
    return F.when(persona, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("positive")))


def rebuilt_as_stored(rebuilt: Column, stored_chars: Column) -> Column:
    """Guard: a text built again from its parts has the stored length."""
    return F.coalesce(F.length(rebuilt) == stored_chars, F.lit(False))

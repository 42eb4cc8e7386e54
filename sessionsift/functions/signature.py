"""B5 tool_signature: ``tool`` or ``tool::`` + canonical JSON of the input.

Canonical = keys sorted recursively, null object entries removed (array nulls
kept), numbers and escapes printed the JavaScript way.  VARIANT sorts the keys
and prints one compact form of every value; what it prints otherwise than
JavaScript (nested nulls, exponents, long numbers, control characters) is
rewritten token by token, strings apart from what stands between them.  All of
it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionsift.functions.text import js_number, let, strict_json

#: A JSON string, or all that stands up to the next one.
_TOKENS = r'"(?:[^"\\]|\\.)*+"|[^"]++'
#: A number, or what stands between two.
_NUMBERS = r"-?[0-9][0-9.eE+-]*|[^0-9-]+"
#: Numbers that JavaScript may print otherwise: exponents, a fraction of zeros, more digits than a double has.
_ODD_NUMBER = r"[0-9][eE]|[0-9]\.0(?![0-9])|[0-9.]{16,}|0\.0{5}"
#: A literal beyond the range of doubles, which JavaScript reads as infinite and prints as null.
_HUGE = r"[0-9][eE]\+?[0-9]{3}|[0-9]{309}"


def _split(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _js_numbers(token: Column) -> Column:
    """The numbers of a token between two strings, as JavaScript prints them."""
    parts = F.transform(_split(token, _NUMBERS), lambda p: F.when(p.rlike(r"^-?[0-9].*$") & p.rlike(_ODD_NUMBER), js_number(p.try_cast("double"))).otherwise(p))
    return F.when(token.rlike(_ODD_NUMBER), F.array_join(parts, "")).otherwise(token)


def _js_escapes(token: Column) -> Column:
    """A string token with the hexadecimal digits of its control characters in lower case."""
    low = token
    for digit in "ABCDEF":
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(token.contains("\\u00"), low).otherwise(token)


def _with_neighbours(text: Column) -> Column:
    """The tokens of ``text``, each with the one after it (null for the last)."""
    tokens = _split(text, _TOKENS)
    return F.arrays_zip(tokens.alias("token"), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))).alias("after"))


def _without_null_entries(text: Column) -> Column:
    """Compact JSON without the null entries of its objects, at any depth."""
    def kept(x):
        token = x["token"]
        null_key = token.startswith('"') & F.coalesce(x["after"].rlike(r"^:null(?:[,}]|$)"), F.lit(False))
        return F.when(null_key, "").when(token.startswith('"'), token).otherwise(F.regexp_replace(token, r"^:null,?", ""))

    shorter = F.array_join(F.transform(_with_neighbours(text), kept), "")
    tidy = F.transform(_split(shorter, _TOKENS), lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, r",\}", "}")))
    return F.array_join(tidy, "")


#: Stands for a number beyond the range of doubles while a text is a VARIANT.
INFINITE = "\x01\x01"
_INFINITE = r'"\u0001\u0001"'


def finite_json(raw: Column) -> Column:
    """``strict_json`` with a mark for every number that JavaScript would read as infinite."""
    def marked(token):
        parts = F.transform(_split(token, _NUMBERS), lambda p: F.when(F.abs(p.try_cast("double")) == float("inf"), _INFINITE).otherwise(p))
        return F.when(token.startswith('"'), token).otherwise(F.array_join(parts, ""))

    return strict_json(F.when(raw.rlike(_HUGE), F.array_join(F.transform(_split(raw, _TOKENS), marked), "")).otherwise(raw))


def js_json(text: Column) -> Column:
    """The compact JSON of a ``finite_json`` value with numbers and escapes as JavaScript prints them."""
    def printed(token):
        return F.when(token == _INFINITE, "null").when(token.startswith('"'), _js_escapes(token)).otherwise(_js_numbers(token))

    odd = text.rlike(_ODD_NUMBER) | text.contains("\\u00")
    return F.when(odd, F.array_join(F.transform(_split(text, _TOKENS), printed), "")).otherwise(text)


def canonical_json(raw) -> Column:
    """Canonical JSON of a JSON text column (null for null and JSON null; other text that is not one JSON
    value stands as a JSON string, so that different inputs stay different)."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    as_string = _js_escapes(F.regexp_replace(F.to_json(F.array(raw)), r"^\[|\]$", ""))

    def printed(v):
        whole = let(F.to_json(v), lambda text: F.when(text.contains(":null"), _without_null_entries(text)).otherwise(text))
        return F.when(v.isNull(), as_string).when(~F.is_variant_null(v), let(whole, js_json))

    return F.when(raw.isNotNull(), let(finite_json(raw), printed))


def tool_signature(tool, input_json) -> Column:
    """``tool`` when the input is missing/null, else ``tool::<canonical json>``."""
    tool = F.col(tool) if isinstance(tool, str) else tool
    return F.coalesce(F.concat(tool, F.lit("::"), canonical_json(input_json)), tool)

"""Scalar column functions (all JVM-side built-ins, no Python UDFs).

I1 strip_ws, I2 size_summary, I3 js_round, I4 parse_numeric, I5 outcome_message,
B6 is_protected, B11 sanitize_session_key / sanitize_log_field, plus the
lexical tokeniser shared by ranking, dedupe and compression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionsift import constants as C

# Whitespace stripped by the text rules: ASCII whitespace incl. vertical tab,
# no-break space, BOM and every Unicode separator.  Written so that Java regex
# and RE2 (the SQL oracle) read it the same way.
WS_CLASS = r"[\t\n\x0B\f\r \x{00A0}\x{FEFF}\p{Z}]"
_LEAD_WS = "^" + WS_CLASS + "+"
_TRAIL_WS = WS_CLASS + "+$"
# Token rule: lower-case, every run outside letters/digits is a separator.
NON_WORD = r"[^\p{L}\p{N}]+"
# Whitespace separating compression tokens.
SPACE_RUN = r"[\t\n\x0B\f\r ]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stripped(text: Column, lead: str, trail: str) -> Column:
    """Both ends stripped.  The patterns only run over texts whose first or last character calls for it: looking
    for the end of a long text tries every white space in it."""
    ends = F.substring(text, 1, 1).rlike(lead) | F.substring(text, -1, 1).rlike(trail)
    return F.when(ends, F.regexp_replace(F.regexp_replace(text, lead, ""), trail, "")).otherwise(text)


def strip_ws(c) -> Column:
    """Strip all leading/trailing whitespace (SQL ``trim`` only strips spaces)."""
    return _stripped(col_(c), _LEAD_WS, _TRAIL_WS)


# The white space that Python's ``str.strip`` removes (other than ``strip_ws``: no BOM, but NEL and the
# information separators); both regex dialects read it.
PY_WS_CLASS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
               r"\x{202F}\x{205F}\x{3000}]")


def strip_text(c) -> Column:
    """Strip the white space of ``PY_WS_CLASS`` (B9 and the optimizer's query)."""
    return _stripped(col_(c), f"^{PY_WS_CLASS}+", f"{PY_WS_CLASS}+$")


def is_blank(c) -> Column:
    return col_(c).isNull() | (strip_ws(c) == "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_json(c) -> Column:
    """The VARIANT of a JSON text, null unless the whole text is one JSON value.

    ``try_parse_json`` alone accepts text after the first value.  Inside an array and inside an object the
    text must be exactly one element and one member, which nothing but a single value is in both.
    """
    raw = col_(c)
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    one = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    member = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return let(member, lambda m: F.when((F.size(F.try_variant_get(m, "$", "map<string,variant>")) == 1) & one, F.try_variant_get(m, "$.v", "variant")))


def tokens(c) -> Column:
    """Lexical tokens: lower-case, split on runs of non letters/digits, empties dropped."""
    spaced = F.trim(F.regexp_replace(F.lower(col_(c)), NON_WORD, " "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def js_round(c) -> Column:
    """Round half up toward +inf (``Math.round``); -12.5 -> -12."""
    return F.floor(col_(c) + F.lit(0.5))


_NUM_PREFIX = r"^[\t\n\x0B\f\r \x{00A0}\x{FEFF}\p{Z}]*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"


def parse_numeric(c, fallback) -> Column:
    """I4: numeric prefix of a string (``12.5abc`` -> 12.5); else / non-finite -> fallback."""
    raw = F.regexp_extract(col_(c).cast("string"), _NUM_PREFIX, 1)
    num = raw.try_cast("double")
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("double")
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf")))
    return F.when(finite, num).otherwise(fb)


def js_number(c) -> Column:
    """A finite double as JavaScript prints it: the shortest digits, plain from 1e-6 up to 1e21."""
    num = col_(c)
    size = F.abs(num)
    fewer, more = F.format_string("%.14e", size), F.format_string("%.15e", size)
    # the fewest digits that read back as the same number
    text = (F.when(fewer.cast("double") == size, fewer).when(more.cast("double") == size, more)
            .otherwise(F.format_string("%.16e", size)))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^([0-9.]+)", 1), r"\.", ""), "0+$", "")
    k, n = F.length(digits), F.regexp_extract(text, r"e([+-]?[0-9]+)$", 1).cast("int") + 1
    sign = F.when(n > 1, F.lit("+")).otherwise(F.lit(""))
    rest = F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(F.lit(""))
    out = (F.when(k == 0, F.lit("0"))
           .when((k <= n) & (n <= 21), F.rpad(digits, n, "0"))
           .when((n > 0) & (n <= 21), F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, k)))
           .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
           .otherwise(F.concat(F.substring(digits, 1, 1), rest, F.lit("e"), sign, (n - 1).cast("string"))))
    return F.concat(F.when(num < 0, F.lit("-")).otherwise(F.lit("")), out)


def is_protected(tool) -> Column:
    """Case-insensitive membership in the protected tool list."""
    return F.lower(col_(tool)).isin(*C.PROTECTED_TOOLS)


def sanitize_session_key(c) -> Column:
    """Session key for hand-off storage: ``[^\\w.-]`` -> ``_``, empty -> ``unknown``."""
    key = F.coalesce(F.nullif(col_(c), F.lit("")), F.lit("unknown"))
    return F.regexp_replace(key, r"[^A-Za-z0-9_.-]", "_")


def sanitize_log_field(c, empty: str | None = None) -> Column:
    """CSV-safe field: ``[",\\r\\n]`` -> ``_``; null -> ''; optionally empty -> ``empty``."""
    v = F.coalesce(col_(c).cast("string"), F.lit(""))
    if empty is not None:
        v = F.when(v == "", F.lit(empty)).otherwise(v)
    return F.regexp_replace(v, r'[",\r\n]', "_")


def size_summary(initial, final) -> Column:
    """``Initial size: I chars, final size: F chars, saved: S chars (P%)``; '' if a size is missing."""
    i, f = col_(initial).cast("bigint"), col_(final).cast("bigint")
    saved = i - f
    pct = F.when(i > 0, js_round(saved.cast("double") / i * 100)).otherwise(F.lit(0)).cast("bigint")
    text = F.format_string("Initial size: %d chars, final size: %d chars, saved: %d chars (%d%%)", i, f, saved, pct)
    return F.when(i.isNull() | f.isNull(), F.lit("")).otherwise(text)


def outcome_message(ok, status, reason, message, initial, final) -> Column:
    """The one-line outcome text, branches tested in order."""
    summary = size_summary(initial, final)
    st, rs, msg = col_(status), col_(reason), col_(message)
    nz = lambda c: F.nullif(c, F.lit(""))
    failed_detail = F.when(col_(initial).isNotNull(),
                           F.format_string(" (size=%d chars)", col_(initial).cast("bigint"))).otherwise(F.lit(""))
    missing = F.concat_ws(", ",
                          F.when(col_(initial).isNull(), F.lit("initial_size=undefined")),
                          F.when(col_(final).isNull(), F.lit("final_size=undefined")))
    missing = F.when(missing == "", F.lit("")).otherwise(F.concat(F.lit(" ("), missing, F.lit(")")))
    return (
        F.when(summary != "", F.concat(F.lit(C.MSG_PREFIX + "optimized context emitted. "), summary))
        .when(st == "no_optimization", F.concat(
            F.lit(C.MSG_PREFIX + "no optimization applied: "),
            F.coalesce(nz(rs), F.lit("the optimizer found no safer or smaller replacement for the current context."))))
        .when(st == "failed", F.concat(
            F.lit(C.MSG_PREFIX + "optimization skipped: "),
            F.coalesce(nz(rs), nz(msg), F.lit("the optimizer could not complete.")), failed_detail))
        .when(col_(ok) == F.lit(True), F.concat(
            F.lit(C.MSG_PREFIX + "optimization completed, but savings summary was unavailable because size "
                  "metadata was missing or non-numeric."), missing))
        .otherwise(F.lit(C.MSG_PREFIX + "optimization completed without a measurable savings summary."))
    )

r"""Secret scans with corpus-wide ownership: candidates by pattern, verdicts by who else has the same value.

1. Every whole text is searched for three base patterns (assign, access, hex; those that fail their length are
   dropped) and for the forms of ``ISSUED`` and long mixed runs (``MIXED``).  The value of each match (of an
   assignment: what is assigned) is a candidate; candidates of a text with the same place are one.
2. Candidates are grouped over the corpus by a 128-bit hash of their value: in how many repositories and with how
   many owners does it stand?  Values never leave the task that read them.
3. A value with at least ``copied_owners`` owners or ``copied_repositories`` repositories is a widely copied
   example.  One that is rarer belongs to its owner; it is live if it looks like a credential (``looks_live``:
   enough different characters, enough entropy, no placeholder).  Live values and examples are marked wherever
   they stand as spans of their own; other values stay base matches only.

Scale: texts are read once and not shuffled; candidates are narrow rows.  Owners and repositories of a value are
counted by partial distinct aggregates, so a value that a third of all documents hold is spread by (value, owner)
and (value, repository).  Verdicts are broadcast only while they are few (``common.join_checked``).

Defined cases: a null text is an empty one; rows with equal ids and texts get equal results; a null id or owner is
one of its own; matches of different kinds may overlap; an empty table gives an empty result.  Columns other than
the id, text, owner and repository aren't touched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.bytekit import slices
from sessionsift.llm.common import join_checked, staged

KINDS = ["assign", "access", "hex", "live", "example"]
BASE = 3

# The words of an assignment.
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]

# Public forms of issued credentials.
ISSUED = [
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"sk_live_[A-Za-z0-9]{16,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
]
#: Long runs that may be a credential without a name: letters of both cases and digits.
MIXED = r"[A-Za-z0-9_-]{24,}"

# Parts of values that only stand for one.
PLACEHOLDERS = ["changeme", "example", "sample", "dummy", "placeholder", "your", "insert", "xxxx", "password", "secret", "1234567", "abcdefg", "0000000"]

COPIED_OWNERS, COPIED_REPOSITORIES = 5, 50
LEAST_ENTROPY, LEAST_CHARACTERS = 2.5, 6


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(?:" + "|".join(_either_case(w) for w in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
# the look-behinds only keep each place of a long run from being tried again
_HEX, _MIXED = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+"), re.compile(rf"(?<![A-Za-z0-9_-]){MIXED}+")
_ISSUED = re.compile("|".join(f"(?:{p})" for p in ISSUED))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    low = value.lower()
    return len(set(value)) >= LEAST_CHARACTERS and entropy(value) >= LEAST_ENTROPY and not any(p in low for p in PLACEHOLDERS)


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and entropy(value) >= 3.5


def matches(text: str) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int], str]]:
    """(base matches (start, kind, end), candidate values by (start, end)) of a text, in code points."""
    base, values = [], {}
    low = text.lower()
    if any(w in low for w in NAMES):  # a word in other letters can't hide here: lower() only adds matches
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 8:
                base.append((m.start(), 0, m.end()))
                values[m.span(1)] = m[1]
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            base.append((m.start(), 1, m.end()))
            values[m.span()] = m[0]
    for m in _HEX.finditer(text):
        base.append((m.start(), 2, m.end()))
        values[m.span()] = m[0]
    for m in _ISSUED.finditer(text):
        values.setdefault(m.span(), m[0])
    for m in _MIXED.finditer(text):
        if _mixed(m[0]) and not any(a < m.end() and m.start() < b for a, b in values):
            values[m.span()] = m[0]
    return sorted(base), values


_BASE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_VALUES_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("live", pa.bool_())]))
_FOUND = ("doc_id long, id long, th long, owner string, repository string, base array<struct<start: int, kind: int, end: int>>, "
          "found array<struct<start: int, end: int, value: string, live: boolean>>")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in slices(batch):
            base, found = [], []
            for text in part.column(part.schema.get_field_index("text")).to_pylist():
                places, values = matches(text or "")
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in places])
                found.append([{"start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "live": looks_live(v)} for (a, b), v in sorted(values.items())])
            names = ["doc_id", "id", "th", "owner", "repository"]
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(base, _BASE_TYPE), pa.array(found, _VALUES_TYPE)], names=[*names, "base", "found"])


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, id, th, owner, repository, base, found) of each row; rows with equal ids and texts share (id, th)."""
    doc_id = F.col("doc_id").cast("long")
    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"), own(owner).alias("owner"), own(repository).alias("repository"), "text")
    return rows.mapInArrow(_scanned, _FOUND)


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(value, owners, repositories, verdict) of each candidate value: example, live or null."""
    rows = found.select("owner", "repository", F.explode("found").alias("f")).select("owner", "repository", "f.value", "f.live")
    counted = rows.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.max("live").alias("live"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    return counted.select("value", "owners", "repositories", F.when(copied, "example").when(F.col("live"), "live").alias("verdict"))


def find(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(doc_id, base, secrets) of each row of ``docs``; secrets: its values with a verdict and their ownership."""
    found = staged(candidates(docs, owner, repository), "secret-candidates")
    verdicts = staged(ownership(found, copied_owners, copied_repositories).where("verdict is not null"), "secret-owners")
    places = found.select("id", "th", F.explode("found").alias("f")).select("id", "th", "f.start", "f.end", "f.value")
    judged = join_checked(places, verdicts, "value", "inner")
    secret = F.struct("start", "end", "verdict", "value", "owners", "repositories")
    of_doc = staged(judged.groupBy("id", "th").agg(F.array_sort(F.collect_set(secret)).alias("secrets")), "secret-places")
    return join_checked(found.select("doc_id", "id", "th", "base"), of_doc, ["id", "th"], "left", limit=50_000).drop("id", "th")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base matches, all spans, numbers of live values and examples."""
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    spans = F.transform("secrets", lambda s: F.struct(s["start"].alias("start"), F.when(s["verdict"] == "live", 3).otherwise(4).alias("kind"), s["end"].alias("end")))
    spans = F.coalesce(spans, F.array().cast("array<struct<start: int, kind: int, end: int>>"))
    verdicts = [F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in (3, 4)]
    everything = F.array_sort(F.concat("base", spans))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(everything).alias("spans"), *verdicts)

r"""Personal data: pattern matches, and terms that give protected entities away (DataFrame functions only).

Base spans are the matches of four patterns (email, ip, card, phone) that pass their checks.  Each distinct
value of such a match is a protected entity e.  Over the whole corpus, with N documents,

    information of e        IC(e)    = log2(N / n(e))
    disclosure of e by t    PMI(t,e) = log2(N P(e|t) / n(e)),

where t is a term (a lower-cased run of letters and digits).  Documents that hold an entity and are near copies of
each other (half of the 16 least hashes of their 5-word shingles) count once: n(e) and n(t,e) count such groups, and
P(e|t) is the share of the documents with t, copies once, that hold e.  For P(e|t) its lower confidence bound
(Wilson, ``Z``) is taken, so few documents show little; and a pair counts only from ``support`` different texts on
and if it can't be chance: its log-likelihood ratio against independence must reach ``EVIDENCE * ln N``, more the
more words could have met by chance.

A term that discloses the share PMI / IC >= ``remove`` of an entity is taken out, one of ``generalise`` or more is
replaced by the most specific step of a ladder that itself discloses less than ``generalise``: its class
(``[NUMBER]``, ``[CODE]`` with letters and digits, ``[WORD]``), else ``[TERM]``, which any text may hold.  Both in
every document that has the term; the largest share over all entities counts.

Scale: matches and spans are narrow rows; only documents that hold an entity of enough support are read for
pairs.  Entities that stand in the same groups of documents are one for that (a page of many addresses gives its terms
once), terms that are too frequent to disclose anything are left out before pairs are made, and pairs are added up
before each shuffle.  n(t) counts the terms of all documents, added up in each task first.  Words find the disclosing terms
where they stand, texts aren't shuffled for it unless there are too many terms to broadcast.  No group is gathered but
the spans of one document.

Defined cases: a null text is an empty one; equal rows give equal results; a row with a null id is searched
like others; spans of different kinds may overlap (``sanitised`` then keeps the first, the longer one of two
that begin together); an empty table gives an empty result.  Columns other than the id and the text aren't
touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.functions.text import let
from sessionsift.llm.common import join_checked, staged

KINDS = ["email", "ip", "card", "phone", "term"]
SUPPORT = 2
GENERALISE, REMOVE = 0.6, 0.9
#: Two-sided 95 % in the confidence bound; evidence that a pair needs, as a multiple of ln N.
Z, EVIDENCE = 1.96, 3.0
#: Words of a shingle and least hashes that are kept of a document.
SHINGLE, SKETCH = 5, 16
CLASSES = ["NUMBER", "CODE", "WORD"]

# The possessive quantifiers match what greedy ones would: nothing that follows could take back a character.
# They keep Java from recursing, and the look-behinds from trying each place of a long run again.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_WORD, _GAP = r"\p{L}\p{N}", r"[^\p{L}\p{N}]+"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    n = F.length(_digits(v))
    if kind == "card":
        return (n >= 14) & (n <= 19) & _luhn(_digits(v))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"
_RUN = 64


def _found(text: Column, kind: str) -> Column:
    """Spans of one kind: (start, kind, end, value) in code points, those that pass the kind's check."""
    p = PATTERNS[kind]
    parts = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hit"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & _passes(kind, x["hit"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(_SPANS).alias("spans"))

    none = F.array().cast(_SPANS)
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    sign = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(_SIGNS[kind]))
    return F.when(sign, spans).otherwise(none)


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with equal ids and texts share (id, th)."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(doc_id, F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, id, th, spans): spans in the order of their start, then kind."""
    kinds = [_found(F.col("text"), k) for k in KINDS[:4]]
    return _identified(docs).select("doc_id", "id", "th", F.array_sort(F.concat(*kinds)).alias("spans"))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), value)


def _words(text: Column) -> Column:
    """Lower-cased words: split first, as some letters become two characters, one of them no letter."""
    return F.transform(F.filter(F.split(text, _GAP), lambda w: w != ""), F.lower)


def _class(term: Column) -> Column:
    return F.when(~term.rlike(r"\P{N}"), "NUMBER").when(term.rlike(r"\p{N}"), "CODE").otherwise("WORD")


#: What a text must hold to have a word of a class.
_CLASS_SIGNS = {"NUMBER": rf"(?<![{_WORD}])\p{{N}}++(?!\p{{L}})", "CODE": r"\p{L}\p{N}|\p{N}\p{L}", "WORD": rf"(?<![{_WORD}])\p{{L}}++(?!\p{{N}})"}


def _sketch(text: Column) -> Column:
    """The least hashes of a text's shingles; a shorter text is one shingle."""
    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))

    return F.slice(F.array_sort(F.array_distinct(let(_words(text), hashes))), 1, SKETCH)


def copy_groups(texts: DataFrame) -> DataFrame:
    """(th, copy): each distinct text of ``texts`` (th, text) with the least text that it is a near copy of.

    The least text with each hash stands for it; a text joins the least of those that stand for half of its own
    hashes.  Rows are as many as hashes, whatever the size of a group of copies."""
    distinct = texts.groupBy("th").agg(F.first("text").alias("text"))  # equal texts: any of them
    hashes = staged(distinct.select("th", _sketch(F.col("text")).alias("s")).select("th", F.size("s").alias("n"), F.explode("s").alias("h")), "pii-sketches")
    first = hashes.groupBy("h").agg(F.min("th").alias("copy"))
    shared = hashes.join(first, "h").groupBy("th", "copy").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    return shared.where(F.col("k") * 2 >= F.col("n")).groupBy("th").agg(F.min("copy").alias("copy"))


def _entropy_terms(cells: list[tuple[Column, Column]]) -> Column:
    return sum((F.when(o > 0, o * F.log(o / F.greatest(e, F.lit(1e-9)))).otherwise(0.0) for o, e in cells), F.lit(0.0))


def _evidence(k: Column, n_t: Column, n_e: Column, n: float) -> Column:
    """Log-likelihood ratio of the 2 x 2 table against independence; 0 if they meet less often than by chance."""
    both = n_t * n_e / n
    cells = [(k, both), (n_t - k, n_t - both), (n_e - k, n_e - both), (n - n_t - n_e + k, n - n_t - n_e + both)]
    return F.when(k > both, 2 * _entropy_terms(cells)).otherwise(0.0)


def _wilson(k: Column, n: Column) -> Column:
    """Lower confidence bound of the share k / n."""
    p, zz = k / n, Z * Z
    return (p + zz / (2 * n) - Z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)


def _share(k: Column, n_t: Column, n_e: Column, n: float) -> Column:
    """PMI / IC with the lower bound of P(e|t)."""
    return F.log2(_wilson(k, n_t) * n / n_e) / F.log2(n / n_e)


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, share, put): the disclosing terms, the largest share that each discloses of an entity, and what takes
    its place.  found: ``base_spans(docs)``, staged."""
    n = float(found.count())
    words = _identified(docs)
    held = staged(found.select("th", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct(), "pii-held")
    several = staged(held.groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("entity"), "pii-several")
    held = staged(join_checked(held, several, "entity", "left_semi"), "pii-held")
    texts = staged(join_checked(words, staged(held.select("th").distinct(), "pii-texts"), "th", "left_semi").select("id", "th", "text"), "pii-holders")
    held = held.join(copy_groups(texts), "th")
    # entities in the same groups of copies are one class: a sum of hashes names the set of groups
    sets = held.select("entity", "copy").distinct().groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("copy")).alias("x"), F.sum(F.xxhash64("copy", F.lit(1)).cast("decimal(20,0)")).alias("s"))
    sets = staged(sets.where((F.col("n_e") >= support) & (F.col("n_e") < n)).select("entity", "n_e", F.xxhash64("x", "s", "n_e").alias("class")), "pii-entities")
    classes = staged(held.join(sets, "entity").select("th", "copy", "class", "n_e").distinct(), "pii-classes")
    # what each document with such an entity holds: distinct terms, those that may disclose something
    terms = join_checked(texts, staged(classes.select("th").distinct(), "pii-texts"), "th", "left_semi").select("id", "th", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    terms = staged(terms, "pii-terms")
    candidates = staged(terms.select("term").distinct(), "pii-candidates")
    # added up before the join: how many words are candidates grows faster than the corpus, how many there are doesn't
    every = words.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = staged(join_checked(every, candidates, "term", "inner"), "pii-counts")  # a semi join would be pushed below the sums
    top = classes.agg(F.max("n_e").alias("n_e"), F.min("n_e").alias("least")).first()
    # PMI / IC >= generalise needs n(t) <= n(e) (N / n(e)) ** (1 - generalise), or less: the bound rises with n(e)
    most = (top["n_e"] or 0) * (n / (top["n_e"] or 1)) ** (1 - generalise)
    in_docs = staged(terms.groupBy("th", "term").agg(F.count("*").alias("rows")), "pii-in-docs")  # rows of equal texts
    outside = in_docs.groupBy("term").agg(F.sum("rows").alias("inside")).join(counts, "term").where(F.col("n_t") - F.col("inside") + 1 <= most)
    rare = in_docs.join(outside.select("term", "n_t"), "term")
    copies = staged(rare.join(classes.select("th", "copy").distinct(), "th").groupBy("copy", "term").agg(F.sum("rows").alias("rows"), F.max("n_t").alias("n_t")), "pii-copies")
    pairs = copies.join(classes.select("copy", "class", "n_e").distinct(), "copy")
    pairs = pairs.groupBy("class", "term").agg(F.count("*").alias("k"), F.sum("rows").alias("rows"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e"))
    pairs = pairs.where(F.col("k") >= support).withColumn("n_t", F.col("n_t") - F.col("rows") + F.col("k"))  # copies once
    share, evidence = _share(F.col("k"), F.col("n_t"), F.col("n_e"), n), _evidence(F.col("k"), F.col("n_t"), F.col("n_e"), n)
    flagged = pairs.withColumn("share", share).where((F.col("share") >= generalise) & (evidence >= EVIDENCE * F.log(F.lit(n))))
    flagged = staged(flagged.select("class", "term", "share", "n_e"), "pii-flagged")
    if flagged.isEmpty():
        return flagged.select("term", "share", F.lit("").alias("put"))
    # the ladder: how much would the class of a term disclose in its place?  In how many documents it stands:
    # three numbers.  At most all groups of e hold a word of that class.
    has = words.agg(*(F.count_if(F.rlike("text", F.lit(p))).alias(c) for c, p in _CLASS_SIGNS.items())).first()
    n_class = F.create_map(*(x for c in CLASSES for x in (F.lit(c), F.lit(has[c]))))[F.col("kind")]
    steps = flagged.withColumn("kind", _class(F.col("term"))).withColumn("n_class", n_class)
    open_class = F.max(_share(F.col("n_e"), F.greatest("n_class", "n_e"), F.col("n_e"), n)) >= generalise
    put = F.when(F.max("share") >= remove, "").when(open_class, "[TERM]").otherwise(F.concat(F.lit("["), F.max("kind"), F.lit("]")))
    return staged(steps.groupBy("term").agg(F.max("share").alias("share"), put.alias("put")), "pii-shares")


def _placed(words: DataFrame) -> DataFrame:
    """(id, th, word, end, term) of every word of ``words`` (id, th, text), its end in code points.  A text is cut
    into runs of words whose beginnings are added up; a word adds its own run's words, if its end is needed."""
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"[^{_WORD}]*+[{_WORD}]++"), F.lit(0))  # gap and word
    words = words.select("id", "th", pieces.alias("pieces"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("pieces"), F.lit(1)), F.lit(_RUN)), lambda i: F.slice("pieces", i, _RUN))

    def add(acc: Column, run: Column) -> Column:
        return F.struct((acc["at"] + F.length(F.array_join(run, ""))).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))

    begins = F.aggregate("runs", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), add, lambda acc: acc["begins"])
    rows = words.select("id", "th", runs.alias("runs")).select("id", "th", F.explode(F.arrays_zip(begins.alias("begin"), F.col("runs").alias("run"))).alias("run"))
    rows = rows.select("id", "th", F.col("run.begin").alias("begin"), F.col("run.run").alias("run"))
    rows = rows.select("id", "th", "begin", "run", F.posexplode("run").alias("i", "piece"))
    word = F.regexp_replace("piece", rf"^[^{_WORD}]++", "")
    end = F.col("begin") + F.length(F.array_join(F.slice("run", F.lit(1), F.col("i") + 1), ""))
    return rows.select("id", "th", word.alias("word"), end.alias("end"), F.lower(word).alias("term"))


def term_spans(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """(id, th, terms): array of (start, kind, end, value, share, put) of the disclosing terms' places."""
    rows = join_checked(_placed(_identified(docs).select("id", "th", "text")), flagged, "term", "inner")
    span = F.struct((F.col("end") - F.length("word")).alias("start"), F.lit(4).alias("kind"), "end", F.col("word").alias("value"), "share", "put")
    return rows.groupBy("id", "th").agg(F.array_sort(F.collect_set(span)).alias("terms"))


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, id, th, spans, terms) of each row of ``docs`` (doc_id, text)."""
    found = staged(base_spans(docs), "pii-base")
    terms = staged(term_spans(docs, disclosures(docs, found, support, generalise, remove)), "pii-spans")
    out = join_checked(found, terms, ["id", "th"], "left", limit=10_000)
    # the words of a match itself are covered by it
    apart = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return out.withColumn("terms", F.coalesce(apart, F.array()))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cuts(spans: Column, terms: Column) -> Column:
    """What is replaced, in order: (start, -end, put)."""
    kinds = F.array(*map(F.lit, KINDS))
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), F.concat(F.lit("["), F.upper(kinds[s["kind"]]), F.lit("]")).alias("put")))
    term = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["put"].alias("put")))
    return F.array_sort(F.concat(plain, term))


def _sanitised(text: Column, cuts: Column) -> Column:
    def add(acc: Column, s: Column) -> Column:
        after = F.struct((-s["to"]).alias("at"), F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), s["put"])).alias("out"))
        return F.when(s["start"] >= acc["at"], after).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(cuts, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans, numbers of generalised and removed terms."""
    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    bare = lambda s: F.struct(s["start"], s["kind"], s["end"])
    everything = F.array_sort(F.concat(F.transform("spans", bare), F.transform("terms", bare)))
    removed = F.size(F.filter("terms", lambda t: t["put"] == "")).cast("long")
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _listed(everything).alias("spans"),
                        (F.size("terms") - removed).cast("long").alias("n_generalised"), removed.alias("n_removed"))


def sanitised(docs: DataFrame, found: DataFrame | None = None, **how) -> DataFrame:
    """(doc_id, text): base spans replaced by [KIND], disclosing terms by their general word or left out."""
    found = find(docs, **how) if found is None else found
    cuts = staged(found.where((F.size("spans") > 0) | (F.size("terms") > 0)).select("id", "th", _cuts(F.col("spans"), F.col("terms")).alias("cuts")).dropDuplicates(["id", "th"]), "pii-cuts")
    rows = join_checked(_identified(docs), cuts, ["id", "th"], "left", limit=10_000)
    return rows.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(_sanitised(F.col("text"), F.col("cuts"))).alias("text"))

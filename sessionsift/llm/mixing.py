"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source's target is its weight's share of all words, stopped at ``max_copies`` times the source's own
words; what is cut off is shared again by weight among the others.  The stopped targets have a closed form:
``least(max_copies * size, weight * level)``, where the common level follows from the sources sorted by
``max_copies * size / weight``.

Within a source every document expects target / source_size copies.  The documents stand in the order of
their size (ties: md5 of the id), the expected copies are summed up along it, one offset of the source is
added, and a document is emitted once for each integer that the sum passes on it.  Because of the order by
size the taken words can differ from the target by about the largest document only.

Scale: a position in a source is (documents of smaller size) + (documents of equal size whose md5 has a
smaller prefix) + (rank within that prefix), so that no window holds a source: the three windows hold a
source's distinct sizes, a size's prefixes, and about ``rows_per_prefix`` documents.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; documents of
size 0 keep their place in the order but take no words; a source without words has target 0; repeated rows
are documents of their own; an empty table gives an empty result; reruns give the same copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionsift.llm.common import join_checked, staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """A number from 0 up to 1, in steps of 2**-20, drawn by the source's name and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def source_targets(sized: DataFrame, max_copies: int = 3, cycle: int = 3, seed: int = 42) -> DataFrame:
    """(source, sid, source_size, target, rate, offset): one row for each source of ``sized`` (source, size)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.col("sid") % cycle + 1).withColumn("cap", F.lit(max_copies) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level if exactly the sources before this one are stopped; it holds from the first that stays below
    t = t.withColumn("level", F.col("words") / F.col("weights"))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)["level"])
    t = t.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return t.select("source", "sid", "source_size", "target", rate.alias("rate"), _offset(F.col("source"), seed).alias("offset"))


def sampled(docs: DataFrame, payload: list[str] | None = None, max_copies: int = 3, cycle: int = 3, seed: int = 42, rows_per_prefix: int = 1_000_000) -> DataFrame:
    """Each row of ``docs`` (its columns ``payload``, or all) as struct ``row``, with size, source_size, target
    and copies (0 to max_copies)."""
    def keyed(more: list[Column]) -> DataFrame:
        return docs.select("source", word_count(F.col("text")).alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("key"), *more)

    sized = staged(keyed([]), "mixing-sizes")
    sources = staged(source_targets(sized, max_copies, cycle, seed), "mixing-sources")
    digits = max(0, math.ceil(math.log(max(1, sized.count() / rows_per_prefix), 16)))
    prefix = F.substring("key", 1, digits)

    def with_source(df: DataFrame) -> DataFrame:
        s = sources.select(F.struct("source").alias("s"), "sid", "source_size", "target", "rate", "offset")
        return join_checked(df.withColumn("s", F.struct("source")), s, "s", "inner").drop("s")  # structs of nulls are equal

    counts = with_source(sized).groupBy("sid", "size", prefix.alias("prefix")).count()
    in_size = Window.partitionBy("sid", "size").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = counts.groupBy("sid", "size").agg(F.sum("count").alias("n")).select("sid", "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("smaller"))
    place = counts.withColumn("same", F.coalesce(F.sum("count").over(in_size), F.lit(0))).join(by_size, ["sid", "size"])
    place = staged(place.select("sid", "size", "prefix", (F.col("smaller") + F.col("same")).alias("before")), "mixing-blocks")

    rows = with_source(keyed([F.struct(*(payload or docs.columns)).alias("row"), F.xxhash64("text").alias("tie")])).withColumn("prefix", prefix)
    within = Window.partitionBy("sid", "size", "prefix").orderBy("key", "tie")
    rows = rows.withColumn("rank", F.row_number().over(within)).join(place, ["sid", "size", "prefix"])
    at = F.col("before") + F.col("rank")
    copies = F.floor(at * F.col("rate") + F.col("offset")) - F.floor((at - 1) * F.col("rate") + F.col("offset"))
    return rows.select("row", "size", "source_size", "target", F.least(copies, F.lit(max_copies)).cast("long").alias("copies"))


def mix(docs: DataFrame, max_copies: int = 3, cycle: int = 3, seed: int = 42) -> DataFrame:
    """The mixed documents: each row of ``docs`` as many times as it was drawn."""
    out = sampled(docs, None, max_copies, cycle, seed)
    return out.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         coalesce(md5(cast(doc_id as varchar)), '') as k
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source asc nulls last) - 1 as sid
  from d group by source),
w as (select *, sid % 3 + 1 as weight, 3 * source_size as cap, (3 * source_size)::double / (sid % 3 + 1) as ratio from s),
l as (
  select *, ((sum(source_size) over () - coalesce(sum(cap) over before, 0))::double
             / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double) as lev
  from w window before as (order by ratio, sid rows between unbounded preceding and 1 preceding)),
v as (select lev from l where lev <= ratio order by ratio, sid limit 1),
t as (
  select source, source_size, least(cap::double, coalesce(weight * (select lev from v), 0.0)) as target,
         ('0x' || substr(md5('42:' || coalesce('s' || source, 'null')), 1, 5))::bigint / 1048576.0::double as u
  from l),
r as (
  select d.doc_id, d.size, t.source_size, t.target, t.u,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
         row_number() over (partition by d.source order by d.size, d.k) as i
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(least(floor(i * rate + u) - floor((i - 1) * rate + u), 3) as bigint) * size as taken
from r
"""

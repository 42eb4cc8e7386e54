"""Reversible line dedup: exact reference counts with sharded cuckoo filters in front.

State (``LineIndex``), all below the shared folder, each change a new version:

* postings (key, doc_id): the distinct documents of each counted line key;
* counts (key, refs, last_doc): exact reference counts with the largest document, for every counted key;
* per shard of the key space: a cuckoo filter of the keys that ``min_docs`` or more documents hold, and
  sorted arrays of the same keys and their last documents.

``build`` counts in Spark (partial counts before each shuffle, so a line in a third of all documents is
summed, not gathered).  ``insert`` and ``delete`` count only the touched keys again and insert them into,
or delete them from, their shard's filter; deleting what was inserted restores the earlier result.
``apply`` reads the documents once, without a shuffle: a line whose key the filter refuses stays; one that
it lets through is looked up in the shard's exact array, which workers map into memory.

Defined cases: a null text is one empty line; lines whose key is shorter than ``min_chars`` code points are
neither counted nor dropped; a line repeated in a document counts once; rows of one doc_id are one
document; rows with a null doc_id aren't counted and keep all lines; a document may lose all its lines (its
text is then empty); an empty table gives an empty index.  Other columns aren't touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.common import staged
from sessionsift.llm.cuckoo import CuckooFilter
from sessionsift.llm.sharedfs import load_array, save_array
from sessionsift.session import scratch_dir

MIN_DOCS = 3
MIN_CHARS = 20
SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the stripped, A-Z lower-cased line; None if it has fewer than ``min_chars`` code points."""
    line = line.strip(SPACES)
    if len(line) < min_chars or (not line.isascii() and len(line.decode()) < min_chars):
        return None
    return hashlib.md5(line.lower(), usedforsecurity=False).digest()


def postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id) of each counted line, distinct within a row."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc_id is not None and text.is_valid:
                    own = {line_key(x, min_chars) for x in text.as_buffer().to_pybytes().split(b"\n")} - {None}
                    ids.extend([doc_id] * len(own))
                    found.extend(own)
            yield pa.record_batch([pa.array(found, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(keys, "key binary, doc_id long")


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count_distinct("doc_id").alias("refs"), F.max("doc_id").alias("last_doc"))


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-byte keys as two 64-bit numbers."""
    pair = np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return pair[:, 0], pair[:, 1]


#: A shard's arrays, in the order of (hi, lo); a search reads a few pages of the first one.
_ARRAYS = ("hi", "lo", "last_doc")


def _shard_uri(root: str, version: int, shard: int, what: str) -> str:
    return f"{root}/v{version}/{what}-{shard:05d}.npy"


def _shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class LineIndex:
    """One version of the state."""

    root: str
    version: int
    shards: int
    min_docs: int
    min_chars: int
    postings: DataFrame
    counts: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keys_per_shard: int = 500_000) -> LineIndex:
        root = scratch_dir(docs.sparkSession, "line-index")
        postings = staged(postings_of(docs, min_chars), "line-postings")
        counts = staged(_counts(postings), "line-counts")
        held = counts.where(F.col("refs") >= min_docs)
        index = cls(root, 0, max(1, -(-held.count() // keys_per_shard)), min_docs, min_chars, postings, counts)
        index._write_shards(held.select("key", "last_doc", F.lit(False).alias("was"), F.lit(True).alias("now")), fresh=True)
        return index

    def _write_shards(self, changes: DataFrame, fresh: bool) -> None:
        """changes: (key, last_doc, was, now): keys that were, or now are, at ``min_docs``."""
        root, version, shards = self.root, self.version, self.shards

        def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            shard = int(key[0])
            hi, lo = _split(rows["key"].to_numpy()) if len(rows) else (np.zeros(0, np.uint64),) * 2
            was, now = rows["was"].to_numpy(bool), rows["now"].to_numpy(bool)
            table = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
            sieve = CuckooFilter.sized(int(now.sum()))
            if not fresh:
                sieve = CuckooFilter(np.array(load_array(_shard_uri(root, version - 1, shard, "filter"))))
                table = [np.array(load_array(_shard_uri(root, version - 1, shard, a))) for a in _ARRAYS]
                stay = ~(np.isin(table[0], hi[was]) & np.isin(table[1], lo[was]))
                table = [a[stay] for a in table]
                sieve.delete(hi[was & ~now])
            new = (hi[now], lo[now], rows["last_doc"].to_numpy(np.int64)[now])
            table = [np.concatenate(x) for x in zip(table, new)]
            order = np.lexsort((table[1], table[0]))
            table = [a[order] for a in table]
            if not sieve.insert(hi[now & ~was]):
                n = len(order)
                while not (sieve := CuckooFilter.sized(n := n * 2)).insert(table[0]):
                    pass
            for name, array in zip(_ARRAYS, table):
                save_array(_shard_uri(root, version, shard, name), array)
            save_array(_shard_uri(root, version, shard, "filter"), sieve.table)
            return pd.DataFrame({"shard": [shard], "keys": [len(order)]})

        @F.pandas_udf("long")
        def shard(keys: pd.Series) -> pd.Series:
            return pd.Series(_shard_of(_split(keys.to_numpy())[0], shards) if len(keys) else np.zeros(0, np.int64))

        spark = changes.sparkSession
        every = spark.range(shards).select(F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("last_doc"), F.lit(False).alias("was"), F.lit(False).alias("now"), F.col("id").alias("shard"))
        rows = changes.withColumn("shard", shard("key")).unionByName(every)
        written = rows.groupBy("shard").applyInPandas(lambda key, pdf: write(key, pdf[pdf["key"].notna()]), "shard long, keys long")
        if written.count() != shards:
            raise RuntimeError("a shard of the line index was not written")

    def _next(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        """The version over ``postings``, where only the keys of ``touched`` have changed."""
        touched = staged(touched.select("key").distinct(), "line-touched")
        fresh = staged(_counts(postings.join(touched, "key", "left_semi")), "line-counts")
        counts = staged(self.counts.join(touched, "key", "left_anti").unionByName(fresh), "line-counts")
        index = LineIndex(self.root, self.version + 1, self.shards, self.min_docs, self.min_chars, postings, counts)
        old = self.counts.join(touched, "key", "left_semi").select("key", F.col("refs").alias("old_refs"))
        both = old.join(fresh, "key", "full").select(
            "key", F.coalesce("last_doc", F.lit(0)).alias("last_doc"),
            (F.coalesce("old_refs", F.lit(0)) >= self.min_docs).alias("was"), (F.coalesce("refs", F.lit(0)) >= self.min_docs).alias("now"))
        index._write_shards(both.where("was OR now"), fresh=False)
        return index

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with ``docs`` (new ids) added."""
        new = staged(postings_of(docs, self.min_chars), "line-postings")
        return self._next(staged(self.postings.unionByName(new), "line-postings"), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids`` (doc_id)."""
        ids = staged(ids.select(F.col("doc_id").cast("long")).distinct(), "line-deleted")
        gone = staged(self.postings.join(ids, "doc_id", "left_semi").select("key", "doc_id"), "line-postings")
        return self._next(staged(self.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "line-postings"), gone)

    def kept(self, text: Column, doc_id: Column) -> Column:
        """struct(text, n_lines, n_dropped): the text without its dropped lines."""
        root, version, shards, min_chars = self.root, self.version, self.shards, self.min_chars

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def keep(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
            lines = [(t or "").encode().split(b"\n") for t in texts]
            rows, spots, keys = [], [], []
            for r, own in enumerate(lines):
                for k, line in enumerate(own):
                    if (key := line_key(line, min_chars)) is not None:
                        rows.append(r)
                        spots.append(k)
                        keys.append(key)
            row, spot = np.array(rows, dtype=np.int64), np.array(spots, dtype=np.int64)
            hi, lo = _split(np.array(keys, dtype=object)) if keys else (np.zeros(0, np.uint64),) * 2
            of_shard = _shard_of(hi, shards)
            no_id = ids.isna().to_numpy()
            own_id = ids.fillna(0).to_numpy().astype(np.int64)
            drop: dict[int, set[int]] = {}
            for shard in np.unique(of_shard).tolist():
                at = np.flatnonzero(of_shard == shard)
                at = at[CuckooFilter(load_array(_shard_uri(root, version, shard, "filter"))).contains(hi[at])]
                if not len(at):
                    continue
                known, low, last_doc = (load_array(_shard_uri(root, version, shard, a)) for a in _ARRAYS)
                place = np.searchsorted(known, hi[at])
                for i, p in zip(at.tolist(), place.tolist()):
                    while p < len(known) and known[p] == hi[i] and low[p] != lo[i]:
                        p += 1
                    r = int(row[i])
                    if p < len(known) and known[p] == hi[i] and not no_id[r] and last_doc[p] != own_id[r]:
                        drop.setdefault(r, set()).add(int(spot[i]))
            kept = [b"\n".join(x for k, x in enumerate(own) if k not in drop[r]).decode() if r in drop else (t or "") for r, (own, t) in enumerate(zip(lines, texts))]
            return pd.DataFrame({"text": kept, "n_lines": [len(x) for x in lines], "n_dropped": [len(drop.get(r, ())) for r in range(len(lines))]})

        return keep(text, doc_id)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with a struct ``kept`` (text, n_lines, n_dropped) added in place of all other columns but doc_id."""
    index = LineIndex.build(docs, min_docs, min_chars)
    return docs.select("doc_id", index.kept(F.col("text"), F.col("doc_id").cast("long")).alias("kept"))


ORACLE = r"""
with d as (
  select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
  select row_id, doc_id, i, lines[i] as line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select row_id, doc_id, lines, unnest(range(1, len(lines) + 1)) as i from d)),
hot as (
  select k, max(doc_id) as last_doc from l where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
m as (
  select l.*, hot.k is not null and l.doc_id is not null and l.doc_id <> hot.last_doc as gone
  from l left join hot on l.k = hot.k)
select any_value(doc_id) as doc_id, cast(count(*) as bigint) as n_lines,
       cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by row_id
"""

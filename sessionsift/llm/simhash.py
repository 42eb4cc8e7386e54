"""SimHash near-duplicates with bit-sliced comparison.

* ``simhash_udf``: 64-bit fingerprint of a text (word shingles, XXH64).
* ``link_components``: fingerprints within ``radius`` differing bits link; the result gives each distinct
  fingerprint the smallest id reachable over such links.

Candidates.  A radius of r leaves at least two of r + 2 blocks of the 64 bits alike, so for r = 2 every
linked pair shares two of four 16-bit blocks: each distinct fingerprint goes to six buckets of a 32-bit key
and no link is missed.  A bucket with more than ``split_at`` distinct fingerprints is dealt out again by the
same rule over the 32 bits that its key leaves open (two of four 8-bit blocks), so that no group holds more
than 2**16 fingerprints, however many documents there are.

Comparison.  A group's fingerprints are stored as 64 bit planes, 64 fingerprints to a machine word.  Blocks
of queries are compared to all of them plane by plane; carry-save counters add the differing bits of 64
fingerprints per operation, and queries for which every counter already exceeds the radius are abandoned.
Groups report a spanning forest of their links (at most one edge for each fingerprint), not all pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint zero, which links like any
other; a null id has no identity: such a row gets its fingerprint but a null component and links nothing;
repeated ids are one document, so equal rows get equal results; an empty table gives an empty result.
Columns other than the id and the text aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.common import staged
from sessionsift.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        whole, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    h = np.array(hashes, dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        total += np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def simhash_column(text: Column | str, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """64-bit fingerprint as a (signed) long column."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return simhash(text)


# --- comparison ---------------------------------------------------------------------------------------

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows; bit i % 64 of word i // 64 of row b is bit b of fingerprint i."""
    pad = np.zeros(-len(fps) % 64, dtype=np.uint64)
    bits = np.unpackbits(np.concatenate([fps, pad]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_pairs(fps: np.ndarray, radius: int = RADIUS, queries: int = 128, words: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with at most ``radius`` differing bits, i < j, block by block."""
    planes = bit_planes(fps)
    n_counters = (radius + 1).bit_length()
    flags = (fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    for q0 in range(0, len(fps), queries):
        for w0 in range(q0 // 64, planes.shape[1], words):
            block = planes[:, w0:w0 + words]
            alive = np.arange(q0, min(q0 + queries, len(fps)))
            flip = np.uint64(0) - flags[alive]
            counter = [np.zeros((len(alive), block.shape[1]), dtype=np.uint64) for _ in range(n_counters)]
            over = np.zeros_like(counter[0])
            for b in range(64):
                carry = block[b][None, :] ^ flip[:, b][:, None]
                for c in counter:  # carry-save addition of one bit to 64 counters a word
                    c ^= carry
                    carry &= ~c
                over |= carry
                if b % 8 == 7:
                    beyond = over | _exceeds(counter, radius)
                    keep = (beyond != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
                    if not keep.any():
                        alive = alive[:0]
                        break
                    if not keep.all():
                        alive, flip, over = alive[keep], flip[keep], over[keep]
                        counter = [c[keep] for c in counter]
            if len(alive):
                near = ~(over | _exceeds(counter, radius))
                q, bit = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
                i, j = alive[q], bit + w0 * 64
                ok = (i < j) & (j < len(fps))
                if ok.any():
                    yield i[ok], j[ok]


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where the counters' number is above ``radius``."""
    above, same = np.zeros_like(counter[0]), np.full_like(counter[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            above = above | (same & counter[k])
            same = same & ~counter[k]
    return above


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of a group with the smallest one of its component in the group."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for left, right in near_pairs(fps, radius):
        while (up := parent[parent]).tobytes() != parent.tobytes():  # so that known links need no step below
            parent = up
        same = parent[left] == parent[right]
        for i, j in zip(left[~same].tolist(), right[~same].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(fps))], dtype=np.int64)
    linked = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[linked], fps[roots[linked]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of each key, from rows (band, key, fp) that come sorted by band and key."""
    rest: tuple | None = None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        bounds = np.concatenate([[0], cut])
        sizes = np.diff(bounds)
        for k in np.flatnonzero(sizes > 1):
            yield cols[2][bounds[k]:bounds[k + 1]].view(np.uint64)
        rest = tuple(c[bounds[-1]:].copy() for c in cols)
    if rest is not None and len(rest[0]) > 1:
        yield rest[2].view(np.uint64)


def _block_key(fp: Column, width: int, blocks: tuple[int, ...], at: list[int]) -> Column:
    """The blocks' bits side by side. at: bit positions of all blocks."""
    key = F.lit(0).cast("long")
    for b in blocks:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, at[b]).bitwiseAND((1 << width) - 1))
    return key


def _dealt(df: DataFrame, bands: list[Column]) -> DataFrame:
    """One row for each band: (band, key, fp)."""
    rows = [F.struct(F.lit(k).cast("long").alias("band"), key.alias("key")) for k, key in enumerate(bands)]
    return df.select("fp", F.explode(F.array(*rows)).alias("b")).select("b.band", "b.key", "fp")


def band_keys(fp: Column, radius: int = RADIUS) -> list[Column]:
    """Keys of which linked fingerprints share at least one: two of radius + 2 blocks."""
    n = radius + 2
    width = 64 // n
    at = [width * k for k in range(n)]
    return [_block_key(fp, width, pair, at) for pair in combinations(range(n), 2)]


def link_components(signatures: DataFrame, radius: int = RADIUS, split_at: int = 8192) -> DataFrame:
    """(fp, component_id) for each distinct ``fp`` of ``signatures`` (doc_id, fp; staged by the caller)."""
    if radius != 2:
        raise ValueError("buckets are laid out for a radius of 2")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _runs(batches):
            a, b = forest(np.unique(fps), radius)
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    distinct = staged(signatures.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-fp")
    banded = _dealt(distinct, band_keys(F.col("fp"), radius))
    crowded = staged(banded.groupBy("band", "key").count().where(F.col("count") > split_at).select("band", "key"), "simhash-crowded")
    if crowded.isEmpty():
        grouped = banded
    else:  # the open bits of a crowded bucket are dealt out by the same rule
        marked = banded.join(crowded.withColumn("crowded", F.lit(True)), ["band", "key"], "left")
        finer = []
        for band, pair in enumerate(combinations(range(4), 2)):
            open_blocks = [b for b in range(4) if b not in pair]
            at = [16 * b + half for b in open_blocks for half in (0, 8)]
            part = marked.where(F.col("crowded") & (F.col("band") == band))
            for k, two in enumerate(combinations(range(4), 2)):
                low = _block_key(F.col("fp"), 8, two, at)
                finer.append(part.select(F.lit(6 + 6 * band + k).cast("long").alias("band"), F.shiftleft("key", 16).bitwiseOR(low).alias("key"), "fp"))
        grouped = marked.where("crowded IS NULL").select("band", "key", "fp")
        for part in finer:
            grouped = grouped.unionByName(part)
    links = grouped.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(edges, "a long, b long").distinct()
    roots = connected_components(staged(links, "simhash-links"))
    # the smallest doc_id of a component is not that of its smallest fingerprint
    member = distinct.join(roots.withColumnsRenamed({"node": "fp", "root": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return member.join(least, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, split_at: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; see the module's text for defined cases."""
    sig = staged(docs.select("doc_id", simhash_column(F.col("text"), shingle).alias("fp")), "simhash-sig")
    comp = staged(link_components(sig, radius, split_at), "simhash-comp")
    out = sig.join(comp, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id.  Rows with a null doc_id stay."""
    from sessionsift.llm.common import join_checked

    comp = simhash_components(docs, shingle, radius)
    gone = staged(comp.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    rest = join_checked(docs, gone, "doc_id", "left_anti")
    again = staged(docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id"), "simhash-again")
    if again.isEmpty():
        return rest
    once = join_checked(rest, again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return join_checked(rest, again, "doc_id", "left_anti").unionByName(once)

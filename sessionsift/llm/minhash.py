"""MinHash fingerprints of whole texts, the likeness of neighbours, and near-duplicate classes.

A text's shingles are its runs of ``shingle`` words (split at the six ASCII spaces, A-Z lower-cased; a
shorter text is one shingle).  Shingle hashes x go through ``perms`` permutations a*x + b modulo 2**64 (a
odd); of each the smallest value is kept, scrambled and cut to 16 bits.  The share of equal components
estimates the Jaccard likeness of two texts' shingle sets, with a standard error of at most
0.5 / sqrt(perms).  All of it is numpy over slices of a batch.

``with_neighbours`` fingerprints every document, its edited text, and the next document by id.  Documents
are dealt to ranges of ids of about equal size (bounds from quantiles of the ids), sorted within, and read
once; the first document of each range is also sent to the range before it, so every document meets its
successor and no range holds more than its share of the text.

Defined cases: a null text is an empty one; texts without words share one fingerprint; null ids come first
in the order; rows of one id are ordered by a hash of their text; the only document is its own successor; an
empty table gives an empty result.  Columns other than the id and the text aren't touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.bytekit import LOWER, SPACE, Words, mix, slices
from sessionsift.llm.common import join_checked, staged
from sessionsift.llm.components import connected_components

SHINGLE = 5
PERMS = 128
#: Shingles that go through all permutations at once; they and their images stay in a core's cache.
BLOCK = 1 << 13


def shingle_hashes(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of text i are hashes[first[i]:first[i + 1]]; none is empty."""
    w = Words(LOWER[data], off, ~SPACE)
    n, h = len(off) - 1, w.hash
    count = np.diff(w.first)
    sums = np.zeros(len(h), dtype=np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for k in range(shingle):  # the sum of the following words, each with a factor of its place
        m = max(0, len(h) - k)  # a slice may hold fewer words than a shingle
        sums[:m] = sums[:m] * step + h[len(h) - m:]
    keep = np.arange(len(h)) - w.first[w.doc] <= np.maximum(count[w.doc] - shingle, 0)
    short = np.flatnonzero(count < shingle)
    whole = np.full(len(short), np.uint64(0x5EED))
    for k in range(shingle - 1):
        has = count[short] > k
        whole[has] = mix(whole[has] * step + h[w.first[short[has]] + k])
    first = np.concatenate([[0], np.cumsum(np.maximum(count - shingle + 1, 1))])
    out = np.empty(first[-1], dtype=np.uint64)
    is_short = np.zeros(len(out), dtype=bool)
    is_short[first[short]] = True
    out[is_short] = whole
    out[~is_short] = mix(sums[keep & (count[w.doc] >= shingle)])
    return out, first


def signatures(hashes: np.ndarray, first: np.ndarray, perms: int = PERMS, seed: int = 42) -> np.ndarray:
    """uint16 components, one row for each text."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size=perms, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    b = rng.integers(0, 2**64 - 1, size=perms, dtype=np.uint64)
    n = len(first) - 1
    least = np.full((n, perms), np.uint64(0xFFFFFFFFFFFFFFFF))
    image = np.empty(BLOCK, dtype=np.uint64)
    for lo in range(0, len(hashes), BLOCK):
        x = hashes[lo:lo + BLOCK]
        i = int(np.searchsorted(first, lo, side="right")) - 1
        j = int(np.searchsorted(first, lo + len(x), side="left"))
        starts = np.maximum(first[i:j] - lo, 0)
        y = image[:len(x)]
        for p in range(perms):
            np.multiply(x, a[p], out=y)
            np.add(y, b[p], out=y)
            np.minimum(least[i:j, p], np.minimum.reduceat(y, starts), out=least[i:j, p])
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def signatures_of(texts: list[str], shingle: int = SHINGLE, perms: int = PERMS) -> np.ndarray:
    batch = pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])
    parts = [signatures(*shingle_hashes(data, off, shingle), perms) for _, data, off in slices(batch)]
    return np.concatenate(parts) if parts else np.zeros((0, perms), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def to_hex(sig: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sig]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


_LOWEST = -(2**63)
#: Ranges have a row each on the driver; a range is read as a stream, so that larger ones need no more memory.
MAX_RANGES = 20_000


def _successors(docs: DataFrame, bytes_per_range: int) -> DataFrame:
    """(range, at, halo, doc_id, text): ranges of ids, each with the first row(s) of the next one as halo."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("at", F.coalesce("doc_id", F.lit(_LOWEST)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_RANGES, max(1, -(-size // bytes_per_range)))
    bounds = np.unique(np.array(docs.approxQuantile("at", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], dtype=np.int64))

    def own_range(at: Column) -> Column:
        @F.arrow_udf("int")
        def find(ids: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(bounds, np.asarray(ids), side="right").astype(np.int32))
        return find(at)

    dealt = docs.withColumn("range", own_range(F.col("at")))
    heads = {r["range"]: r["at"] for r in dealt.groupBy("range").agg(F.min("at").alias("at")).collect()}  # a row for each range
    used = sorted(heads)
    before = {heads[r]: used[k - 1] for k, r in enumerate(used)}  # the first range's head goes to the last one
    head_ids = np.array(sorted(before), dtype=np.int64)
    to = np.array([before[i] for i in sorted(before)], dtype=np.int32)

    @F.arrow_udf("int")
    def range_before(ids: pa.Array) -> pa.Array:
        ids = np.asarray(ids)
        k = np.minimum(np.searchsorted(head_ids, ids), max(len(head_ids) - 1, 0))
        hit = head_ids[k] == ids if len(head_ids) else np.zeros(len(ids), bool)
        return pa.array(np.where(hit, to[k] if len(to) else 0, 0), pa.int32(), mask=~hit)

    halo = range_before(F.col("at"))
    both = F.array(F.struct(F.col("range"), F.lit(False).alias("halo")), F.struct(halo.alias("range"), F.lit(True).alias("halo")))
    out = dealt.withColumn("to", F.explode(F.filter(both, lambda x: x["range"].isNotNull())))
    out = out.select(F.col("to.range").alias("range"), F.col("to.halo").alias("halo"), "at", "doc_id", "text")
    return out.repartitionById(n, F.col("range")).sortWithinPartitions("range", "halo", "at", F.xxhash64("text")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def with_neighbours(docs: DataFrame, shingle: int = SHINGLE, perms: int = PERMS, bytes_per_range: int = 8_000_000) -> DataFrame:
    """One row for each document: see the module's text."""
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row and its signature: its successor comes with the next batch
        for batch in batches:
            for part, _, _ in slices(batch):
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), [t or "" for t in part.column(4).to_pylist()], part.column(5).to_pylist()))
                sig = signatures_of([r[3] for r in rows], shingle, perms)
                if held is not None:
                    rows, sig = [held[0], *rows], np.concatenate([held[1], sig])
                held = rows[-1], sig[-1:]
                # a row is the successor of the row before it in the same range; halo rows have none
                at = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
                if not at:
                    continue
                changed = [edited(rows[i][3], rows[i + 1][3]) for i in at]
                sig_edited, i = signatures_of(changed, shingle, perms), np.array(at)
                out = [pa.array([rows[k][2] for k in at], pa.int64()), pa.array([len(rows[k][3]) for k in at], pa.int64()),
                       pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(to_hex(sig[i])), pa.array(to_hex(sig_edited)),
                       pa.array(likeness(sig[i], sig_edited)), pa.array(likeness(sig[i], sig[i + 1])), pa.array([rows[k][4] for k in at], pa.int64())]
                yield pa.record_batch(out, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "th"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, th long"
    return _successors(docs, bytes_per_range).select("range", "halo", "at", "doc_id", "text", "th").mapInArrow(fingerprints, schema)


# --- near-duplicate classes ---------------------------------------------------------------------------

THRESHOLD = 0.8
BANDS = 32
#: Texts of a candidate group that one task compares with as many others.
CLASS_BLOCK = 512


def common_counts(hashes: np.ndarray, owner: np.ndarray, n: int, columns: int = 8192) -> np.ndarray:
    """n x n numbers of common shingles, from distinct (shingle, owner) pairs: products of 0/1 matrices over
    the shingles that several owners hold, some thousand shingles at a time."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    number = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    shared = np.bincount(number)[number] > 1 if len(hashes) else np.zeros(0, bool)
    owner, number = owner[shared], number[shared]
    number = np.unique(number, return_inverse=True)[1]
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, [lo, lo + columns])
        holds = np.zeros((n, columns), dtype=np.float32)
        holds[owner[a:b], number[a:b] - lo] = 1
        out += holds @ holds.T
    return out


def class_links(rows: pd.DataFrame, threshold: float, shingle: int) -> pd.DataFrame:
    """Verified links of a group's texts (th, text): each linked text with the smallest one it reaches in the
    group."""
    texts = rows["text"].tolist()
    batch = pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])
    sets: list[np.ndarray] = []
    for _, data, off in slices(batch):
        h, first = shingle_hashes(data, off, shingle)
        sets += [np.unique(h[a:b]) for a, b in zip(first, first[1:])]
    size = np.array([len(s) for s in sets])
    both = common_counts(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets))
    near = both / (size[:, None] + size[None, :] - both) >= threshold - 1e-6
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    th = rows["th"].to_numpy()
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = root(i), root(j)
        if a != b:
            low, high = (a, b) if th[a] < th[b] else (b, a)
            parent[high] = low
    roots = [root(i) for i in range(len(sets))]
    out = [(int(th[i]), int(th[r])) for i, r in enumerate(roots) if i != r]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


#: Bytes of a band's (key, text hash) and of what a task of ``_candidates`` holds of them.
_PAIR = np.dtype([("key", "V5"), ("th", "<i8")])
BAND_BYTES = 32_000_000


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of each signature; equal bands at different places differ."""
    cut = np.ascontiguousarray(sig).reshape(len(sig), bands, -1).astype(np.uint64)
    h = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), cut.shape[:2])
    for k in range(cut.shape[2]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return h


def band_edges(keys: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text of a key with the smallest text of that key, if it is another."""
    order = np.lexsort((th, keys))
    keys, th = keys[order], th[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    least = th[np.flatnonzero(new)][np.cumsum(new) - 1] if len(keys) else th
    pairs = np.unique(np.stack([th, least], axis=1)[th != least], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _candidates(own: DataFrame, shingle: int, bands: int, perms: int, n: int) -> DataFrame:
    """(a, b): texts that share a band with a smaller one.  Keys (40 bits besides those of the bucket) and text
    hashes are shuffled once, packed in a row for each bucket and batch."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(signatures_of([t or "" for t in batch.column(1).to_pylist()], shingle, perms), bands)
            th = np.repeat(np.asarray(batch.column(0)), bands)
            key = keys.ravel()
            bucket = (key % np.uint64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            pairs = np.empty(len(key), dtype=_PAIR)
            pairs["key"] = np.ascontiguousarray(key[order]).view(np.uint8).reshape(-1, 8)[:, 3:].copy().view("V5").ravel()
            pairs["th"] = th[order]
            used, first = np.unique(bucket[order], return_index=True)
            blocks = [x.tobytes() for x in np.split(pairs, first[1:])] if len(used) else []
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), dtype=_PAIR)
        wide = np.zeros((len(pairs), 8), dtype=np.uint8)
        wide[:, :5] = np.ascontiguousarray(pairs["key"]).view(np.uint8).reshape(-1, 5)
        a, b = band_edges(wide.view("<u8").ravel(), pairs["th"])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    packed = own.select("th", "text").mapInArrow(pack, "bucket int, block binary")
    return packed.repartitionById(n, F.col("bucket")).mapInArrow(edges, "a long, b long").distinct()


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, perms: int = PERMS, block: int = CLASS_BLOCK) -> DataFrame:
    """(th, class_id) of the texts (by their hash) that several rows hold or that are like another text: see
    ``near_duplicates``.  The other rows are classes of their own."""
    own = _hashed(docs)
    reps = staged(own.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.min("id").alias("id"), F.count("*").alias("n")), "minhash-texts")
    n = max(1, -(-reps.count() * bands * _PAIR.itemsize // BAND_BYTES))
    edges = staged(_candidates(own, shingle, bands, perms, n), "minhash-candidates")
    groups = staged(connected_components(edges), "minhash-groups")
    members = groups.select(F.col("node").alias("th"), F.col("root").alias("grp")).unionByName(groups.select(F.col("root").alias("th"), F.col("root").alias("grp")).distinct())
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = members.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
    members = staged(members.join(reps.select("th", "id"), "th"), "minhash-members")
    texts = join_checked(own, members, ["th", "id"], "inner")  # one row of each candidate text
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = texts.select("th", "text", "grp", "mine", other.alias("other"))
    met = met.select("th", "text", "grp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    links = met.groupBy("grp", "lo", "hi").applyInPandas(lambda rows: class_links(rows.drop_duplicates("th"), threshold, shingle), "a long, b long")
    roots = connected_components(staged(links.distinct(), "minhash-links"))
    linked = roots.select(F.col("node").alias("th"), "root").unionByName(roots.select(F.col("root").alias("th"), "root").distinct())
    classes = reps.join(staged(linked, "minhash-roots"), "th", "left").where((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "th"))
    classes = staged(classes.select("th", "root", "doc_id"), "minhash-members")
    smallest = classes.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return staged(classes.join(smallest, "root").select("th", "class_id"), "minhash-classes")


def _hashed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LOWEST)).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (doc_id, th, ..) with ``class_id`` in place of ``th``; rows with a null id get a null class."""
    out = join_checked(rows, classes.select("th", F.col("class_id").alias("found")), "th", "left")
    return out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))).drop("th", "found")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, perms: int = PERMS, block: int = CLASS_BLOCK) -> DataFrame:
    """(doc_id, class_id): the smallest id that a document reaches over pairs of texts whose shingle sets have a
    Jaccard likeness of ``threshold`` or more.

    Equal texts are one text.  A signature is cut into ``bands``; texts that share a band are candidates (a
    pair of likeness s is missed with a probability of (1 - s**(perms/bands))**bands, 4e-8 at 0.8), and what
    candidates reach over shared bands is a group.  Only texts of groups are shuffled.  They are dealt into
    blocks of about ``block``; every two blocks of a group meet in one task, which verifies their pairs exactly
    and reports a spanning forest of the links, so no task holds more than two blocks and no pairs are emitted.
    Rows with a null id get a null class.
    """
    return with_class(_hashed(docs).select("doc_id", "th"), text_classes(docs, threshold, shingle, bands, perms, block))

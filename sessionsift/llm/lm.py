"""Interpolated modified Kneser-Ney bigram model over hashed words, counted in Spark.

Counting.  Tasks hash the words of their documents and count them locally; the counts travel as compressed
blocks (sorted hashes, differences, zstd), one for each shard of the hash space, so that a shuffle row is a
block and no word or bigram, however frequent, gathers more than one entry from each map task:

1. words: shard tasks add up the training count of each word (exact for 64-bit hashes);
2. bigrams, dealt by the hash of both words: shard tasks add up counts; per shard, what each context was
   followed by (count, and how many bigrams of count one, two, more) and how many words came before each
   word go on in the same form;
3. these are added up by word.

Shard tasks keep the sums as sorted arrays in the shared folder.  Words and contexts are kept by their 64-bit
hash, words that something came before by its upper 40 bits; a bigram takes 48 bits of its hash within the
shard, 16 of them as an index of buckets, and one byte for its count (larger counts stand in a list of their
own).

Model: p(v | u) = (c(uv) - D(c)) / c(u) + gamma(u) p(v), with p(v) = (n(v) - E(n)) / n + delta / (V + 1),
where n(v) is the number of distinct words seen before v, and the discounts D and E for counts of one, two
and more follow from the numbers of bigrams (words) with counts one to four.  An unseen context falls back
to p(v).  A document begins with a context of its own and ends with an end token.

Scoring maps the arrays of the shared folder into memory and looks up a slice's distinct words and bigrams
in sorted order.  Shards grow in number with the data (``tokens_per_shard``), not in size.

Order two: at order three the counting alone would shuffle and keep over six times the input here (more than
four fifths of all trigrams are distinct).  Two of n words share a 64-bit hash with a probability of about
n*n / 2**65; words that share 40 bits (n*n / 2**41 pairs) get each other's number of words before them.

Defined cases: a null or empty text is the end token alone; rows without an id aren't held out; repeated
rows count and are scored as rows of their own; without training text every token is unknown and the score
is that of the uniform distribution over the one unknown word; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.bytekit import LOWER, SPACE, Words, mix, slices
from sessionsift.llm.common import crc_of_id, staged
from sessionsift.llm.sharedfs import load_array, save_array
from sessionsift.session import scratch_dir

#: Hashes of the end token and of the context that a document begins with.
END, BEGIN = np.uint64(0xE4D0000000000001), np.uint64(0xBE61000000000001)
#: Words counted locally before blocks are sent.
LOCAL_TOKENS = 1_500_000


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, document) of each token of a slice, the end tokens included."""
    w = Words(LOWER[data], off, ~SPACE)
    n = len(off) - 1
    at = w.first[1:] + np.arange(n)  # places of the end tokens
    word = np.empty(len(w.start) + n, dtype=np.uint64)
    is_end = np.zeros(len(word), dtype=bool)
    is_end[at] = True
    word[~is_end], word[is_end] = w.hash, END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.concatenate([[0], at[:-1] + 1]) if n else []] = BEGIN
    return context, word, np.repeat(np.arange(n), np.diff(w.first) + 1)


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + (v >> np.uint64(24)))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their values."""
    if not len(key):
        return (key, *values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first], *(np.add.reduceat(v[order], first) for v in values))


def _columns(a: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, most significant places together: small numbers leave runs of zeros."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def to_block(key: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys and any numbers beside them."""
    parts = [_columns(np.diff(key, prepend=np.uint64(0))), *(_columns(v) for v in values)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def from_block(block: bytes, n_values: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8).reshape(n_values + 1, 8, -1)
    out = [np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _blocks(shards: int, kind: str, key: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (kind, shard, block) for each shard that some of the sorted keys belong to."""
    bounds = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[s], bounds[s + 1]
        yield pa.record_batch([pa.array([kind]), pa.array([s], pa.int64()), pa.array([to_block(key[a:b], *(v[a:b] for v in values))], pa.binary())], names=["kind", "shard", "block"])


def _merged(blocks: pd.Series, n_values: int) -> tuple[np.ndarray, ...]:
    parts = [from_block(b, n_values) for b in blocks]
    return added(*(np.concatenate(x) for x in zip(*parts))) if parts else tuple(np.zeros(0, np.uint64) for _ in range(n_values + 1))


#: The numbers that are kept for each kind of key.
VALUES = {"word": ["count"], "context": ["followed", "one", "two", "more"], "before": ["words"]}
_BUCKET_BITS = 16


def before_key(word: np.ndarray) -> np.ndarray:
    """The upper 40 bits: so many are sent and kept of the second word of a bigram."""
    return word >> np.uint64(24) << np.uint64(24)


def _in_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """48 bits that order the hashes of one shard."""
    within = (h >> np.uint64(32)) * np.uint64(shards) & np.uint64(0xFFFFFFFF)
    return within << np.uint64(16) | (h & np.uint64(0xFFFFFFFF)) >> np.uint64(16)


def _uri(root: str, kind: str, field: str, shard: int) -> str:
    return f"{root}/{kind}-{shard:05d}/{field}.npy"


def _save_keyed(root: str, kind: str, shard: int, key: np.ndarray, values: tuple[np.ndarray, ...]) -> None:
    save_array(_uri(root, kind, "key", shard), key)
    for field, v in zip(VALUES[kind], values):
        wide = len(v) and int(v.max()) >= 1 << 32  # a very frequent word of a large corpus
        save_array(_uri(root, kind, field, shard), v.astype(np.uint64 if wide else np.uint32))


def _save_bigrams(root: str, shard: int, shards: int, h: np.ndarray, n: np.ndarray) -> None:
    key = _in_shard(h, shards)
    bucket = (key >> np.uint64(32)).astype(np.int64)
    save_array(_uri(root, "bigram", "index", shard), np.searchsorted(bucket, np.arange((1 << _BUCKET_BITS) + 1)).astype(np.uint32))
    save_array(_uri(root, "bigram", "suffix", shard), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    save_array(_uri(root, "bigram", "count", shard), np.minimum(n, 255).astype(np.uint8))
    large = np.flatnonzero(n >= 255)
    save_array(_uri(root, "bigram", "large_at", shard), large)
    save_array(_uri(root, "bigram", "large", shard), n[large].astype(np.int64))


def _find_bigrams(root: str, shard: int, shards: int, h: np.ndarray) -> np.ndarray:
    """Counts of bigrams (0: unseen) of one shard, by a binary search in each one's bucket."""
    key = _in_shard(h, shards)
    want = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    index, suffix, count, large_at, large = (load_array(_uri(root, "bigram", f, shard)) for f in ("index", "suffix", "count", "large_at", "large"))
    out = np.zeros(len(h))
    if not len(suffix):
        return out
    bucket = (key >> np.uint64(32)).astype(np.int64)
    lo, end = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
    hi = end.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = np.zeros(len(h), dtype=bool)
        less[open_] = suffix[mid[open_]] < want[open_]
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    hit = lo < end
    hit[hit] = suffix[lo[hit]] == want[hit]
    c = count[lo[hit]].astype(float)
    many = c == 255
    if many.any():
        c[many] = large[np.searchsorted(large_at, lo[hit][many])]
    out[hit] = c
    return out


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of one, two and more, from n[k] = how many have count k + 1."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5], 0.05, [0.95, 1.95, 2.95])


@dataclass(frozen=True)
class Model:
    root: str
    shards: int
    n: int  # training tokens
    v: int  # distinct training tokens
    bigram_discounts: np.ndarray
    word_discounts: np.ndarray
    types: int  # distinct bigrams
    word_counts: tuple[int, int, int]  # words preceded by one, two, more distinct words

    def _by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        bounds = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            yield s, slice(int(bounds[s]), int(bounds[s + 1]))

    def values(self, kind: str, keys: np.ndarray) -> list[np.ndarray]:
        """The kind's numbers for sorted keys, 0 where a key is unseen."""
        out = [np.zeros(len(keys)) for _ in VALUES[kind]]
        for s, own in self._by_shard(keys):
            table = load_array(_uri(self.root, kind, "key", s))
            p = np.searchsorted(table, keys[own])
            ok = p < len(table)
            ok[ok] = table[p[ok]] == keys[own][ok]
            for o, field in zip(out, VALUES[kind]):
                o[own][ok] = load_array(_uri(self.root, kind, field, s))[p[ok]]
        return out

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for s, own in self._by_shard(keys):
            out[own] = _find_bigrams(self.root, s, self.shards, keys[own])
        return out

    def log10(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token."""
        distinct, back = np.unique(np.concatenate([word, context]), return_inverse=True)
        of_word, of_context = back[:len(word)], back[len(word):]
        # p(v), by the number of distinct words before v
        d = np.concatenate([[0.0], self.word_discounts])
        before = self.values("before", before_key(distinct))[0]
        free = float(np.dot(self.word_discounts, self.word_counts)) / self.types if self.types else 1.0
        lower = (before - d[np.minimum(before, 3).astype(int)]) / max(self.types, 1) + free / (self.v + 1)
        # p(v | u)
        pairs, pair_of = np.unique(pair_hash(context, word), return_inverse=True)
        c = self.bigrams(pairs)[pair_of]
        d = np.concatenate([[0.0], self.bigram_discounts])
        total, *by_count = self.values("context", distinct)
        left = self.bigram_discounts @ np.stack(by_count)
        gamma = np.divide(left, total, out=np.ones(len(distinct)), where=total > 0)
        upper = np.divide(c - d[np.minimum(c, 3).astype(int)], total[of_context], out=np.zeros(len(word)), where=total[of_context] > 0)
        return np.log10(upper + gamma[of_context] * lower[of_word]), self.values("word", distinct)[0][of_word]


def train(docs: DataFrame, tokens_per_shard: int = 4_000_000, bytes_per_token: int = 6) -> Model:
    """Count ``docs`` (text) and write the model below the shared folder."""
    root = scratch_dir(docs.sparkSession, "ngram-model")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (tokens_per_shard * bytes_per_token)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            u, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            yield from _blocks(shards, "word", *added(v, np.ones(len(v), np.uint64)))
            key = pair_hash(u, v)
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            n = np.diff(np.append(first, len(key))).astype(np.uint64)
            at = order[first]
            yield from _pair_blocks(shards, key[at], u[at], v[at], n)

        for batch in batches:
            for _, data, off in slices(batch):
                u, v, _ = tokens(data, off)
                held.append((u, v))
                if sum(len(x) for x, _ in held) > LOCAL_TOKENS:
                    yield from send()
        if held:
            yield from send()

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One shard of words, or of bigrams: keep its sums, pass on what bigrams say about words."""
        kind, shard = str(key[0]), int(key[1])
        if kind == "word":
            h, n = _merged(rows["block"], 1)
            _save_keyed(root, kind, shard, h, (n,))
            return pd.DataFrame({"kind": ["word stats"], "shard": [shard], "block": [None], "stats": [[int(n.sum()), len(h)]]})
        u, v, n = (np.concatenate(x) for x in zip(*map(_from_pairs, rows["block"])))
        h = pair_hash(u, v)
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n, u, v = h[first], np.add.reduceat(n, first), u[order[first]], v[order[first]]
        _save_bigrams(root, shard, shards, h, n)
        stats = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]
        out = [b.to_pandas() for b in _blocks(shards, "context", *added(u, n, *((n == k).astype(np.uint64) for k in (1, 2)), (n > 2).astype(np.uint64)))]
        out += [b.to_pandas() for b in _blocks(shards, "before", *added(v, np.ones(len(v), np.uint64)))]
        return pd.concat([pd.concat(out).assign(stats=None), pd.DataFrame({"kind": ["pair stats"], "shard": [shard], "block": [None], "stats": [stats]})], ignore_index=True)

    counted = docs.select("text").mapInArrow(count, "kind string, shard long, block binary")
    schema = "kind string, shard long, block binary, stats array<long>"
    summed = staged(counted.groupBy("kind", "shard").applyInPandas(add_up, schema), "ngram-sums")

    def by_word(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, shard = str(key[0]), int(key[1])
        h, *values = _merged(rows["block"], len(VALUES[kind]))
        _save_keyed(root, kind, shard, h, tuple(values))
        n = values[0]
        stats = [*(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n > 2).sum())] if kind == "before" else []
        return pd.DataFrame({"kind": [f"{kind} stats"], "shard": [shard], "stats": [stats]})

    rows = summed.where("kind IN ('context', 'before')").select("kind", "shard", "block")
    done = staged(rows.groupBy("kind", "shard").applyInPandas(by_word, "kind string, shard long, stats array<long>"), "ngram-words")
    stats = staged(summed.where("stats IS NOT NULL").select("kind", "shard", "stats").unionByName(done), "ngram-stats")

    def total(kind: str, n: int) -> list[int]:
        return [int(x or 0) for x in stats.where(F.col("kind") == kind).agg(*(F.sum(F.col("stats")[k]) for k in range(n))).first()]

    none = np.zeros(0, np.uint64)
    have = {(r["kind"], r["shard"]) for r in stats.select("kind", "shard").collect()}  # a few rows for each shard
    for shard in range(shards):  # shards without any key
        for kind in VALUES:
            if (f"{kind} stats", shard) not in have:
                _save_keyed(root, kind, shard, none, (none,) * len(VALUES[kind]))
        if ("pair stats", shard) not in have:
            _save_bigrams(root, shard, shards, none, none)
    words, pairs, before = total("word stats", 2), total("pair stats", 5), total("before stats", 5)
    return Model(root, shards, words[0], words[1], _discounts(pairs[:4]), _discounts(before[:4]), pairs[4], (before[0], before[1], before[4]))


def _pair_blocks(shards: int, key: np.ndarray, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of bigrams by the shard of their hash; within a block they stand in the order of u.  Of v only
    ``before_key`` and of both words together the hash are needed, so v is cut to 40 bits."""
    bounds = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(int(bounds[s]), int(bounds[s + 1]))
        order = np.lexsort((v[own], u[own]))
        raw = _columns(np.diff(u[own][order], prepend=np.uint64(0))) + _columns(v[own][order] >> np.uint64(24)) + _columns(n[own][order])
        block = zstandard.ZstdCompressor(level=1).compress(raw)
        yield pa.record_batch([pa.array(["pair"]), pa.array([s], pa.int64()), pa.array([block], pa.binary())], names=["kind", "shard", "block"])


def _from_pairs(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8).reshape(3, 8, -1)
    u, v, n = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw)
    return np.cumsum(u, dtype=np.uint64), v << np.uint64(24), n


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs`` (doc_id, text)."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch):
                context, word, doc = tokens(data, off)
                log10, c = model.log10(context, word)
                base = np.log10((c + 0.1) / (model.n + 0.1 * (model.v + 1)))
                n = len(off) - 1
                out = [np.bincount(doc, minlength=n), np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64), np.bincount(doc, weights=base, minlength=n), np.bincount(doc, weights=log10, minlength=n)]
                yield pa.record_batch([rows.column(0).cast(pa.int64()), *map(pa.array, out)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(parts: int = 10):
    return F.coalesce(crc_of_id("doc_id") % parts == 0, F.lit(False))


def perplexity(score: str = "score", n_tokens: str = "n_tokens"):
    return F.pow(F.lit(10.0), -F.col(score) / F.col(n_tokens))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those that aren't held out."""
    model = train(docs.where(~held_out()).select("text"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")

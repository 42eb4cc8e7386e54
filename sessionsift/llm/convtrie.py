r"""Conversation prefix trie by a splitter skeleton.

Every turn is named by a digest of its role and text; a conversation's path is the row of its digests, and a node
of the trie is a distinct beginning of paths.  Splitters cut the sorted pairs (path, conv_id) into shards of about
equal size.  A node whose members lie in more than one shard is a beginning of a splitter's path, so the trie of
the splitters' paths, the skeleton, is broadcast; it has at most ``shards * DEEP`` nodes.  Every shard walks its
sorted paths with a stack: nodes outside the skeleton end there with all their figures, skeleton nodes give
partial figures, which are added up by node; subtree sums then rise along the (small) skeleton.

Scale: texts are read once and never shuffled; a turn is a digest and a length from there on.  Equal paths, however
many, are split by their conv_id.  A shard holds the nodes of one path and the closed children of the open local
nodes; ids that end at a skeleton node are packed into strings of ``CHUNK`` ids before they meet in the order of
the hash, which is fed one string at a time.  A conversation's path is one value (some 40 bytes a turn).

Defined cases: null turns come first, equal turns in the order of role and digest; a null role or text is empty;
rows with a null conv_id take no part; equal rows are turns of their own; conversations without rebuilt turns are
members of the root; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.common import join_checked, staged

#: Conversations come in families of so many; the first of a family lends its first turns (fewer than HEADS).
FAMILY, HEADS = 5, 9
#: Characters of a digest; turns of a path that a splitter keeps; samples for each shard; ids in one string.
DIGEST, DEEP, SAMPLES, CHUNK = 32, 32, 20, 4096
ROOT = "0" * DIGEST


def _borrowed(conv_id: str) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS).cast("int")


def original_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (digest, bytes) in the order of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t"), _by_turn), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns, nulls first (array_sort would put them last)."""
    key = lambda t: F.struct(t["turn"].isNotNull(), F.coalesce(t["turn"], F.lit(0)), t["role"], t["digest"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, bytes): every conversation behind the turns it takes from the first of its family."""
    own = staged(original_paths(conversations), "trie-paths")
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    rows = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "family", "left").withColumn("h", _borrowed("conv_id"))
    none = F.array().cast("array<struct<digest: string, bytes: bigint>>")
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.concat(head, rest)
    return rows.select("conv_id", turns.alias("turns")).select("conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.bytes").alias("bytes"))


def child_of(node: str, digest: str) -> str:
    """The name of the node that a turn leads to."""
    return hashlib.md5((node + digest).encode()).hexdigest()


def _beginnings(path: str) -> list[str]:
    """Names of the nodes along a path, the root first."""
    names = [ROOT]
    for i in range(0, len(path) - DIGEST + 1, DIGEST):
        names.append(child_of(names[-1], path[i:i + DIGEST]))
    return names


def splitters(paths: DataFrame, shards: int) -> list[tuple[str, int]]:
    """At most shards - 1 ascending (path, conv_id) from a sample; paths cut after DEEP turns.  Where they lie
    changes the work of each shard, never the result."""
    n = paths.count()
    if n <= shards or shards < 2:
        return []
    sample = paths.sample(False, min(1.0, SAMPLES * shards / n), seed=7).select(F.substring("path", 1, DEEP * DIGEST), "conv_id")
    keys = sorted((r[0], r[1]) for r in sample.collect())
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []


# --- one shard ------------------------------------------------------------------------------------------------

_NODE = {"node": pa.string(), "parent": pa.string(), "done": pa.bool_(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
         "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "bytes": pa.int64(), "ends_sha256": pa.string(), "piece": pa.int64(), "ids": pa.string()}
_NODE_SCHEMA = ("node string, parent string, done boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                "saved_tokens long, bytes long, ends_sha256 string, piece long, ids string")


class _Open:
    """A node that may still get members."""

    __slots__ = ("name", "skeleton", "bytes", "least", "n", "children", "leaves", "saved", "sha", "ids", "waiting")

    def __init__(self, name: str, skeleton: bool, size: int):
        self.name, self.skeleton, self.bytes = name, skeleton, size
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ids, self.waiting = None, [], []


class _Walk:
    """Depth-first walk over ascending (path, conv_id)."""

    def __init__(self, skeleton: frozenset):
        self.skeleton, self.path, self.stack, self.out, self.pieces = skeleton, None, [], [], TaskContext.get().partitionId() << 36

    def add(self, path: str, conv_id: int, sizes: list[int]) -> None:
        if self.path is None:
            self.stack.append(_Open(ROOT, True, 0))
        keep = self._common(path)
        while len(self.stack) > keep + 1:
            self._close()
        for d in range(keep, len(sizes)):
            name = child_of(self.stack[-1].name, path[d * DIGEST:(d + 1) * DIGEST])
            self.stack.append(_Open(name, name in self.skeleton, sizes[d]))
        self.path = path
        for node in self.stack:
            node.n += 1
            if node.least is None or conv_id < node.least:
                node.least = conv_id
        end = self.stack[-1]
        if end.skeleton:
            end.ids.append(str(conv_id))
            if len(end.ids) >= CHUNK:
                self._pack(end)
        else:
            if end.sha is None:
                end.sha = hashlib.sha256(str(conv_id).encode())
            else:
                end.sha.update(f",{conv_id}".encode())

    def _common(self, path: str) -> int:
        """Turns that this path has in common with the one before."""
        if self.path is None:
            return 0
        if path == self.path:
            return len(path) // DIGEST
        n = 0
        while n + DIGEST <= min(len(path), len(self.path)) and path[n:n + DIGEST] == self.path[n:n + DIGEST]:
            n += DIGEST
        return n // DIGEST

    def _pack(self, node: _Open) -> None:
        if node.ids:
            self.out.append({"node": node.name, "piece": self.pieces, "ids": ",".join(node.ids)})
            self.pieces += 1
            node.ids = []

    def _close(self) -> None:
        node = self.stack.pop()
        depth, parent = len(self.stack), self.stack[-1] if self.stack else None
        row = {"node": node.name, "parent": parent.name if parent else None, "done": not node.skeleton, "conv_id": node.least, "depth": depth, "n_convs": node.n}
        if node.skeleton:
            self._pack(node)
            self.out.append({**row, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "bytes": node.bytes})
            return
        leaves, saved = node.leaves + (node.children == 0), node.saved + (node.n - 1) * node.bytes
        row |= {"n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": (node.sha or hashlib.sha256()).hexdigest()}
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        self.out += [{**w, "parent_conv_id": node.least} for w in node.waiting]
        if parent.skeleton:
            self.out.append(row)  # its conv_id is known when the skeleton is
        else:
            parent.waiting.append(row)

    def finish(self) -> None:
        while self.stack:
            self._close()


def _walked(skeleton: frozenset):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Walk(skeleton)
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "conv_id", "bytes"))
            for path, conv_id, sizes in zip(*columns):
                w.add(path, conv_id, sizes)
            yield from _flushed(w.out)
        w.finish()
        yield from _flushed(w.out)

    return walk


def _flushed(out: list[dict]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(out), 10_000):
        yield pa.record_batch([pa.array([r.get(c) for r in out[i:i + 10_000]], t) for c, t in _NODE.items()], names=list(_NODE))
    out.clear()


# --- the skeleton -----------------------------------------------------------------------------------------------

def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from the strings of ids of each node, in order."""
    node, sha, out = None, None, []

    def put():
        return pa.record_batch([pa.array([n for n, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for name, ids in zip(batch.column(batch.schema.get_field_index("node")).to_pylist(), batch.column(batch.schema.get_field_index("ids")).to_pylist()):
            if name != node:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = name, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield put()
            out.clear()
    if node is not None:
        out.append((node, sha.hexdigest()))
    yield put()


def _skeleton_nodes(parts: DataFrame, pieces: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """The skeleton's nodes from the partial figures of the shards: added up by node, then subtrees by the paths
    of the splitters."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    added = parts.groupBy("node", "parent", "depth", "bytes").agg(F.min("conv_id").alias("conv_id"), *sums)
    hashes = pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(_hashed, "node string, ends_sha256 string")
    nodes = staged(added.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "trie-skeleton")
    inner = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("inner"))
    nodes = nodes.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    own = {"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")}
    nodes = staged(nodes.withColumns(own).drop("inner"), "trie-skeleton")
    chains = [_beginnings(path) for path, _ in cuts] or [[ROOT]]
    above = {(name, over) for chain in chains for i, name in enumerate(chain) for over in chain[:i + 1]}
    links = nodes.sparkSession.createDataFrame(sorted(above), "node string, over string")
    risen = nodes.select("node", "n_leaves", "saved_tokens").join(links, "node").groupBy(F.col("over").alias("node"))
    sums = risen.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return nodes.drop("n_leaves", "saved_tokens").join(sums, "node")


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each node of the trie of ``paths`` (conv_id, path, bytes; staged, distinct conv_ids)."""
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(paths, shards)
    skeleton = frozenset({ROOT, *(name for path, _ in cuts for name in _beginnings(path))})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "conv_id")))
            yield pa.record_batch([*batch.columns, pa.array([bisect_right(cuts, k) for k in keys], pa.int32())], names=[*batch.schema.names, "shard"])

    rows = paths.select("conv_id", "path", "bytes").mapInArrow(dealt, "conv_id long, path string, bytes array<long>, shard int")
    rows = rows.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("path", "conv_id")
    nodes = staged(rows.mapInArrow(_walked(skeleton), _NODE_SCHEMA), "trie-nodes")
    top = staged(_skeleton_nodes(nodes.where("not done"), nodes.where("ids is not null").select("node", "piece", "ids"), cuts), "trie-top")
    names = top.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    local = join_checked(nodes.where("done"), names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    upper = join_checked(top, names, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    return local.select(*_COLUMNS).unionByName(upper.select(*_COLUMNS))


def prefix_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(staged(rebuilt_paths(conversations), "trie-rebuilt"), shards)


#: crc32 of ASCII digits by its definition, as a table of 256 steps.
_CRC = """
crc_steps(i, k, c) as (
  select i, 0, i from range(256) t(i) union all select i, k + 1, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) from crc_steps where k < 8
), crc_table as (select list(c order by i) as t from crc_steps where k = 8)"""

ORACLE = f"""
with recursive {_CRC},
turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
  from conversations where conv_id is not null
), own as (
  select conv_id, list(digest order by turn nulls first, role, digest) as digests, list(strlen(text) order by turn nulls first, role, digest) as sizes from turns group by conv_id
), heights as (
  select own.*, conv_id - conv_id % 5 as family,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ord(x) as bigint))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint) % 9 as h
  from own, crc_table
), rebuilt as (
  select a.conv_id, list_concat(coalesce(b.digests, [])[:a.h], a.digests[a.h + 1:]) as path, list_concat(coalesce(b.sizes, [])[:a.h], a.sizes[a.h + 1:]) as sizes
  from heights a left join own b on b.conv_id = a.family
), members as (
  select conv_id, len(path) as len, path, sizes, unnest(range(len(path) + 1)) as depth from rebuilt
), nodes as (
  select array_to_string(path[:depth], '') as name, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(sizes[depth]), 0) as size,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len = depth), '')) as ends_sha256
  from members group by array_to_string(path[:depth], ''), depth
), children as (
  select left(name, length(name) - 32) as name, count(*) as n from nodes where depth > 0 group by 1
), own_sums as (
  select n.*, coalesce(c.n, 0) as n_children, case when c.n is null then 1 else 0 end as leaf, (n_convs - 1) * size as saved from nodes n left join children c using (name)
), subtrees as (
  select left(name, 32 * k) as name, sum(leaf) as n_leaves, sum(saved) as saved_tokens
  from (select name, leaf, saved, unnest(range(depth + 1)) as k from own_sums) group by 1
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from own_sums n join subtrees s using (name) left join nodes p on n.depth > 0 and p.name = left(n.name, length(n.name) - 32)
"""

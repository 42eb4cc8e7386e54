"""G3 dedupe_corpus: the greedy semantic dedupe (G1) for lists too long for one array.

1. Identical docs are collapsed by grouping: the first copy represents the
   group, later copies are always dropped (they are neighbours of whatever the
   first copy is, and share all its neighbours).  Docs without terms (zero
   vectors) match nothing and are kept.
2. Two docs of a session meet in one task exactly once, by blocks of bounded size.  No pair that is below the
   threshold leaves its task.

   * term vectors (``dedupe_corpus_terms``): the most frequent terms of a group
     have a dimension each, the rest share some by the norm of what falls there
     (a product of norms is at least the dot product).  One matrix product
     bounds all cosines of the group; the pairs it leaves add up their counts.
   * dense vectors (``dedupe_corpus``): pivots and the triangle inequality on
     angles.  The vectors nearest to a pivot are multiplied with those whose
     angle to it differs by at most θ from one of theirs.

   Every pair that is left is verified with the exact, unrounded cosine.
3. The sequential walk "keep a doc iff no kept earlier neighbour":

   * term vectors, whose neighbours may be a share of all pairs: a session's blocks are files, walked one after the other;
     all later blocks drop, in parallel, what a walked one's kept docs are near to (``walked_blocks``).  No pair is
     stored at all.
   * dense vectors: every two blocks of a session are one group (``paired_blocks``).  The walk is the
     lexicographically-first maximal independent set of the pairs found; it is reached by rounds: an undecided node
     is kept when no earlier neighbour is kept or undecided, dropped when an earlier neighbour is kept.  After a few
     rounds the open rest is walked by ordered folds over sessions or connected components of bounded size; only
     what is larger goes on by rounds (the first undecided node of every session is decided in each, so they end).
"""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionsift.functions.text import tokens
from sessionsift.operators.components import component_labels
from sessionsift.operators.rank import BROADCAST_ROWS, embed_docs
from sessionsift.session import dealt, materialize, scratch_dir, spread
from sessionsift.sources.stores import store_of

S = "session_id"
#: Slack of the candidate bounds against rounding errors; verification is exact.
EPS = 1e-9


# --------------------------------------------------------------------------- pairs of blocks
#: Docs of a session in one block.
POSTINGS = 16_384
#: Docs of one block that are multiplied with the other at a time.
STRIP = 256


def paired_blocks(items: DataFrame, near) -> DataFrame:
    """``items(session_id, pos, ...)`` -> ``(session_id, a, b, met)``, b < a: the pairs that ``near`` finds.

    ``near(table)`` gets two blocks, or one, as a table and returns a function of (rows, others), two slices of it,
    that yields arrays of the pairs (row, other) above the threshold and how many pairs it has verified for them;
    when the slices overlap, a pair's other has the smaller number.  Rows of one ``pos`` are no pair.  A row
    without a pair tells the number of verified ones for its group."""
    items = items.where(F.col(S).isNotNull() & F.col("pos").isNotNull())
    sizes = materialize(items.groupBy(S).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(S, F.ceil(F.col("n") / POSTINGS).cast("int").alias("__parts")))
    blocks = items.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, S)
    blocks = blocks.withColumn("__own", F.pmod(F.xxhash64("pos"), F.col("__parts")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    blocks = blocks.withColumns({"__lo": F.least("__own", "__other"), "__hi": F.greatest("__own", "__other")}).drop("__parts", "__other")
    kinds = {c: items.schema[c].dataType.simpleString() for c in (S, "pos")}

    def pairs(group: pa.Table) -> pa.Table:
        group = group.take(np.lexsort([group.column(c).to_numpy() for c in ("pos", "__own")]))
        pos, own = (group.column(c).to_numpy() for c in ("pos", "__own"))
        n, first = len(pos), int(np.searchsorted(own, own[-1]))  # where the second block begins, 0: there is one
        alone = group.column("__lo")[0].as_py() == group.column("__hi")[0].as_py()
        a, b, met = [pos[:0]], [pos[:0]], 0
        found = near(group)
        for k in range(0, n if alone else first, STRIP):
            end = min(k + STRIP, n if alone else first)
            for i, j, verified in found(slice(k, end), slice(0, end) if alone else slice(first, n)):
                keep = pos[i] != pos[j]
                a.append(np.maximum(pos[i], pos[j])[keep])
                b.append(np.minimum(pos[i], pos[j])[keep])
                met += verified
        a, b = np.concatenate(a), np.concatenate(b)
        kind = group.schema.field("pos").type
        ends = [pa.concat_arrays([pa.array(x, kind), pa.array([None], kind)]) for x in (a, b)]
        session = pa.array([group.column(S)[0].as_py()] * (len(a) + 1), group.schema.field(S).type)
        return pa.table([session, *ends, pa.array([0] * len(a) + [met], pa.int64())], names=[S, "a", "b", "met"])

    return blocks.groupBy(S, "__lo", "__hi").applyInArrow(pairs, f"{S} {kinds[S]}, a {kinds['pos']}, b {kinds['pos']}, met bigint")


# --------------------------------------------------------------------------- term vectors
#: Dimensions of the bound: one for each of the most frequent terms, the others for the rest.
HEAD, TAIL = 512, 512
#: Slack of the bound, in single precision.
BOUND_EPS = 1e-4


def term_vectors(docs: DataFrame) -> DataFrame:
    """``docs(session_id, pos, text)``, dealt by both keys -> ``(session_id, pos, terms, tfs)`` of the docs with terms;
    a term goes by its 64-bit hash."""
    terms = embed_docs(docs.select(S, "pos", "text")).select(S, "pos", F.xxhash64("term").alias("term"), F.col("tf").cast("int").alias("tf"))
    return terms.groupBy(S, "pos").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))


def near_terms(threshold: float):
    """``near`` of ``paired_blocks`` for ``term_vectors``."""
    def near(group: pa.Table):
        lists, counts = (group.column(c).combine_chunks() for c in ("terms", "tfs"))
        n, sizes = len(lists), np.diff(lists.offsets.to_numpy())
        names, term, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        term, tf, row = term.astype(np.int32), counts.flatten().to_numpy().astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), sizes)
        del lists, counts
        norm = np.sqrt(np.bincount(row, tf.astype(np.int64) ** 2, n))
        shared = df[term] > 1  # what a single doc has adds nothing to any product
        row, term, tf = row[shared], term[shared], tf[shared]
        del shared
        at = HEAD + np.arange(len(names)) % TAIL
        frequent = np.argsort(-df, kind="stable")[:HEAD]
        at[frequent] = np.arange(len(frequent))
        start = np.searchsorted(row, np.arange(n + 1))
        bound = np.zeros((n, HEAD + TAIL), np.float32)
        for k in range(0, n, STRIP):  # by strips: what is added up takes twice the room
            some, rows = slice(start[k], start[min(k + STRIP, n)]), min(k + STRIP, n) - k
            place = (row[some] - k).astype(np.int64) * (HEAD + TAIL) + at[term[some]]
            bound[k:k + rows] = np.sqrt(np.bincount(place, (tf[some] / norm[row[some]]) ** 2, rows * (HEAD + TAIL))).reshape(rows, -1)
        del row

        own = np.zeros(len(names), np.int64)

        def pairs(rows, others, live=None):
            """With ``live``, which may change between two rows, the others are those that are live."""
            which, col = np.nonzero(bound[rows] @ bound[others].T >= threshold - BOUND_EPS)
            col = col + others.start
            for x, r in enumerate(range(rows.start, rows.stop)):
                c = col[np.searchsorted(which, x):np.searchsorted(which, x, "right")]
                c = c[((c < r) | (others.start > r)) & (start[c + 1] > start[c])]
                c = c if live is None else c[live[c]]
                if not len(c):
                    continue
                mine = slice(start[r], start[r + 1])
                own[term[mine]] = tf[mine]
                length = start[c + 1] - start[c]
                first = np.cumsum(length) - length
                place = np.repeat(start[c] - first, length) + np.arange(length.sum())
                dots = np.add.reduceat(own[term[place]] * tf[place].astype(np.int64), first)
                own[term[mine]] = 0
                found = c[dots / (norm[r] * norm[c]) >= threshold]
                yield np.full(len(found), r), found, len(c)
        return pairs
    return near


# --------------------------------------------------------------------------- the walk by blocks
#: Characters of the docs in one block, which bound its terms.
BLOCK_CHARS = 24 << 20
#: Cuts that are sought for each block of the largest session; most tasks of a round.
CUTS, ROUND_TASKS = 4, 10_000


def block_cuts(sizes: DataFrame) -> DataFrame:
    """``sizes(session_id, pos, chars)`` -> ``(session_id, __cuts)``: the last ``pos`` of each block but one, for
    sessions of more than one block."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / POSTINGS), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int")
    large = materialize(sizes.groupBy(S).agg(parts.alias("__parts")).where("__parts > 1"))
    few = large.count() <= BROADCAST_ROWS
    grid = CUTS * (large.agg(F.max("__parts")).first()[0] or 1)
    # approximate places: blocks may differ in size, but every doc has one
    at = F.percentile_approx("pos", [k / grid for k in range(1, grid)] or [0.5], max(10_000, 20 * grid))
    places = sizes.join(F.broadcast(large) if few else large, S).groupBy(S, "__parts").agg(at.alias("__at"))
    picked = F.transform(F.sequence(F.lit(1), F.col("__parts") - 1), lambda k: F.get("__at", F.round(k * grid / F.col("__parts")).cast("int") - 1))
    cuts = materialize(places.select(S, picked.alias("__cuts")))
    return F.broadcast(cuts) if few else cuts


def _stored(file: str, live: bytes | None, columns: list[str] | None = None) -> pa.Table:
    """The live docs of a block."""
    store, at = store_of(file)
    with store.open_input_file(at) as f:
        table = pq.ParquetFile(f).read(columns)
    if live is None:
        return table
    return table.filter(pa.array(np.unpackbits(np.frombuffer(live, np.uint8), count=len(table)).astype(bool)))


def _walk(pairs, first: int, n: int, live: np.ndarray, inner: bool) -> tuple[int, int]:
    """The docs from ``first`` on, in order: one with a live neighbour before ``first`` (``inner``: before itself) is no
    longer live.  Returns the numbers of pairs verified and found."""
    met = near = 0
    for k in range(first, n, STRIP):
        end = min(k + STRIP, n)
        for i, j, verified in pairs(slice(k, end), slice(0, end if inner else first), live):
            met, near = met + verified, near + len(j)
            if len(j):
                live[i[0]] = False
    return met, near


def walked_blocks(vectors: DataFrame, cuts: DataFrame, near) -> tuple[DataFrame, DataFrame, int]:
    """The greedy walk of ``vectors(session_id, pos, ...)`` without its edges: the kept ``(session_id, pos)``, the
    numbers ``(session_id, n, met, near)`` of docs, verified and found pairs, and the number of rounds.

    A session of one block is walked where its docs meet.  A larger one is cut into blocks in ``pos`` order, each written
    once as a file.  In a round every later block reads the block that has just been walked and drops its docs with a
    kept neighbour there; the next block has then met all that are before it and is walked.  So what is stored is the
    vectors and a bit for each doc, and a task holds two blocks, whatever the number of neighbours."""
    folder = scratch_dir(vectors.sparkSession, "blocks")
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (S, "pos")}
    state_schema = f"{S} {kinds[S]}, block int, file string, live binary, n bigint, met bigint, near bigint"

    def begun(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group.column("pos").to_numpy(), kind="stable"))
        n, pos = len(group), group.column("pos").combine_chunks()
        session, block = group.column(S)[0].as_py(), group.column("__block")[0].as_py()
        if group.column("__large")[0].as_py():
            file = f"{folder}/{uuid.uuid4().hex}.parquet"
            store, at = store_of(file)
            store.create_dir(posixpath.dirname(at), recursive=True)
            with store.open_output_stream(at) as f:  # a block's terms come again and again: one dictionary
                pq.write_table(group.drop_columns([S, "__block", "__large"]), f, row_group_size=n, compression="zstd", dictionary_pagesize_limit=64 << 20)
            pos, told = pos.slice(0, 0), [block, file, np.packbits(np.ones(n, bool)).tobytes(), n, 0, 0]
        else:
            live = np.ones(n, bool)
            told = [None, None, None, n, *_walk(near(group), 0, n, live, True)]
            pos = pos.filter(pa.array(live))
        out = pa.schema([(S, group.schema.field(S).type), ("pos", pos.type), ("block", pa.int32()), ("file", pa.string()), ("live", pa.binary()), *((c, pa.int64()) for c in ("n", "met", "near"))])
        columns = [[session] * (len(pos) + 1), pa.concat_arrays([pos, pa.array([None], pos.type)]), *([None] * len(pos) + [v] for v in told)]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, out.types)], schema=out)

    def step(k: int):
        def one(row: dict) -> dict:
            front, front_live = row.pop("front"), row.pop("front_live")
            if row["block"] < k or row["block"] > k and not front:
                return row
            mine = _stored(row["file"], row["live"])
            before = _stored(front, front_live) if front else mine.slice(0, 0)
            first, both = len(before), pa.concat_tables([before, mine]).combine_chunks()
            live = np.ones(len(both), bool)
            if len(mine):
                met, found = _walk(near(both), first, len(both), live, row["block"] == k)
                row["met"], row["near"] = row["met"] + met, row["near"] + found
            bits = np.unpackbits(np.frombuffer(row["live"], np.uint8), count=row["n"])
            bits[np.flatnonzero(bits)] = live[first:]
            return row | {"live": np.packbits(bits).tobytes()}

        def steps(batches):
            for batch in batches:
                schema = pa.schema([f for f in batch.schema if f.name not in ("front", "front_live")])
                for row in batch.to_pylist():
                    yield pa.RecordBatch.from_pylist([one(row)], schema)
        return steps

    def positions(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pos = _stored(row["file"], row["live"], ["pos"]).column("pos").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([row[S]] * len(pos), batch.schema.field(S).type), pos], names=[S, "pos"])

    placed = vectors.join(cuts, S, "left").withColumns({
        "__large": F.col("__cuts").isNotNull(), "__block": F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("pos"))), F.lit(0))})
    rows = materialize(placed.drop("__cuts").groupBy(S, "__block").applyInArrow(begun, f"{S} {kinds[S]}, pos {kinds['pos']}, {state_schema.split(', ', 1)[1]}"))
    kept = rows.where("pos IS NOT NULL").select(S, "pos")
    state = rows.where("file IS NOT NULL").drop("pos")
    blocks, last = state.agg(F.count(F.lit(1)), F.max("block")).first()
    # one partition first: its rows are then dealt evenly, a block to a task
    alone = lambda df: df.coalesce(1).repartition(min(blocks, ROUND_TASKS))
    for k in range((last or 0) + 1 if blocks else 0):
        # by a window: joined with itself, the estimated size would be squared in every round
        front = lambda c: F.max(F.when(F.col("block") == k - 1, F.col(c))).over(Window.partitionBy(S))
        state = materialize(alone(state.withColumns({"front": front("file"), "front_live": front("live")})).mapInArrow(step(k), state_schema))
    numbers = rows.where("pos IS NULL AND file IS NULL").select(S, "n", "met", "near").unionByName(state.select(S, "n", "met", "near"))
    if blocks:
        kept = kept.unionByName(alone(state).mapInArrow(positions, f"{S} {kinds[S]}, pos {kinds['pos']}"))
    return kept, numbers, (last or 0) + 1 if blocks else 0


def dedupe_corpus_terms(docs: DataFrame, threshold: float, report: dict | None = None) -> DataFrame:
    """G3 on term counts: ``docs(session_id, pos, text)`` in ``pos`` order -> kept ``(session_id, pos)``.

    ``report``, if given, gets the numbers of texts, pairs in all, candidates (pairs with a kept doc that the bound
    leaves), verified pairs and rounds."""
    docs = spread(docs, S, "pos")
    # a digest of the text, not the text, groups the copies
    first = docs.groupBy(S, F.sha2("text", 256).alias("__h")).agg(F.min("pos").alias("pos"), F.max(F.length("text")).alias("chars"))
    first = materialize(first.where(F.col(S).isNotNull() & F.col("pos").isNotNull()).groupBy(S, "pos").agg(F.sum("chars").alias("chars")))
    # dealt by the keys of a doc, so that counting its terms deals nothing again
    texts = dealt(docs.select(S, "pos", "text"), S, "pos").join(first.select(S, "pos").hint("shuffle_hash"), [S, "pos"], "left_semi")
    kept, numbers, rounds = walked_blocks(term_vectors(texts), block_cuts(first), near_terms(threshold))
    if report is not None:
        sizes = numbers.groupBy(S).agg(*(F.sum(c).alias(c) for c in ("n", "met", "near")))
        n = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("p"), F.sum("met").alias("met"), F.sum("near").alias("near")).first()
        report.update(texts=n["n"], pairs=n["p"], candidates=n["met"], verified=n["near"], rounds=rounds)
    worded = docs.where(F.size(tokens(F.col("text"))) > 0).select(S, "pos")
    wordless = docs.select(S, "pos").join(worded.distinct(), [S, "pos"], "left_anti")
    return kept.unionByName(wordless)


# --------------------------------------------------------------------------- dense vectors
#: Pairs that are verified at a time.
VERIFIED = 1 << 17


def exact_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``dense_cosine`` of rows, added up in the same order."""
    dot, xx, yy = (np.zeros(len(x)) for _ in range(3))
    with np.errstate(all="ignore"):
        for k in range(x.shape[1]):
            dot, xx, yy = dot + x[:, k] * y[:, k], xx + x[:, k] * x[:, k], yy + y[:, k] * y[:, k]
        return dot / (np.sqrt(xx) * np.sqrt(yy))


def near_vectors(threshold: float, pivots: int = 32):
    """``near`` of ``paired_blocks`` for ``(session_id, pos, vec)``, no zero vectors."""
    theta = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def near(group: pa.Table):
        lists = group.column("vec").combine_chunks()
        start, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        start = start - start[0]
        sizes = np.diff(start)
        alike = {}
        for d in np.unique(sizes):  # vectors of one length
            at = np.flatnonzero(sizes == d)
            x = flat[start[at][:, None] + np.arange(d)]
            with np.errstate(all="ignore"):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                odd = ~np.isfinite(unit).all(axis=1)
                base = unit[~odd][:pivots]
                angle = np.arccos(np.clip(unit @ base.T, -1, 1))
            home = np.where(odd, -1, angle.argmin(axis=1) if len(base) else -1)
            alike[d] = at, x, unit, odd, angle, home

        def pairs(rows, others):
            for at, x, unit, odd, angle, home in alike.values():
                mine, theirs = (slice(*np.searchsorted(at, [s.start, s.stop])) for s in (rows, others))
                for p in np.unique(home[mine]):
                    i = mine.start + np.flatnonzero(home[mine] == p)
                    j = np.arange(theirs.start, theirs.stop)
                    if p >= 0:
                        far = (angle[j, p] < angle[i, p].min() - theta) | (angle[j, p] > angle[i, p].max() + theta)
                        j = j[odd[j] | ~far]
                    with np.errstate(all="ignore"):
                        # not below for sure; what is not a number is decided as Spark does
                        k, m = np.nonzero(~(unit[i] @ unit[j].T < threshold - EPS))
                    i, j = i[k], j[m]
                    once = (j < i) | (others.start >= rows.stop)
                    i, j = i[once], j[once]
                    for q in range(0, len(i), VERIFIED):
                        a, b = i[q:q + VERIFIED], j[q:q + VERIFIED]
                        edge = ~(exact_cosines(x[a], x[b]) < threshold)
                        yield at[a[edge]], at[b[edge]], len(a)
        return pairs
    return near


def dedupe_corpus(items: DataFrame, threshold: float, pivots: int = 32) -> DataFrame:
    """G3 on dense vectors: ``items(session_id, pos, vec array<double>)`` -> kept ``(session_id, pos)``."""
    nz = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v) > 0
    # A partial aggregate, so a hot group of copies is pre-reduced before the shuffle.
    reps = materialize(items.where(nz).groupBy(S, "vec").agg(F.min("pos").alias("pos")).select(S, "pos", "vec"))
    met = materialize(paired_blocks(reps, near_vectors(threshold, pivots)))
    edges = met.where("a IS NOT NULL").select(S, "a", "b")
    kept = greedy_fixpoint(reps.select(S, "pos"), edges)
    return kept.unionByName(items.where(~nz).select(S, "pos"))


# --------------------------------------------------------------------------- the walk
#: Rounds over all nodes before the walk goes on by fold; most edges that one fold reads (three numbers each).
PLAIN_ROUNDS, FOLD_EDGES = 2, 500_000


def _round(status: DataFrame, edges: DataFrame) -> DataFrame:
    """One parallel step: undecided nodes with a kept earlier neighbour go, those without an undecided one stay."""
    nb = (edges.join(status.select(S, F.col("pos").alias("b"), F.col("st").alias("bst")), [S, "b"])
          .groupBy(S, F.col("a").alias("pos"))
          .agg(F.max(F.col("bst") == "K").alias("any_k"), F.max(F.col("bst") == "U").alias("any_u")))
    return (status.join(nb, [S, "pos"], "left")
            .select(S, "pos", F.when(F.col("st") != "U", F.col("st"))
                    .when(F.coalesce("any_k", F.lit(False)), F.lit("D"))
                    .when(~F.coalesce("any_u", F.lit(False)), F.lit("K"))
                    .otherwise(F.lit("U")).alias("st")))


def _folded(edges: DataFrame, *keys: str) -> DataFrame:
    """``(session_id, pos, fst)``: the sequential walk over the nodes of each group of ``edges``."""
    def fold(group: pa.Table) -> pa.Table:
        a, b = (group.column(c).to_numpy() for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        nodes = np.unique(np.concatenate([a, b]))
        starts, ends = np.searchsorted(a, nodes, "left"), np.searchsorted(a, nodes, "right")
        near = np.searchsorted(nodes, b)
        kept = np.zeros(len(nodes), dtype=bool)
        for i, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist())):
            kept[i] = not kept[near[lo:hi]].any()
        session = pa.array([group.column(S)[0].as_py()] * len(nodes), group.schema.field(S).type)
        return pa.table([session, pa.array(nodes, pa.int64()), pa.array(np.where(kept, "K", "D"))], names=[S, "pos", "fst"])

    kind = edges.schema[S].dataType.simpleString()
    return edges.groupBy(*keys).applyInArrow(fold, f"{S} {kind}, pos bigint, fst string")


def greedy_fixpoint(nodes: DataFrame, edges: DataFrame, undecided: list[int] | None = None) -> DataFrame:
    """The greedy walk; ``nodes(session_id, pos)``, ``edges(session_id, a, b)`` with b < a.

    A few parallel rounds decide most nodes.  What is open then is walked in order: a session with at most
    ``FOLD_EDGES`` open edges in one fold, a larger one by its connected components; only components beyond
    that bound go on by rounds.  So a long chain of neighbours costs no round for each of its links.
    ``undecided``, if given, gets the number of undecided nodes before each round."""
    def left(status: DataFrame) -> int:
        n = status.where(F.col("st") == "U").count()
        if n and undecided is not None:
            undecided.append(n)
        return n

    def open_edges(status: DataFrame) -> DataFrame:
        open_nodes = status.where(F.col("st") == "U").select(S, "pos")
        return edges.join(open_nodes.withColumnRenamed("pos", "a"), [S, "a"], "left_semi").join(open_nodes.withColumnRenamed("pos", "b"), [S, "b"], "left_semi")

    def with_folds(status: DataFrame, folds: DataFrame) -> DataFrame:
        joined = status.join(folds, [S, "pos"], "left")
        return materialize(joined.select(S, "pos", F.when(F.col("st") == "U", F.coalesce("fst", "st")).otherwise(F.col("st")).alias("st")))

    status = materialize(nodes.select(S, "pos", F.lit("U").alias("st")))
    for _ in range(PLAIN_ROUNDS):
        if not left(status):
            return status.where(F.col("st") == "K").select(S, "pos")
        status = materialize(_round(status, edges))
    if left(status):
        rest = materialize(open_edges(status))
        sizes = materialize(rest.groupBy(S).count())
        status = with_folds(status, _folded(rest.join(sizes.where(F.col("count") <= FOLD_EDGES), S, "left_semi"), S))
        large = sizes.where(F.col("count") > FOLD_EDGES)
        if not large.isEmpty():
            rest = rest.join(large, S, "left_semi")
            labels = component_labels(rest, [S]).select(S, F.col("node").alias("a"), "label")
            rest = materialize(rest.join(labels, [S, "a"]))
            fit = rest.groupBy(S, "label").count().where(F.col("count") <= FOLD_EDGES)
            status = with_folds(status, _folded(rest.join(fit, [S, "label"], "left_semi"), S, "label"))
        while left(status):
            status = materialize(_round(status, edges))
    return status.where(F.col("st") == "K").select(S, "pos")

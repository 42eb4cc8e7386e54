import random

import numpy as np

from sessionsift.operators.corpus import dedupe_corpus


def brute(vecs, thr):
    kept = []
    for i, v in enumerate(vecs):
        ok = True
        for j in kept:
            w = vecs[j]
            c = float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
            if c >= thr:
                ok = False
                break
        if ok:
            kept.append(i)
    return kept


def test_dedupe_corpus_matches_sequential_walk(spark, df):
    rnd = random.Random(5)
    base = [np.array([rnd.gauss(0, 1) for _ in range(8)]) for _ in range(6)]
    vecs = []
    for i in range(60):
        b = base[i % 6]
        vecs.append(b + np.array([rnd.gauss(0, 0.4) for _ in range(8)]))
    vecs.append(vecs[3].copy())  # an exact copy
    rows = [("g", i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    d = df(rows, "session_id string, pos long, vec array<double>")
    got = sorted(r.pos for r in dedupe_corpus(d, 0.9, pivots=8).collect())
    assert got == brute(vecs, 0.9)


def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path):
    """A table of several files: every drop is one micro-batch, complete, and the next one is newer."""
    from sessionsift.streaming.windows import events_stream
    spark.range(40_000).withColumnRenamed("id", "event_id").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    q = events_stream(spark, str(tmp_path), late=False).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [8_000] * 5
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 40_000

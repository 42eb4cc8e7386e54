"""A1 from growing files: appended bytes only, line numbers of a fresh batch read."""
import random

import pytest

from sessionsift.sources import growing as G
from sessionsift.sources.transcripts import read_transcripts


def rows(df):
    return sorted((r.session_id or "", r.line_no, r.raw) for r in df.select("session_id", "line_no", "raw").collect())


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_runs_between_appends_equal_a_fresh_read(spark, tmp_path, chunk):
    rnd, root, store = random.Random(chunk), tmp_path / "in", str(tmp_path / "store")
    (root / "session_id=odd%2Fname").mkdir(parents=True)
    files = [root / "a.jsonl", root / "b.part.jsonl", root / "session_id=odd%2Fname" / "part-0.txt"]
    read = []
    for step in range(4):
        for f in files[:step + 1]:
            with f.open("ab") as out:
                for k in range(rnd.randrange(1, 9)):
                    out.write(rnd.choice([b"", b"  ", b'{"n":%d}' % k, "é\U0001f600 ".encode() * rnd.randrange(9), b"\xff bad", b"x" * rnd.randrange(90)]) + b"\n")
        got = rows(G.follow_transcripts(spark, str(root), store, chunkBytes=chunk))
        assert got == rows(read_transcripts(spark, str(root)))
        read.append(spark.read.parquet(f"{store}/lines").count())
    assert read == sorted(set(read)) and read[-1] == sum(f.read_bytes().count(b"\n") for f in files)  # every line once
    assert rows(G.numbered_lines(G.read_whole(spark, str(root), chunkBytes=chunk))) == got


def test_a_line_without_its_end_waits(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    f = root / "s.jsonl"
    f.write_text('{"a":1}\n{"b"')
    assert [r[1:] for r in rows(G.follow_transcripts(spark, str(root), store))] == [(1, '{"a":1}')]
    assert rows(G.follow_transcripts(spark, str(root), store)) == [("s", 1, '{"a":1}')]  # nothing new: no batch
    with f.open("a") as out:
        out.write(":2}\n")
    assert rows(G.follow_transcripts(spark, str(root), store)) == [("s", 1, '{"a":1}'), ("s", 2, '{"b":2}')]


def test_a_file_that_shrinks_stops_the_stream(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    (root / "s.jsonl").write_text("1\n2\n3\n")
    G.follow_transcripts(spark, str(root), store)
    (root / "s.jsonl").write_text("1\n")
    with pytest.raises(Exception, match="shorter"):
        G.follow_transcripts(spark, str(root), store)


def test_sessions_of_files():
    assert G.session_of("/x/session_id=a%2Fb/part-1.txt") == "a/b" and G.session_of("/x/session_id=__HIVE_DEFAULT_PARTITION__/p") is None
    assert G.session_of("/x/abc.def.jsonl") == "abc.def" and G.session_of("/x/.hidden") == ".hidden"


def test_small_files_share_tasks(tmp_path):
    for k in range(300):
        (tmp_path / f"s{k:03d}.jsonl").write_text("{}\n" * (k % 5 + 1))
    (tmp_path / "t.jsonl").write_text("{}\n" * 5_000_000)
    stream = G.GrowingStream({"path": str(tmp_path), "chunkbytes": str(6 << 20)})
    tasks = stream.partitions({}, stream.latestOffset())
    assert len(tasks) < 10  # 303 chunks
    chunks = [c for t in tasks for c in t.chunks]
    assert sum(c.end - c.begin for c in chunks) == sum(f.stat().st_size for f in tmp_path.iterdir())
    assert max(sum(c.end - c.begin for c in t.chunks) for t in tasks) <= 6 << 20
    few = [b for t in stream.partitions({}, {f: 9 for f in stream.latestOffset()}) for b in stream.read(t)]
    assert sum(b.num_rows for b in few) == 300 // 5 * (1 + 2 + 3 + 3 + 3) + 3 and len(few) < 10


def test_offsets_and_tasks_stay_small(spark, tmp_path):
    """what the driver keeps of a run doesn't grow with the number of files; the chunks are the same."""
    import json
    import pickle
    root, kept = tmp_path / "in", str(tmp_path / "kept")
    for k in range(700):
        d = root / f"session_id={k % 350}" / ("more" if k >= 350 else ".")
        d.mkdir(parents=True, exist_ok=True)
        (d / f"part-{k}.txt").write_text("{}\n" * (k % 9) + "no end")
    (root / "_hidden").mkdir()
    (root / "_hidden" / "x.txt").write_text("{}\n")
    listed, stored = (G.GrowingStream({"path": str(root), "chunkbytes": "7", **more}) for more in ({}, {"offsets": kept}))
    ends, name = listed.latestOffset(), stored.latestOffset()
    assert len(ends) == 700 - 78 and len(json.dumps(name)) < 100
    assert stored.latestOffset() == name and G.GrowingStream({"path": str(root), "offsets": kept}).latestOffset() == name
    pieces = lambda s, tasks: [(c.file, c.begin, c.end, c.fresh) for t in tasks for c in s.files.chunks(t)]
    want, planned = listed.partitions({}, ends), stored.partitions({}, name)
    assert pieces(stored, planned) == pieces(listed, want) and len(planned) == len(want)
    assert sum(len(pickle.dumps(t)) for t in planned) < 500 * len(planned) < 10_000
    assert pieces(stored, stored.partitions(ends, name)) == []  # an offset of the other kind
    assert stored.partitions(name, name) == []
    longer = root / "session_id=0" / "part-0.txt"
    longer.write_text("{}\n" * 5)
    after = stored.latestOffset()
    assert after != name and pieces(stored, stored.partitions(name, after)) == pieces(listed, listed.partitions(ends, listed.latestOffset()))
    with pytest.raises(ValueError, match="shorter"):
        stored.partitions({str(longer): 99}, after)
    assert G.task_bytes(1) == G.TASK_BYTES and G.task_bytes(1 << 50) == G.CHUNK_BYTES


def test_a_run_names_its_ends(spark, tmp_path):
    """the offset in the checkpoint is a name, whatever the number of files."""
    root, store = tmp_path / "in", tmp_path / "store"
    root.mkdir()
    for k in range(200):
        (root / f"s{k}.jsonl").write_text("{}\n")
    assert G.follow_transcripts(spark, str(root), str(store)).count() == 200
    assert (store / "checkpoint" / "offsets" / "0").stat().st_size < 2000

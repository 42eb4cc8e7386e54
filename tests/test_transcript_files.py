"""A1's files: one for each session put in place by the tasks, read back in one scan."""
from sessionsift.sources.transcripts import read_transcripts, write_transcripts

LINES = "session_id string, line_no long, raw string"


def test_a_file_for_each_session_under_any_name(spark, df, tmp_path):
    root = str(tmp_path / "t")
    names = ["a", "b/c %=+{x}", "..", "", None]
    rows = [(n, 7 * k, f"{k} of {n}" if k % 5 else None) for n in names for k in range(9, 0, -1)] + [("a", 3, "two\nlines")]
    old = df([("gone", 1, "x")] + rows[:3], LINES)
    write_transcripts(old, root)
    write_transcripts(df(rows, LINES).repartition(3), root)
    files = sorted(p.relative_to(root).as_posix() for p in (tmp_path / "t").rglob("*") if p.is_file())
    assert files == ["_SUCCESS", "session_id=../part-0.txt", "session_id=__HIVE_DEFAULT_PARTITION__/part-0.txt",
                     "session_id=__HIVE_DEFAULT_PARTITION__/part-1.txt", "session_id=a/part-0.txt", "session_id=b%2Fc %25%3D+%7Bx}/part-0.txt"]
    got = sorted((r.session_id or "", r.line_no, r.raw) for r in read_transcripts(spark, root).collect())
    want = [(n or "", k, f"{k} of {n}") for n in names[1:] for k in range(1, 10) if k % 5]
    want += [("a", 1, "two"), ("a", 2, "lines")] + [("a", k + 2, f"{k} of a") for k in range(1, 10) if k % 5]
    assert got == sorted(want)


def test_a_session_of_several_record_batches(spark, tmp_path):
    root = str(tmp_path / "t")
    write_transcripts(spark.range(50_000).selectExpr("if(id % 9 = 0, 's', 'long') session_id", "-id line_no", "cast(id as string) raw"), root)
    got = read_transcripts(spark, root).collect()
    want = {s: [i for i in range(49_999, -1, -1) if (i % 9 == 0) == (s == "s")] for s in ("s", "long")}
    assert len(got) == 50_000 and all(int(r.raw) == want[r.session_id][r.line_no - 1] for r in got)


def test_no_sessions(spark, df, tmp_path):
    write_transcripts(df([], LINES), str(tmp_path / "t"))
    assert read_transcripts(spark, str(tmp_path / "t")).count() == 0


def test_files_are_read_once(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "s.jsonl").write_text("1\n\n2\n")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with lines that are too many
    try:
        read = read_transcripts(spark, str(root))
        assert sorted((r.line_no, r.raw) for r in read.collect()) == [(1, "1"), (3, "2")]
        plan = read._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan

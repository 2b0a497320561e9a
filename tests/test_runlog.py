import pytest
from pyspark.sql import functions as F

from pairlight.operators import provenance
from pairlight.sources import files
from pairlight.streaming import runlog


def test_torn_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"i":1}\n{"i":2}\n{"i":')
    (tmp_path / "b.jsonl").write_bytes(b'{"i":3}\n')
    rows = {r.file: r for r in runlog.torn_tails(spark, str(tmp_path)).collect()}
    assert (rows["a.jsonl"].complete_lines, rows["a.jsonl"].tail_hex) == (2, b'{"i":'.hex())
    assert (rows["b.jsonl"].complete_lines, rows["b.jsonl"].tail_bytes) == (1, 0)
    assert sorted(r.i for r in runlog.recovered(spark, str(tmp_path), "i int").collect()) == [1, 2, 3]


def test_a_damaged_whole_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"i":1}\n{"i":\n')
    with pytest.raises(Exception, match="damaged record"):
        runlog.recovered(spark, str(tmp_path), "i int").collect()


def test_resume(spark):
    cases = spark.range(6).selectExpr("concat('c', id) as case_id", "id as ordinal")
    done = cases.where("ordinal < 2")
    assert [r.ordinal for r in runlog.remainder(cases, done, "case_id", 3).collect()] == [2, 3, 4]
    assert runlog.valid_prefix(cases, done, "case_id").first().prefix
    assert not runlog.valid_prefix(cases, cases.where("ordinal = 1"), "case_id").first().prefix


def test_streaming_append_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for n, want in ((2, 2), (1, 3), (0, 3)):
        if n:
            spark.range(n).coalesce(1).write.mode("append").parquet(src)
        runlog.append_available(spark.readStream.schema("id long").parquet(src), out, mark)
        assert spark.read.parquet(out).count() == want


def test_single_writer(spark):
    for _ in range(2):  # the second time over, the first is gone
        with runlog.single_writer(spark, "a-run"), pytest.raises(ValueError, match="being written"), runlog.single_writer(spark, "a-run"):
            pass


def test_a_run_is_written_in_sealed_parts(spark, tmp_path):
    cases, out = spark.range(7).selectExpr("concat('c', id) as case_id", "id as ordinal", "concat('p', id) as prompt"), str(tmp_path / "run")
    assert runlog.write_run(cases, out, "case_id", 3, limit=4) == ("checkpoint", 2) and spark.read.parquet(out).count() == 4
    assert runlog.write_run(cases, out, "case_id", 3, stop=lambda: True) == ("cancelled", 2)
    assert runlog.write_run(cases, out, "case_id", 3, started=0.0, budget=10.0, clock=lambda: 11.0) == ("budget_exhausted", 2)
    with pytest.raises(ValueError, match="break a rule"):
        runlog.write_run(cases, out, "case_id", 3, rules={"none": F.col("output_tokens") < 0})
    assert spark.read.parquet(out).count() == 4
    assert runlog.write_run(cases, out, "case_id", 3) == ("complete", 0) == runlog.write_run(cases, out, "case_id", 3)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.ordinal for r in rows) == list(range(7)) and len({r.record_sha256 for r in rows}) == 7


def test_provenance(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path = str(tmp_path / "in")
    assert provenance.materialise(df, path, False).count() == provenance.materialise(df, path, True).count() == 2
    with pytest.raises(ValueError, match="differ"):
        provenance.materialise(df.limit(1), path, True)
    provenance.write_session(spark, str(tmp_path), 2, "complete", 3, provenance.environment(spark))
    provenance.write_session(spark, str(tmp_path), 1, "checkpoint", 1, {})
    assert [(r.state, r.file) for r in provenance.sessions(spark, str(tmp_path), "state string, records int").collect()] == [("checkpoint", "session-1.json"), ("complete", "session-2.json")]
    provenance.print_result(df.where("k = 1"))
    assert capsys.readouterr().out == '{"k":1,"v":"a"}\n'


def test_run_states():
    assert runlog.run_state(3, 3) == ("complete", 0) and runlog.run_state(1, 3) == ("checkpoint", 2)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "b int, a string")
    files.write_jsonl(df.coalesce(1), str(tmp_path / "o"))
    back = files.read_jsonl(spark, str(tmp_path / "o"), "b int, a string")
    assert tuple(files.same_rows(df, back).first()) == (0, 0)
    files.write_json(spark, str(tmp_path / "d.json"), {"x": 1})
    assert files.read_json(spark, str(tmp_path / "d.json"), "x int").first().x == 1
    stats = {r.name: r for r in files.file_stats(spark, str(tmp_path / "d.json")).collect()}
    assert stats["d.json"].ends_with_newline and "| b |" in files.report(df.select("b")).replace("b |\n", "b |")

from pairlight.sources import files


def test_a_report_of_all_sections(spark):
    rows = spark.createDataFrame(
        [("clean", "add", True, 0.0, 0.0, True, False, 10), ("clean", "add", None, 0.0, 0.0, True, False, 20), ("typo", "mul", False, 0.5, 0.25, False, True, None), ("typo", None, True, 1.0, None, False, True, 30)],
        "condition string, family string, correct boolean, eligible_word_rate double, all_word_rate double, unchanged boolean, possible_meaning_change boolean, input_tokens int",
    )
    sessions = spark.createDataFrame([(1.5, 10), (2.0, None)], "wall_seconds double, peak_process_rss_kib long")
    assert sorted(map(tuple, files.families(rows, ["add", "mul"]).collect())) == [("clean", "1/2", "0/0"), ("typo", "0/0", "0/1")]
    assert sorted(map(tuple, files.realized(rows).collect())) == [("clean", 0.0, 0.0, "2/2", "0/2", 15.0), ("typo", 0.75, 0.25, "0/2", "2/2", 30.0)]
    assert tuple(files.runtime(sessions).first()) == (2, 3.5, 10)
    assert tuple(files.runtime(sessions.where("false")).first()) == (0, 0.0, None)
    text = files.report(rows.select("condition").distinct(), "Audit", {"Families": files.families(rows, ["add", "mul"]), "Runtime": files.runtime(sessions)})
    assert text == "# Audit\n\n| condition |\n|---|\n| clean |\n| typo |\n\n## Families\n\n| condition | add | mul |\n|---|---|---|\n| clean | 1/2 | 0/0 |\n| typo | 0/0 | 0/1 |\n\n## Runtime\n\n| sessions | wall_seconds | peak_process_rss_kib |\n|---|---|---|\n| 2 | 3.5000 | 10 |\n"
    assert "a\\|b" in files.markdown(spark.createDataFrame([("a|b",)], "x string"))

"""The table of checks as one run."""

from galleyproof.operators import findings as N
from galleyproof.plans import registry
from galleyproof.sources import trees

COLUMNS = "path string, ext string, is_test boolean, content string"
FINDING = "severity int, file string, line long, seq long, analyzer_id string, message string"


def files(spark, *rows):
    return spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1], p.endswith("_test.go"), c) for p, c in rows], COLUMNS)


def test_go_checks_see_test_files(spark):
    body = "package a\n\nimport (\n\t\"testing\"\n\t\"time\"\n)\n\nfunc TestWait(t *testing.T) {\n\ttime.Sleep(time.Second)\n}\n"
    out = registry.run(files(spark, ("wait_test.go", body))).collect()
    assert [(r.analyzer_id, r.file, r.line) for r in out] == [("time-discipline", "wait_test.go", 9)]


def test_rows_of_a_line_keep_their_place(spark):
    out = registry.run(files(spark, ("a.md", "x\u200by\u2060z\u200b\n"))).collect()
    assert [r.message.split(" (")[0] for r in out] == ["zero width space", "word joiner", "zero width space"]
    assert len({r.seq for r in out}) == 3


def test_severity_parameter_and_rules(spark):
    made = files(spark, ("a.md", "x\u200by\n"))
    config = {"text-markers": {"params": {"severity": "info"}}}
    rules = spark.createDataFrame([("ai-attribution", "s"), ("text-hygiene", "s")], "id string, summary string")
    out = registry.run(made, config=config, rules=rules).collect()
    assert [r.severity for r in out] == [0] and {"rule_id", "rule_summary"} <= set(out[0].asDict())
    assert registry.run(made, scope="none", rules=rules).count() == 0


def test_neighbours_of_two_severities_are_one(spark):
    rows = [(2, "f", 1, 1, "a", "m"), (1, "f", 1, 2, "a", "m"), (1, "f", 1, 3, "a", "m"), (1, "f", 2, 4, "a", "m"), (0, "f", 1, 5, "a", "m")]
    out = N.ordered(N.dedupe_adjacent(spark.createDataFrame(rows, FINDING))).collect()
    assert [(r.severity, r.line) for r in out] == [(2, 1), (1, 2), (0, 1)]


def test_a_root_with_signs_of_patterns(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "x.go").write_text("package x\n")
    assert [r.path for r in trees.read_tree(spark, str(root)).collect()] == ["sub/x.go"]

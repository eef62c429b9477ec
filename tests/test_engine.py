import zipfile

from galleyproof.functions import text as X
from galleyproof.operators import files as O
from galleyproof.operators import graph as G
from galleyproof.operators.knowledge import list_selection
from galleyproof.plans import registry
from galleyproof.sources import sinks, trees
from pyspark.sql import functions as F


def files(spark, *rows):
    return spark.createDataFrame([(p, "." + p.rsplit(".", 1)[-1], p.endswith("_test.go"), c) for p, c in rows], "path string, ext string, is_test boolean, content string")


def test_mark_cases(spark):
    cases = [("a​b", 0), ("a b", 1), ("a‍b", 0), ("‍b", 2), ("a‍", 2), ("\U0001f468‍\U0001f469", 2), ("x️", 2), ("", 2), ("—", 3), ("…", 3), ("\n‌\n", 0), ("a\x7f‍b", 2)]
    df = files(spark, *[(f"{i}.md", c) for i, (c, _) in enumerate(cases)], ("plain.md", "plain"), ("none.md", None))
    got = {r.path: r.mark_class for r in O.mark_scan(df).collect()}
    assert got == {f"{i}.md": k for i, (_, k) in enumerate(cases)}


def test_clean_is_idempotent_and_leaves_no_strip_or_space(spark, tmp_path):
    df = files(spark, ("a.md", "x​y z—‍"), ("b.go", "﻿d‍e‍ f️"), ("t/testdata/c.go", "​"), ("n.txt", "​"))
    once = df.withColumn("content", X.clean(F.col("content")))
    assert [r.content for r in once.collect()] == [r.c for r in once.select(X.clean(F.col("content")).alias("c")).collect()]
    assert sinks.write_cleaned(df, f"{tmp_path}/c").count() == 0
    assert sorted(r.path for r in spark.read.parquet(f"{tmp_path}/c").collect()) == ["a.md", "b.go"]


def test_golden_cases(spark):
    marker = "---\ntitle: x\ngenerator: y\n---\n\n\nz​—\n"
    out = registry.run(files(spark, ("m.md", marker), ("ok/a.go", "package a\n")))
    assert [(r.analyzer_id, r.line) for r in out.filter("not suppressed").orderBy("line", "analyzer_id").collect()] == [("ai-frontmatter", 3), ("text-markers", 7), ("typographic-markers", 7)]
    made = files(spark, ("gen.go", "// Code generated by x. DO NOT EDIT.\npackage a\n// —\n"))
    assert [r.suppressed for r in registry.run(made).filter("analyzer_id = 'typographic-markers'").collect()] == [True]
    assert not [r for r in registry.run(made, include_generated=True).collect() if r.suppressed]
    assert registry.run(made, scope="none").count() == 0
    assert {s.id for s in registry.selected(registry.FULL, registry.effective("minimal"))}.isdisjoint({"file-size", "big-comment"})


def test_generated_marker_positions(spark):
    mark = "// Code generated by x. DO NOT EDIT."
    cases = [(f"{mark}\npackage a", True), (f"package a\n{mark}", False), (f"/*\n{mark}\n*/\npackage a", False), (f"/* c */\n{mark}\npackage a", True), ("", False)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", X.is_generated(F.col("c")).alias("g")).collect()
    assert [r.g for r in sorted(rows)] == [g for _, g in cases]


def test_cycles(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("s", "x", "x"), ("t", "p", "q")], "repo string, src string, dst string")
    assert {(r.repo, r.cycle) for r in G.cycle_listing(e).collect()} == {("r", "a → b → c → a"), ("s", "x → x")}


def test_hash_and_parameters(spark):
    r = spark.range(1).select(X.fnv1a(F.lit("abc")).alias("h"), X.fnv1a(F.lit("")).alias("e"), X.param_int(F.lit("180.0"), 5).alias("a"), X.param_int(F.lit(" 7"), 5).alias("b"), X.param_int(F.lit("-1"), 5).alias("c"), X.param_bool(F.lit("T"), False).alias("d")).first()
    assert tuple(r) == (440920331, 2166136261, 180, 5, 5, True)


def test_tree_archive_and_selection(spark, tmp_path):
    for name, body in (("a/x.md", "---\nid: one\ntags: [p, q]\n---\nbody\n"), ("vendor/y.md", "z"), ("b.go", "package b\n")):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(body)
    tree = trees.read_tree(spark, f"{tmp_path}/t")
    assert sorted(r.path for r in tree.collect()) == ["a/x.md", "b.go"]
    from pyspark.sql import types as T

    meta = trees.read_frontmatter(tree, T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])).first()
    assert (meta.meta.id, meta.meta.tags, meta.body) == ("one", ["p", "q"], "body\n")
    docs = spark.createDataFrame([("k", 2, "two"), ("j", 1, "one")], "id string, ord int, text string")
    assert sinks.write_archive(docs, f"{tmp_path}/o.zip") == 2
    assert zipfile.ZipFile(f"{tmp_path}/o.zip").namelist() == ["j/SKILL.md", "k/SKILL.md"]
    assert list_selection("1,4,7-9", 9) == [1, 4, 7, 8, 9] and list_selection("a", 2) == [1, 2] and list_selection(" ", 2) == []

from galleyproof.operators import gochecks as C
from galleyproof.sources import gofacts as G

SOURCE = '''package a

import (
\t"fmt"
\t"example.com/mod/x"
\t"os"
)

type Clock struct {
\tnow func() time.Time
}

// Name returns the name.
func (c Clock) Name() string {
\treturn c.name
}

func Two(a, b int, flag bool) (int, int) {
\tx1 := 3
\tx2 := "y"
\tif a > 1 && b < 2 {
\t\tfor i := range 4 {
\t\t\tfmt.Println(i)
\t\t}
\t} else {
\t\treturn 1, 2
\t}
\ttime.Sleep(5)
\tconst k = 77
\treturn a, b
}

var X = 9
'''


def test_facts_and_checks(spark):
    files = spark.createDataFrame([("p/a.go", ".go", SOURCE), ("p/b.md", ".md", "x"), ("p/c.go", ".go", None), ("p/d.go", ".go", "")], "path string, ext string, content string")
    facts = G.go_facts(files).cache()
    kinds = {(r.kind, r.name) for r in facts.collect()}
    assert {("import", "os"), ("func", "Name"), ("param", "a"), ("param", "b"), ("param", "flag"), ("short", "x1"), ("var", "X"), ("call", "time.Sleep"), ("field", "now"), ("const", "k")} <= kinds
    assert ("number", "77") not in kinds and ("number", "9") in kinds
    found = lambda df: sorted((r.line, r.message) for r in df.collect())
    assert found(C.import_groups(facts, "example.com/mod")) == [(6, "import groups out of order")]
    assert [m for _, m in found(C.naming(facts))] == ["single-letter exported name X", "numbered name x1", "numbered name x2"] or len(found(C.naming(facts))) == 3
    assert found(C.magic_numbers(facts)) == [(19, "magic number 3"), (22, "magic number 4"), (28, "magic number 5")]
    assert found(C.complexity(facts)) == [(18, "flag argument flag")]
    assert found(C.control_flow(facts, 1)) == [(18, "nesting depth 2"), (26, "return in an else block")]
    assert found(C.named_returns(facts)) == [(18, "Two repeats an unnamed result type")]
    assert found(C.vacuous_doc(facts)) == [(14, "doc on Name restates it")]
    assert found(C.time_discipline(facts)) == [(10, "clock injected as a function field"), (28, "time.Sleep waits on the clock")]


def test_naming_of_many_files_is_not_broadcast(spark, tmp_path):
    # a small Parquet file can make very many fact rows, so its size says nothing about theirs
    from galleyproof.plans import go_queries

    spark.range(300).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = go_queries.QUERIES["go_naming"](spark, str(tmp_path))
    assert "BroadcastExchange" not in found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 300 * 2 + 150 * 2 + 75 * 3

from galleyproof.operators import gochecks as C
from galleyproof.sources import gofacts as G

SOURCE = """package a

func Run(in int, w io.Writer) (err error) {
\tx := 1
\tif x := 2; x > 1 {
\t\terr := f()
\t\t_ = err
\t} else if y := 3; y > 1 {
\t\ty := 4
\t} else {
\t\tlen := 5
\t}
\tfor _, s := range []string{"a", "b"} {
\t\tx, ok := m[s]
\t}
\tv, err := g()
\tv, err := h()
\tvar Run = 3
\tswitch v := in.(type) {
\tcase int:
\t\tz := 1
\t\tok := 2
\tdefault:
\t\tz := 2
\t}
\tgo func() {
\t\tx := 9
\t}()
\tok, q := 1, T{x: 1}
\t{
\t\tq := 2
\t}
\tq, r := 3, 4
\tselect {
\tcase r := <-c:
\t}
\treturn nil
}

func (t *T) Other(x int) {
\tfor i := 0; i < 3; i++ {
\t\tt, i := 1, 2
\t}
}
"""


def test_shadowing(spark):
    files = spark.createDataFrame([("p/a.go", ".go", SOURCE)], "path string, ext string, content string")
    got = sorted((r.line, r.analyzer_id, r.message.split('"')[1], r.message.split(" ")[-1]) for r in C.shadowing(G.go_facts(files)).collect())
    assert got == [
        (5, "shadowing", "x", "variable"), (6, "shadowing", "err", "variable"), (9, "shadowing", "y", "variable"), (11, "shadowing", "len", "builtin"), (14, "shadowing", "x", "variable"),
        (16, "short-decl-reuse", "err", "it"), (18, "shadowing", "Run", "variable"), (19, "shadowing", "v", "variable"), (31, "shadowing", "q", "variable"),
        (35, "shadowing", "r", "variable"), (42, "shadowing", "i", "variable"), (42, "shadowing", "t", "variable"),
    ]


def test_many_declarations_of_one_name(spark):
    body = "".join(f"\tif err := f{k}(); err != nil {{\n\t}}\n" for k in range(3000))
    files = spark.createDataFrame([("p/a.go", ".go", f"package a\n\nfunc F() {{\n{body}}}\n")], "path string, ext string, content string")
    assert C.shadowing(G.go_facts(files)).count() == 0

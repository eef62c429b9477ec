import time

from galleyproof.operators.files import code_regions

TEXT = """a `b` c
```go
x `y` z
~~~
````
after ``q`` and
~~~~
open ```
~~~
still
~~~~~ end
plain é `w`

```
never closed
`v`"""


def slow_regions(text):
    """Covered bytes by a plain walk over the lines."""
    import re

    out, at, open_ = set(), 0, ""
    for line in text.split("\n"):
        size = len(line.encode())
        mark = re.match(r"[ \t]*(`{3,}|~{3,})", line)
        if open_ or mark:
            out |= set(range(at, at + size))
        if not open_ and mark:
            open_ = mark[1]
        elif open_ and mark and mark[1][0] == open_[0] and len(mark[1]) >= len(open_):
            open_ = ""
        elif not open_:
            for m in re.finditer(r"(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)", line):
                out |= set(range(at + len(line[: m.start()].encode()), at + len(line[: m.end()].encode())))
        at += size + 1
    return out


def test_regions(spark):
    texts = {"a.md": TEXT, "b.md": "", "c.md": "```\n", "d.md": "no code\n\n\n", "e.md": "~~~\nx\n~~~\n`y`\n~~~", "f.md": None}
    got = code_regions(spark.createDataFrame(list(texts.items()), "path string, content string")).collect()
    for name, text in texts.items():
        newlines = {k for k, b in enumerate((text or "").encode()) if b == 10}
        covered = {k for r in got if r.path == name for k in range(r.start, min(r.end, len((text or "").encode())))}
        assert covered - newlines == slow_regions(text or "") - newlines, name


def test_long_text_is_linear(spark):
    text = "```\n" + "code\n" * 400_000 + "```\n" + "a `b` c\n" * 50_000 + "~~~\nx\n~~~\n" * 50_000
    began = time.perf_counter()
    assert code_regions(spark.createDataFrame([("a.md", text)], "path string, content string")).count() == 1 + 50_000 + 50_000
    assert time.perf_counter() - began < 60

"""File trees: walks, frontmatter documents, tables of text, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.operators.files import walk_filter


def read_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path (below root), ext, is_test, n_bytes, valid_utf8, content (null where not UTF-8) of every file that a walk visits."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.col("path").substr(F.instr("path", f"{base}/") + len(base) + 1, F.lit(1 << 30))
    name = F.element_at(F.split(path, "/"), -1)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    rows = raw.select(path.alias("path"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"), name.endswith("_test.go").alias("is_test"), F.col("length").alias("n_bytes"), ok.alias("valid_utf8"), F.when(ok, F.col("content").cast("string")).alias("content"))
    return walk_filter(rows)


def walk_order() -> F.Column:
    """Sort key of a walk that visits folders in name order."""
    return F.split("path", "/")


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash over path and content hash of every file in walk order; what meets in one place is a short line for each file."""
    line = F.concat("path", F.lit("\0"), F.sha2("content", 256), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct(walk_order().alias("key"), line.alias("line"))))
    return files.agg(F.sha2(F.array_join(F.transform(listed, lambda s: s["line"]), ""), 256).alias("fingerprint"), F.count("*").alias("files"))


def read_frontmatter(files: DataFrame, schema: T.StructType) -> DataFrame:
    """path, meta (by ``schema``), body of markdown with a YAML block; README files are left out. YAML needs Python."""
    from galleyproof.functions.text import frontmatter

    @F.pandas_udf("string")
    def to_json(block):
        import json

        import yaml

        return block.map(lambda b: None if b is None else json.dumps(yaml.safe_load(b), default=str))

    kept = files.filter((F.lower("ext") == ".md") & (F.element_at(F.split("path", "/"), -1) != "README.md"))
    rows = kept.select("path", frontmatter(F.col("content")).alias("block"), "content").filter("block is not null")
    body = F.regexp_replace("content", r"\A---\n(?s:.*?)\n---(?:\n|\z)", "")
    return rows.select("path", F.from_json(to_json("block"), schema).alias("meta"), body.alias("body"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows with # comments; a row of another width fails."""
    return spark.read.option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").option("enforceSchema", "true").schema(schema).csv(path)


SCENARIO = "struct<skill:string,id:string,description:string,prompt:string,trap:string,assertions:array<struct<id:string,text:string,kind:string,check:struct<type:string,pattern:string>>>>"


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario files (skill, scenarios[]); a scenario without a skill has its file's. Ordered by skill and id."""
    raw = spark.read.option("multiLine", "true").schema(f"skill string, scenarios array<{SCENARIO}>").json(path)
    rows = raw.select("skill", F.explode("scenarios").alias("s"))
    return rows.select(F.coalesce(F.nullif("s.skill", F.lit("")), "skill").alias("skill"), "s.id", "s.description", "s.prompt", "s.trap", "s.assertions").orderBy("skill", "id")

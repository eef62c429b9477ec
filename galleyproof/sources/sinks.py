"""Sinks: cleaned files, document trees, archives, listings, tables of text."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyproof.functions.text import ANY_MARK
from galleyproof.operators.files import clean_files, mark_scan


def write_cleaned(files: DataFrame, target: str) -> DataFrame:
    """Write cleaned contents to ``target`` (parquet: path, cleaned) and return what a scan of it still finds to strip or space: nothing."""
    clean_files(files).filter("skip_reason is null").select("path", "cleaned").write.mode("overwrite").parquet(target)
    again = files.sparkSession.read.parquet(target).select("path", F.col("cleaned").alias("content"))
    return mark_scan(again.filter(F.col("content").rlike(f"[{ANY_MARK}]"))).filter("mark_class < 2")


def write_documents(docs: DataFrame, target: str) -> None:
    """One text per id (id, ord, text), below a folder of that id."""
    docs.select("id", "text").write.mode("overwrite").partitionBy("id").text(target)


def write_archive(docs: DataFrame, path: str, name: str = "SKILL.md") -> int:
    """A zip archive with an entry for each row in order, streamed through the driver; a failed archive is removed."""
    count = 0
    try:
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for r in docs.orderBy("ord", "id").select("id", "text").toLocalIterator():
                out.writestr(f"{r.id}/{name}", r.text)
                count += 1
    except BaseException:
        if os.path.exists(path):
            os.remove(path)
        raise
    return count


def listing(rows: DataFrame, *lists: str) -> DataFrame:
    """Array columns as comma lists; an empty one is a dash."""
    return rows.withColumns({c: F.coalesce(F.nullif(F.concat_ws(", ", c), F.lit("")), F.lit("-")) for c in lists})


def write_tsv(rows: DataFrame, target: str, *order) -> None:
    rows.orderBy(*order).write.mode("overwrite").option("sep", "\t").option("header", "false").csv(target)


def status_text(changes: DataFrame, order: str = "path") -> DataFrame:
    """One text of change lines for each repository, in ``order``; a rename shows both paths."""
    old = F.col("old_path") if "old_path" in changes.columns else F.lit("")
    line = F.concat("staging", "worktree", F.lit(" "), F.when(F.coalesce(old, F.lit("")) != "", F.concat(old, F.lit(" -> "))).otherwise(""), "path")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return changes.groupBy("repo").agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("text"))

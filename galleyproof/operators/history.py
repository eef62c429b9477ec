"""Operators on commit history, change lists and emoji catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galleyproof import dims
from galleyproof.functions.commits import PARTS, leading_emoji, parse, rule_findings
from galleyproof.functions.text import fnv1a, import_only


def parsed(commits: DataFrame, raw: str = "subject") -> DataFrame:
    return parse(commits, raw)


def commit_findings(commits: DataFrame, raw: str = "subject") -> DataFrame:
    """Rule violations of each message: its columns, rule_ord, rule, message."""
    out = parse(commits, raw)
    rules = rule_findings(F.col(raw), {k: F.col(k) for k in PARTS})
    keep = commits.columns
    return out.select(*keep, F.posexplode(rules).alias("rule_ord", "f")).select(*keep, "rule_ord", "f.rule", "f.message")


def emoji_catalog_findings(commits: DataFrame, catalog: DataFrame, raw: str = "subject") -> DataFrame:
    """Prohibited emoji, and those out of the catalog (a broadcast look-up table: name). Initial and merge commits are free."""
    keep = commits.columns
    spark = commits.sparkSession
    banned = spark.createDataFrame(list(dims.PROHIBITED_EMOJI.items()), "name string, replacement string")
    shown = parsed(commits, raw).filter(~F.col("is_initial") & ~F.col("is_merge")).select(*keep, F.posexplode("emojis").alias("k", "name"))
    out = shown.join(F.broadcast(banned), "name", "left").join(F.broadcast(catalog.select("name", F.lit(True).alias("known"))), "name", "left")
    bad = F.col("replacement").isNotNull()
    text = F.when(bad, F.concat(F.lit("emoji :"), "name", F.lit(": is prohibited by project convention"), F.when(F.col("replacement") != "", F.concat(F.lit("; use :"), "replacement", F.lit(": instead"))).otherwise("")))
    text = text.otherwise(F.concat(F.lit("emoji :"), "name", F.lit(": is not in the commit emoji catalog; it may not render in the history view")))
    hit = out.filter(bad | F.col("known").isNull())
    return hit.select(*keep, "k", F.when(bad, "commit-emoji-prohibited").otherwise("commit-emoji-catalog").alias("rule"), text.alias("message"))


def emoji_window(commits: DataFrame, hard: int = dims.HARD_WINDOW, soft: int = dims.SOFT_WINDOW) -> DataFrame:
    """Repeats of a leading emoji among the last commits of a repository; the windows count commits, with or without one."""
    order = W.partitionBy("repo").orderBy("seq")
    e = F.nullif(leading_emoji(F.col("subject")), F.lit(""))
    near = F.collect_list("emoji").over(order.rowsBetween(-hard, -1))
    far = F.collect_list("emoji").over(order.rowsBetween(-soft, -1))
    out = commits.withColumn("emoji", e).withColumns({"near": near, "far": far})
    rule = F.when(F.array_contains("near", F.col("emoji")), "commit-emoji-repeat").when(F.array_contains("far", F.col("emoji")), "commit-emoji-soft-repeat")
    return out.filter("emoji is not null").withColumn("rule", rule).filter("rule is not null").drop("near", "far")


def last_n(commits: DataFrame, n: int) -> DataFrame:
    """Newest first, ``n`` of each repository; none where n is not positive."""
    order = W.partitionBy("repo").orderBy(F.desc("seq"))
    return commits.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= max(n, 0))


def without_replaced_head(commits: DataFrame, first_line: str, author_epoch: int | None = None) -> DataFrame:
    """Drop a repository's newest commit where the message or the author time says it is being replaced."""
    newest = F.max("seq").over(W.partitionBy("repo"))
    same = F.col("subject") == F.lit(first_line)
    if author_epoch is not None:
        same = same | (F.col("author_epoch") == author_epoch)
    return commits.withColumn("newest", newest).filter(~((F.col("seq") == F.col("newest")) & same)).drop("newest")


def heads(commits: DataFrame) -> DataFrame:
    """repo, subject, author_epoch of each repository's newest commit."""
    return commits.groupBy("repo").agg(F.max_by(F.struct("subject", "author_epoch"), "seq").alias("h")).select("repo", "h.subject", "h.author_epoch")


def in_use(commits: DataFrame, soft: int = dims.SOFT_WINDOW) -> DataFrame:
    """repo, name of the emoji that lead a repository's last ``soft`` commits."""
    return last_n(commits, soft).select("repo", leading_emoji(F.col("subject")).alias("name")).filter("name <> ''").distinct()


def admitted(shortcodes: DataFrame, meta: DataFrame, uses: DataFrame) -> DataFrame:
    """name, version, grp, subgroup, uses: shortcodes (name, code_points) that the catalog takes.

    Their meta row (code_points, version, grp, subgroup) is found as written, without joiners, or with a variation selector behind, in
    this order. Prohibited and non-rendering names and country flags stay out, and so do versions after 1.0 but for a few names.
    """
    tries = F.array(F.col("code_points"), F.regexp_replace("code_points", dims.JOINER_CODES, ""), F.concat("code_points", F.lit("-fe0f")))
    keys = shortcodes.select("name", F.posexplode(tries).alias("k", "code_points"))
    found = keys.join(meta, "code_points").groupBy("name").agg(F.min_by(F.struct("version", "grp", "subgroup"), "k").alias("m")).select("name", "m.*")
    fit = ~F.col("name").isin(*dims.PROHIBITED_EMOJI, *dims.NON_RENDERING_EMOJI) & ~F.col("subgroup").isin(*dims.FLAG_SUBGROUPS)
    kept = found.filter(fit & ((F.col("version") <= 1.0) | F.col("name").isin(*dims.LATE_EMOJI)))
    return kept.join(uses.select("name", "uses"), "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def usage(commits: DataFrame) -> DataFrame:
    """Counts by emoji and by type and emoji, in one grouping-sets pass."""
    shown = parsed(commits).select("type", F.explode("emojis").alias("emoji"))
    return shown.groupingSets([["emoji"], ["type", "emoji"]], "type", "emoji").agg(F.count("*").alias("n"), F.grouping("type").cast("int").alias("all_types"))


def pool_ranking(catalog: DataFrame) -> DataFrame:
    """The recommendable part of a catalog (name, grp, subgroup, uses), most used first, then by name."""
    pool = catalog.filter((F.col("uses") > 0) | F.col("grp").isin(*dims.POOL_GROUPS) | F.col("subgroup").isin(*dims.POOL_SUBGROUPS))
    return pool.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("uses"), "name")))


def ranked_per_group(counts: DataFrame) -> DataFrame:
    """Rank of (type, name, uses) within its type: most used first, then by name."""
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("type").orderBy(F.desc("uses"), "name")))


def banded_draw(ranked: DataFrame, want: int, seed: Column | str, group: str) -> DataFrame:
    """Spread ``want`` picks over each group's ranking (rank from 1): one from each band, at an offset that the seed fixes."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    if want <= 0:
        return ranked.limit(0)
    n = F.count("*").over(W.partitionBy(group))
    band = F.floor(F.col("size") / want)
    pick = F.pmod(fnv1a(seed), F.greatest(band, F.lit(1)))
    place = F.col("rank") - 1
    inside = (F.floor(place / F.greatest(band, F.lit(1))) < want) & (F.pmod(place, F.greatest(band, F.lit(1))) == pick)
    return ranked.withColumn("size", n).filter((F.col("size") <= want) | inside).drop("size")


def suggest(tiers: DataFrame, want: int, seed: Column | str, group: str = "query", exclude: DataFrame | None = None) -> DataFrame:
    """Fill ``want`` places per group from tiers (group, tier, rank, name), in order; an item counts in its first tier.

    The first tier gives half of the places and one at most; each tier is drawn by bands. ``want`` is small, so the few steps are
    unrolled into one plan. ``exclude`` (group, name) are items that a group's recent and current messages use: they take no place.
    """
    if exclude is not None:
        tiers = tiers.join(exclude.select(group, "name").distinct(), [group, "name"], "left_anti")
    first = tiers.withColumn("best", F.min("tier").over(W.partitionBy(group, "name"))).filter("tier = best").drop("best")
    picks: list[DataFrame] = []
    taken = None
    for tier in range(4):
        rows = first.filter(F.col("tier") == tier)
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("rank", "name")))
        size = F.count("*").over(W.partitionBy(group))
        if taken is None:
            rows = rows.withColumn("room", F.lit(min(want, want // 2 + 1)))
        else:
            rows = rows.join(taken, group, "left").withColumn("room", F.lit(want) - F.coalesce("taken", F.lit(0))).drop("taken").filter("room > 0")
        band = F.greatest(F.floor(F.col("size") / F.col("room")), F.lit(1))
        rows = rows.withColumn("size", size)
        place = F.col("rank") - 1
        offset = F.pmod(fnv1a(F.lit(seed) if isinstance(seed, str) else seed), band)
        drawn = rows.filter((F.col("size") <= F.col("room")) | ((F.floor(place / band) < F.col("room")) & (F.pmod(place, band) == offset))).select(group, "tier", "rank", "name")
        picks.append(drawn)
        counted = reduce(DataFrame.unionByName, picks).groupBy(group).agg(F.count("*").alias("taken"))
        taken = counted
    return reduce(DataFrame.unionByName, picks)


def move_findings(renames: DataFrame, changes: DataFrame, min_score: int = 90) -> DataFrame:
    """Renames (repo, old_path, new_path, score, diff) that are not pure, and repositories that mix renames with other edits."""
    edited = renames.withColumn("reason", F.when(F.col("score") < min_score, F.format_string("%d%% similar", "score")).when(F.col("diff").isNull() | ~import_only(F.col("diff")), "carries an edit"))
    own = edited.filter("reason is not null").select("repo", F.col("new_path").alias("file"), "reason")
    moved = renames.select("repo", F.col("old_path").alias("path")).unionByName(renames.select("repo", F.col("new_path").alias("path")))
    other = changes.filter("staged").join(moved, ["repo", "path"], "left_anti").filter(~F.coalesce(import_only(F.col("diff")), F.lit(False)))
    edits = other.groupBy("repo").agg(F.count("*").alias("edits"))
    mixed = renames.groupBy("repo").agg(F.count("*").alias("moves")).join(edits, "repo")
    return own.unionByName(mixed.select("repo", F.lit("").alias("file"), F.format_string("mixes %d rename(s) with %d edit(s)", "moves", "edits").alias("reason")))

"""Graph operators: import graphs, closure, cycles, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs in one process."""
    import os
    import re
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "galleyproof-checkpoints"))
    return named or spark.sparkContext.getCheckpointDir()


def unsized(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` of unknown size to the planner, instead of the size guessed from the plan it came from.

    A guess is taken from compressed files, and so is far too small where Python makes many rows of one: a join would broadcast them.
    It is also multiplied at every join, so in a loop its digits double with each step, until the driver cannot hold them.
    """
    spark, plan = df.sparkSession, df._jdf.logicalPlan()
    classes, none = spark._jvm.org.apache.spark.sql, spark._jvm.scala.Option.empty()
    known = classes.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(classes.classic.Dataset.ofRows(spark._jsparkSession, known), spark)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return unsized(df.checkpoint(eager=True))


def package_edges(imports: DataFrame, module: str, mode: str = "first_file") -> DataFrame:
    """src, dst of local imports (repo, pkg, path, import_path). By default only a package's first file in walk order counts."""
    local = imports.filter((F.col("import_path") == module) | F.col("import_path").startswith(module + "/"))
    if mode == "first_file":
        first = F.min(F.split("path", "/")).over(W.partitionBy("repo", "pkg"))
        local = imports.withColumn("first", first).filter(F.split("path", "/") == F.col("first")).filter((F.col("import_path") == module) | F.col("import_path").startswith(module + "/"))
    dst = F.when(F.col("import_path") == module, "").otherwise(F.substring("import_path", len(module) + 2, 1 << 30))
    return local.select("repo", F.col("pkg").alias("src"), dst.alias("dst")).distinct()


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """src, dst reachable over one or more edges: semi-naive steps, each new pair joined once; cycles end by the anti-join.

    With ``seeds`` (src) only pairs from those are kept.
    """
    step = cut(edges.select("src", "dst").distinct())
    start = step if seeds is None else step.join(seeds.select("src").distinct(), "src", "left_semi")
    known = fresh = cut(start)
    while not fresh.isEmpty():
        longer = fresh.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = cut(longer.join(known, ["src", "dst"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return closure(edges).filter("src = dst").select(F.col("src").alias("node"))


def cycle_listing(edges: DataFrame) -> DataFrame:
    """repo, cycle ('a -> b -> a'): the back edges of a depth-first walk over sorted nodes, each cycle from its least node on.

    One repository's import graph is a unit of work.
    """

    def walk(pdf):
        import pandas as pd

        out: dict[str, list[str]] = {}
        for a, b in sorted(set(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))):
            out.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        found: set[tuple] = set()
        for root in sorted(out):
            stack, path = [(root, iter(out.get(root, ())))] if root not in state else [], [root]
            if stack:
                state[root] = 1
            while stack:
                node, rest = stack[-1]
                nxt = next(rest, None)
                if nxt is None:
                    state[node] = 2
                    stack.pop()
                    path.pop()
                elif state.get(nxt) == 1:
                    cycle = path[path.index(nxt) :]
                    k = cycle.index(min(cycle))
                    found.add(tuple(cycle[k:] + cycle[:k]))
                elif nxt not in state:
                    state[nxt] = 1
                    path.append(nxt)
                    stack.append((nxt, iter(out.get(nxt, ()))))
        listed = [" → ".join([*c, c[0]]) for c in sorted(found)]
        return pd.DataFrame({"repo": [pdf["repo"].iloc[0]] * len(listed), "cycle": listed}, columns=["repo", "cycle"], dtype=object)

    return edges.select(F.col("repo").cast("string"), F.col("src").cast("string"), F.col("dst").cast("string")).groupBy("repo").applyInPandas(walk, "repo string, cycle string")


def layer(pkg) -> F.Column:
    """Rank of a package's layer by its first segment: cmd 0, transport 1, infrastructure 2, domain 3; null outside."""
    head = F.split(pkg, "/")[0]
    return F.when(head == "cmd", 0).when(head.isin("transport", "rest", "grpc", "http"), 1).when(head == "infra", 2).when(head == "domain", 3)


def boundary_violations(edges: DataFrame) -> DataFrame:
    """Edges from an inner layer to an outer one."""
    return edges.filter(layer(F.col("src")) > layer(F.col("dst"))).select("src", "dst")


def pulled_skills(skills: DataFrame, selected: DataFrame, router: str = "project-router") -> DataFrame:
    """id, required_by: always-loaded and selected skills and all they compose; the router is not expanded; first pull wins by depth and id."""
    seeds = skills.filter("always_load").select("id").union(selected.select("id")).distinct()
    edges = skills.filter(F.col("id") != router).select(F.col("id").alias("src"), F.explode("compose_skills").alias("dst"))
    known = cut(seeds.select("id", F.lit("").alias("required_by")))
    fresh = known
    while not fresh.isEmpty():
        step = fresh.select(F.col("id").alias("src")).join(edges, "src").groupBy("dst").agg(F.min("src").alias("required_by")).select(F.col("dst").alias("id"), "required_by")
        fresh = cut(step.join(known, "id", "left_anti"))
        known = cut(known.unionByName(fresh))
    return known

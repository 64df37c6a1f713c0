"""Folder rules: inherited tags, exclusion, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def folder_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def chain(folder: Column) -> Column:
    """The folder's ancestors from the top, itself last."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def resolved(folders: DataFrame, rules: DataFrame, auto_depth: int = 0) -> DataFrame:
    """For each distinct folder: excluded, owner (the deepest sub-library's id) and tags in order.

    ``rules``: rel_path, mode (inherit, exclude, sublib), sub_id, tags, removed. Going down, each level drops what it
    removes, then adds its automatic tag (to ``auto_depth``) and its own; the root's rule has the path ''. A folder's
    levels are rows that meet their rules by an equi-join and come back in order: as many as the path is deep.
    """
    own = folders.select("folder").distinct()
    levels = own.select("folder", F.posexplode(F.concat(F.array(F.lit("")), chain(F.col("folder")))).alias("depth", "rel_path"))
    none = F.array().cast("array<string>")
    joined = levels.join(rules, "rel_path", "left").withColumns({"tags": F.coalesce("tags", none), "removed": F.coalesce("removed", none)})
    name = F.element_at(F.split("rel_path", "/"), -1)
    auto = F.when((F.col("depth") > 0) & (F.col("depth") <= auto_depth) & ~F.array_contains("removed", slug(name)), F.array(slug(name))).otherwise(none)
    rows = joined.groupBy("folder").agg(
        F.coalesce(F.max(F.when((F.col("mode") == "exclude") & (F.col("depth") > 0), True)), F.lit(False)).alias("excluded"),
        F.max_by(F.when(F.col("mode") == "sublib", F.col("sub_id")), F.when((F.col("mode") == "sublib") & F.col("sub_id").isNotNull(), F.col("depth"))).alias("owner"),
        F.array_sort(F.collect_list(F.struct("depth", "tags", "removed", auto.alias("auto")))).alias("levels"),
    )

    def step(acc: Column, x: Column) -> Column:
        manual = F.array_except(F.when(x["depth"] > 0, F.array_except(x["tags"], x["removed"])).otherwise(x["tags"]), x["auto"])
        kept = F.array_except(F.array_except(F.array_except(acc, x["removed"]), x["auto"]), manual)
        return F.concat(F.when(x["depth"] > 0, kept).otherwise(acc), x["auto"], manual)

    tags = F.when(F.col("excluded"), none).otherwise(F.aggregate("levels", none, step))
    return rows.select("folder", "excluded", F.when(~F.col("excluded"), F.col("owner")).alias("owner"), tags.alias("tags"))


def closure(folders: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth): every folder with itself and all above it, the root '' at depth 0."""
    own = folders.select(F.col("folder").alias("descendant")).distinct()
    return own.select("descendant", F.posexplode(F.concat(F.array(F.lit("")), chain(F.col("descendant")))).alias("depth", "ancestor"))


def owners(tree: DataFrame, rules: DataFrame) -> DataFrame:
    """(folder, owner): the deepest folder on the way that ``rules`` (rel_path, mode) make a sub-library; null for the library itself, and for what is excluded."""
    own = tree.join(rules.select(F.col("rel_path").alias("ancestor"), "mode"), "ancestor", "left")
    found = own.groupBy(F.col("descendant").alias("folder")).agg(
        F.max_by(F.when(F.col("mode") == "sublib", F.col("ancestor")), F.when(F.col("mode") == "sublib", F.col("depth"))).alias("owner"),
        F.coalesce(F.bool_or((F.col("mode") == "exclude") & (F.col("depth") > 0)), F.lit(False)).alias("excluded"),
    )
    return found.select("folder", F.when(~F.col("excluded"), F.col("owner")).alias("owner"), "excluded")


def rerouted(folders: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, was, now, was_excluded, now_excluded) of the folders that change hands when the rules of a library go from ``before`` to ``after``."""
    tree = closure(folders)
    both = owners(tree, before).select("folder", F.col("owner").alias("was"), F.col("excluded").alias("was_excluded")).join(owners(tree, after).select("folder", F.col("owner").alias("now"), F.col("excluded").alias("now_excluded")), "folder")
    return both.filter(~F.col("was").eqNullSafe(F.col("now")) | (F.col("was_excluded") != F.col("now_excluded"))).select("folder", "was", "now", "was_excluded", "now_excluded")


def applied_mapping(files: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What applying a mapping does to sub-libraries: rel_path, action (create, keep, prune), files before and after.

    ``files``: folder, a row for each file; rules: rel_path, mode. A folder of ``after`` that is a sub-library is created unless it was
    one; one that no longer is goes, and its files fall to what is above it. Files are counted by folder first, so the tree is as large as the folders are.
    """
    counts = files.groupBy("folder").agg(F.count("*").alias("n"))
    tree = closure(counts)
    held = lambda rules, name: owners(tree, rules).join(counts, "folder").groupBy(F.col("owner").alias("rel_path")).agg(F.sum("n").alias(name)).filter("rel_path is not null")
    subs = lambda rules, name: rules.filter("mode = 'sublib'").select("rel_path", F.lit(True).alias(name)).distinct()
    both = subs(before, "was").join(subs(after, "now"), "rel_path", "full")
    action = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "prune").otherwise("keep")
    rows = both.join(held(before, "files_before"), "rel_path", "left").join(held(after, "files_after"), "rel_path", "left")
    return rows.select("rel_path", action.alias("action"), F.coalesce("files_before", F.lit(0)).alias("files_before"), F.coalesce("files_after", F.lit(0)).alias("files_after"))

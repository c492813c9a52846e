"""Joins by text: longest prefixes, path-like tokens, names and keywords, all reshaped to joins on equal tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ancestors(path: Column, separators: str = "/#") -> Column:
    """A path and all that it lies below, by cutting it at each separator."""
    cut = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.lit(1)).isin(*separators))
    return F.concat(F.array(path), F.transform(cut, lambda i: F.substring(path, F.lit(1), i - 1)))


def longest_prefix(files: DataFrame, roots: DataFrame, *, path: str, root: str, root_id: str) -> DataFrame:
    """Files with the longest root that is the path itself or ends at a separator of it; null where there is none."""
    up = files.select(path).distinct().withColumn("_up", F.explode(ancestors(F.col(path))))
    hit = up.join(roots.select(F.col(root).alias("_up"), root_id), "_up").groupBy(path).agg(F.max_by(root_id, F.length("_up")).alias(root_id))
    return files.join(hit, path, "left")


def path_tokens(text: Column) -> Column:
    """Runs of characters that paths are made of, dots at their end cut off."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./\-]+)"), F.lit(1)), lambda t: F.regexp_replace(t, r"\.+$", "")))


def suffixes(token: Column, *, least: int = 2) -> Column:
    """The token, and what is left of it after each slash, down to ``least`` parts."""
    parts = F.split(F.regexp_replace(token, "^/", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - least + 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.array_distinct(F.concat(F.array(token), tails))


def mentioned(rows: DataFrame, assets: DataFrame, *, text: str, key: str, path: str = "path", asset: str = "asset_id") -> DataFrame:
    """(key, asset) of every text that names an asset's path, or the end of it in two parts or more if that is one asset's alone."""
    tokens = rows.select(key, F.explode(path_tokens(F.col(text))).alias("_t")).filter(F.col("_t").contains("/")).distinct()
    index = assets.select(asset, F.explode(suffixes(F.col(path))).alias("_t")).distinct()
    own = index.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"), F.first(asset).alias(asset)).filter("_n = 1").select("_t", asset)
    return tokens.join(own, "_t").select(key, asset).distinct()


#: What hook files end in, and the characters that a message wraps a name in.
HOOK_FILES = ("py", "sh", "js", "mjs", "cjs", "ts", "json", "bash", "zsh")
WRAPPING = "\"'`()[]{}<>,;:.！。，、"


def clean_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, each ``..`` taken with the part before it (at a root: with nothing)."""
    rooted, none = path.startswith("/"), F.array().cast("array<string>")
    up = lambda done: F.when((F.size(done) > 0) & ~F.coalesce(F.try_element_at(done, F.lit(-1)) == "..", F.lit(False)), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
    parts = F.aggregate(F.split(path, "/"), none, lambda done, p: F.when(p.isin("", "."), done).when(p == "..", up(done)).otherwise(F.concat(done, F.array(p))))
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def hook_name(path: Column) -> Column:
    """The file name without its last extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*\z", 1), r"\.[^.]*\z", ""))


def hook_references(text: Column) -> Column:
    """What a message names that could be a hook, in its order, each once: tokens that end as hook files do, paths cleaned."""
    wraps = "[" + "".join(f"\\{c}" if c in "[]\\^-" else c for c in WRAPPING) + "]+"
    tokens = F.transform(F.split(text, "[ \t\n\r\"'`]+"), lambda t: F.regexp_replace(t, rf"^{wraps}|{wraps}\z", ""))
    files = F.filter(tokens, lambda t: t.rlike(rf"(?i)\.({'|'.join(HOOK_FILES)})\z"))
    return F.array_distinct(F.transform(files, lambda t: F.when(t.rlike(r"[/\\]"), clean_path(t)).otherwise(t)))


def hook_links(blocked: DataFrame, hooks: DataFrame, *, text: str, key: str) -> DataFrame:
    """The hook of each blocked result, with the reference that names it: by full path first, else by a name that only one hook has; the earliest reference counts.

    hooks: asset_id, path and, for those without a path, optionally name (its
    part after the last colon counts). Of hooks with one path the least id counts.
    """
    tokens = blocked.select(key, F.posexplode(hook_references(F.col(text))).alias("_pos", "_ref"))
    filled = F.nullif(F.col("path"), F.lit(""))
    told = F.lower(F.substring_index("name", ":", -1)) if "name" in hooks.columns else F.lit(None).cast("string")
    known = hooks.select("asset_id", F.when(filled.isNotNull(), clean_path(filled)).alias("_ref"), F.nullif(F.coalesce(hook_name(filled), told), F.lit("")).alias("_name"))
    paths = known.filter("_ref is not null").groupBy("_ref").agg(F.min("asset_id").alias("asset_id"))
    names = known.filter("_name is not null").groupBy("_name").agg(F.count(F.lit(1)).alias("_n"), F.min("asset_id").alias("asset_id")).filter("_n = 1")
    full = tokens.join(paths, "_ref").select(key, "_pos", "_ref", "asset_id", F.lit(0).alias("_rule"))
    named = tokens.withColumn("_name", hook_name(F.col("_ref"))).join(names, "_name").select(key, "_pos", "_ref", "asset_id", F.lit(1).alias("_rule"))
    first = full.unionByName(named).groupBy(key).agg(F.min_by(F.struct("asset_id", "_ref", "_rule"), F.struct("_rule", "_pos")).alias("l"))
    return first.select(key, "l.asset_id", F.col("l._ref").alias("reference"), F.when(F.col("l._rule") == 0, "path").otherwise("name").alias("rule"))


def uncovered(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(signature, project) pairs, each with its keywords, that no applicable rule covers.

    pairs: signature, project, keywords. mentions: keyword, scope (user or
    project), project. A user rule holds everywhere, a project rule for its
    project.
    """
    each = pairs.select("signature", "project", F.explode("keywords").alias("keyword"))
    anywhere = mentions.filter("scope = 'user'").select("keyword").distinct()
    here = mentions.filter("scope <> 'user'").select("keyword", "project").distinct()
    met = each.join(anywhere, "keyword", "left_semi").unionByName(each.join(here, ["keyword", "project"], "left_semi")).select("signature", "project").distinct()
    return pairs.join(met, ["signature", "project"], "left_anti")


def reference_check(references: DataFrame, known: DataFrame, *, kinds: Sequence[str] = ("command", "path", "tool")) -> DataFrame:
    """References (kind, value) with whether an inventory (kind, value) has them; null for a kind that it does not hold."""
    there = known.select("kind", "value").distinct().withColumn("_there", F.lit(True))
    held = known.select("kind").distinct().withColumn("_held", F.lit(True))
    joined = references.join(there, ["kind", "value"], "left").join(held, "kind", "left")
    return joined.withColumn("exists", F.when(F.col("_held") & F.col("kind").isin(*kinds), F.coalesce("_there", F.lit(False)))).drop("_there", "_held")

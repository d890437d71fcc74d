"""Retrieval evaluation, lexical search and listings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablewick.functions import paths, values
from sablewick.functions import text as text_


def path_set(files: Column) -> Column:
    return F.array_distinct(F.transform(files, lambda p: F.regexp_replace(p, "^/+", "")))


def _over(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def precision_recall_f1(results: DataFrame) -> DataFrame:
    """instance_id, precision, recall, f1 from arrays ``hits`` and ``oracles``."""
    rows = results.select("instance_id", path_set(F.col("hits")).alias("h"), path_set(F.col("oracles")).alias("o"))
    rows = rows.withColumn("both", F.size(F.array_intersect("h", "o")))
    rows = rows.select("instance_id", _over(F.col("both"), F.size("h")).alias("precision"), _over(F.col("both"), F.size("o")).alias("recall"))
    return rows.withColumn("f1", _over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mean_std(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Mean and population deviation of each measure, and the number of distinct instances."""
    parts = [f(m).alias(f"{m}_{name}") for m in measures for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.groupBy(*by).agg(*parts, F.countDistinct("instance_id").alias("instances"))


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise((before - after) / F.nullif(before, F.lit(0)) * 100)


def tool_counts(calls: DataFrame, instance: str = "instance_id", tool: str = "tool") -> DataFrame:
    """Per instance: calls by tool as a map, and in all."""
    one = calls.groupBy(instance, tool).agg(F.count("*").alias("n"))
    return one.groupBy(instance).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(tool, "n")))).alias("tool_call_counts"), F.sum("n").alias("total_tool_calls"))


def grep(files: DataFrame, pattern: str, include: str | None = None, path_col: str = "relative_path", text_col: str = "content") -> DataFrame:
    """(file, line_number, line_content) of lines that match a regular expression."""
    rows = files if include is None else files.filter(paths.base_name(F.col(path_col)).rlike(f"^{paths.glob_regex(include)}$"))
    found = rows.select(F.col(path_col).alias("file"), F.posexplode(text_.lines(F.col(text_col))).alias("line", "line_content"))
    return found.filter(F.col("line_content").rlike(pattern)).select("file", (F.col("line") + 1).alias("line_number"), "line_content")


def match_counts(files: DataFrame, pattern: str, include: str | None = None) -> DataFrame:
    """(file, n): how many lines of each file match."""
    return grep(files, pattern, include).groupBy("file").agg(F.count("*").alias("n"))


def read_lines(files: DataFrame, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """relative_path, content (the asked lines), total_lines, and whether lines are left out."""
    n = text_.line_count(F.col("content"))
    cut = F.lit(False) if offset is None or limit is None else (F.lit(offset) > 0) | (n > offset + limit)
    return files.select("relative_path", text_.line_window(F.col("content"), offset, limit).alias("content"), n.alias("total_lines"), cut.alias("truncated"))


def entries(files: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """Every file and every directory above one: (path, parent, name, kind, depth)."""
    parts = F.split(F.col(path_col), "/")
    every = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.when(n == F.size(parts), "file").otherwise("directory").alias("kind"), n.alias("depth")))).alias("e"))
    every = every.select("e.*").distinct()
    return every.select("path", F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("path", "/[^/]*$", "")).alias("parent"), paths.base_name(F.col("path")).alias("name"), "kind", "depth")


def list_directory(files: DataFrame, directory: str = "") -> DataFrame:
    """Name and kind of a directory's entries, directories first, then by lower-cased name."""
    rows = entries(files).filter(F.col("parent") == directory.strip("/"))
    return rows.select("name", "kind").orderBy(F.col("kind") == "file", F.lower("name"), "name")


def directory_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """Entries down to ``depth``, without hidden and dependency directories."""
    kept = F.array(*[F.lit(n) for n in values.LISTING_HIDDEN_KEPT])
    skipped = F.array(*[F.lit(n) for n in values.LISTING_SKIPS])
    bad = F.exists(F.split("path", "/"), lambda s: F.array_contains(skipped, s) | (s.startswith(".") & ~F.array_contains(kept, s)))
    return entries(files).filter((F.col("depth") <= depth) & ~bad).orderBy("path")


def python_files(files: DataFrame, with_tests: bool = True, path_col: str = "relative_path") -> DataFrame:
    rows = files.filter(F.col(path_col).endswith(".py"))
    return rows if with_tests else rows.filter(~paths.is_test_file(F.col(path_col)))


def oracle_files(patch: Column) -> Column:
    """Distinct files a patch changes (not those it creates)."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(values.PATCH_OLD_FILE), F.lit(1)))


def patch_files(patch: Column) -> Column:
    return F.regexp_extract_all(patch, F.lit(values.PATCH_HEADER), F.lit(1))


def instance_subset(instances: DataFrame, difficulty: str = "15 min - 1 hour", n_files: int = 2) -> DataFrame:
    return instances.filter((F.col("difficulty") == difficulty) & (F.size(patch_files(F.col("patch"))) == n_files))


def edited_files(messages: DataFrame, root: str) -> DataFrame:
    """(instance_id, pos, path): files named by edit results or edit calls, each once, in order."""
    line = messages.select("instance_id", "seq", F.posexplode(text_.lines(F.col("content"))).alias("line", "said"))
    result = F.regexp_extract("said", values.EDIT_RESULT, 1)
    call = F.regexp_extract("said", values.EDIT_CALL, 1)
    both = line.select("instance_id", "seq", "line", F.posexplode(F.array(result, call)).alias("k", "path")).filter("path <> ''")
    base = root.rstrip("/") + "/"
    both = both.withColumn("path", F.when(F.col("path").startswith(base), F.expr(f"substring(path, {len(base) + 1})")).otherwise(F.col("path")))
    first = both.groupBy("instance_id", "path").agg(F.min(F.struct("seq", "line", "k")).alias("at"))
    return first.select("instance_id", (F.row_number().over(Window.partitionBy("instance_id").orderBy("at")) - 1).alias("pos"), "path")


def edit_calls(messages: DataFrame) -> DataFrame:
    """(instance_id, file_path, old_string, new_string) of edit calls given as JSON arguments."""
    args = F.from_json("arguments", "file_path string, old_string string, new_string string")
    return messages.filter("tool = 'edit'").select("instance_id", "seq", args.alias("a")).select("instance_id", "seq", "a.*").filter("file_path IS NOT NULL")


def unified_diff(calls: DataFrame) -> DataFrame:
    """Each edit call with the unified diff of its two strings, in Arrow batches."""
    @F.pandas_udf("string")
    def diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((o or "").splitlines(True), (n or "").splitlines(True), f"a/{p}", f"b/{p}")) for p, o, n in zip(path, old, new)])

    return calls.withColumn("diff", diff("file_path", "old_string", "new_string"))


def token_usage(turns: DataFrame, conversation: str = "instance_id") -> DataFrame:
    """Sums of input and output tokens, their total, and the largest single turn."""
    one = F.col("input_tokens") + F.col("output_tokens")
    return turns.groupBy(conversation).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(one).alias("total_tokens"), F.max(one).alias("max_single_turn_tokens"))


def conversation_summary(turns: DataFrame, most_lines: int = 30) -> DataFrame:
    """One text per conversation: role and text of each turn, long texts cut to ``most_lines``."""
    said = F.concat(F.lit("["), "role", F.lit("] "), text_.first_lines(F.col("text"), most_lines))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"]), "\n").alias("summary"))


RESULT_SCHEMA = "instance_id string, hits array<string>, oracles array<string>, token_usage struct<input_tokens:long,output_tokens:long,total_tokens:long,max_single_turn_tokens:long>, tool_stats struct<tool_call_counts:map<string,int>,total_tool_calls:int>, retrieval_types array<string>"


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evaluation results: one JSON object per file, or per line."""
    return spark.read.schema(RESULT_SCHEMA).json(path, multiLine=not lines)


def subset_statistics(subset: DataFrame, original: DataFrame) -> DataFrame:
    """Rows in the subset and their share of the original in percent."""
    n, of = subset.agg(F.count("*").alias("n")), original.agg(F.count("*").alias("of"))
    return n.crossJoin(of).select("n", F.when(F.col("of") == 0, 0.0).otherwise(F.round(100 * F.col("n") / F.nullif("of", F.lit(0)), 1)).alias("percent"))  # one row each

"""Ignore rules of every folder of a tree, joined with the paths they stand above."""

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NAME = ".gitignore"


def read_rule_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of the ignore files of all folders above paths(path).

    Spark's file sources leave out names that begin with a dot, so tasks look for the file in each folder.
    """
    s = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda d: F.when(d == 0, "").otherwise(
        F.concat(F.array_join(F.slice(s, F.lit(1), d), "/"), F.lit("/"))))
    folders = paths.filter("path is not null").select(F.explode(above).alias("folder")).distinct()
    place = re.sub("^file:/+", "/", root.rstrip("/"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = FileSystem.from_uri(place)
        for batch in batches:
            known = fs.get_file_info([f"{base}/{folder}{NAME}" for folder in batch["folder"]])
            for folder, info in zip(batch["folder"], known):
                if info.type == FileType.File:
                    with fs.open_input_stream(info.path) as text:
                        yield pd.DataFrame({"path": [folder + NAME], "content": [text.read().decode("utf-8", "replace")]})

    return folders.mapInPandas(read, "path string, content string")


def _pattern(glob: Column) -> Column:
    """Regex of a glob: `*` and `?` stay within a segment, `**` goes across, brackets stay classes."""
    steps = [(r"([.+^$(){}|\\])", r"\\$1"), (r"\[!", "[^"), (r"^\*\*/|(?<=/)\*\*/", "\u0001"), (r"(?<=/)\*\*$", "\u0002"),
             (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".+")]
    for find, put in steps:
        glob = F.regexp_replace(glob, find, put)
    return glob


def rules(ignore_files: DataFrame) -> DataFrame:
    """One row per rule: ignore_files(path, content) -> (folder, pos, regex, brought).

    A rule holds below the folder of its file. With an inner or leading `/` it is bound to that folder, else
    it holds at any depth; a closing `/` asks for a directory; `!` brings back. Blank lines and comments are
    no rules, null contents have none.
    """
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    line = F.regexp_replace(F.col("text"), r"^\s+|\s+$", "")
    rows = ignore_files.filter("content is not null").select(folder.alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text"))
    rows = rows.withColumn("text", line).filter("text != '' and text not like '#%'")
    brought = F.col("text").startswith("!")
    body = F.regexp_replace("text", r"^[!\\]", "")
    glob = F.regexp_replace(body, r"^/+|/+$", "")
    bound = F.regexp_replace(body, r"/+$", "").contains("/")
    regex = F.concat(F.when(bound, "^").otherwise("^(?:.*/)?"), _pattern(glob), F.when(body.endswith("/"), "/$").otherwise("/?$"))
    return rows.select("folder", "pos", regex.alias("regex"), brought.alias("brought"), glob.alias("glob")).filter("glob != ''").drop("glob")


def ignored(paths: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """paths(path) with `ignored`: for the file and every folder above it the last matching rule of the
    deepest folder decides; a path in a folder that is left out cannot be brought back.

    A path opens into the pairs of a part of it and a folder above that part, so its rows grow with the
    square of its depth; rules are looked up by their folder. Null paths are not ignored.
    """
    each = paths.select("path").distinct().filter("path is not null").withColumn("s", F.split("path", "/"))
    n = F.size("s")
    unit = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("i"), F.concat(F.array_join(F.slice("s", F.lit(1), i), "/"), F.when(i < n, "/").otherwise("")).alias("unit")))
    each = each.withColumn("u", F.explode(unit)).select("path", "s", "u.i", "u.unit")
    above = F.transform(F.sequence(F.lit(0), F.col("i") - 1), lambda d: F.struct(
        d.alias("depth"), F.when(d == 0, "").otherwise(F.concat(F.array_join(F.slice("s", F.lit(1), d), "/"), F.lit("/"))).alias("folder")))
    each = each.withColumn("f", F.explode(above)).select("path", "unit", "f.depth", "f.folder")
    hit = each.join(rule_rows, "folder").withColumn("rest", F.expr("substring(unit, length(folder) + 1)")).filter(F.expr("rest rlike regex"))
    told = hit.groupBy("path", "unit").agg(F.max_by("brought", F.struct("depth", "pos")).alias("brought"))
    out = told.groupBy("path").agg(F.max(~F.col("brought")).alias("ignored"))
    return paths.join(out, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))

"""Reading a tree of Markdown files.

Listings read no content: the file source prunes it when only path, time and length are selected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.functions import text as T


def list_files(spark: SparkSession, root: str, pattern: str = "*.md", excludes: list[str] | None = None) -> DataFrame:
    """(rel_path, file_size, file_mtime) of the files under root, without those that an exclude pattern matches."""
    rows = _files(spark, root, pattern).select("rel_path", F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"))
    return rows.where(~T.excluded(F.col("rel_path"), excludes or []))


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    base = root.rstrip("/")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).load(base)
    return source.withColumn("rel_path", relative("path", base))


def relative(path: str, root: str) -> Column:
    """Path below root, percent escapes decoded."""
    return F.regexp_replace(F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/")), "^.*?" + _quoted(root.split("://")[-1]) + "/+", "")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def read_notes(spark: SparkSession, root: str, collection_id: int, pattern: str = "*.md", excludes: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Notes of a tree: paths, title, hash, text, front matter block and file stamp.

    only (rel_path) restricts the read to those files, so a refresh opens what has changed and nothing else.
    """
    files = _files(spark, root, pattern).where(~T.excluded(F.col("rel_path"), excludes or []))
    if only is not None:
        files = files.join(only.select("rel_path").distinct(), "rel_path", "left_semi")
    raw = files.withColumn("markdown_text", T.clean_nul(F.decode("content", "UTF-8")))
    block = T.frontmatter_block(F.col("markdown_text"))

    def field(name: str) -> Column:
        return F.regexp_replace(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1), r"^[\"']|[\"']$", "")

    return raw.select(
        F.lit(collection_id).cast("bigint").alias("collection_id"),
        "rel_path",
        F.col("path").alias("abs_path"),
        T.derived_title(field("title"), field("name"), T.body_of(F.col("markdown_text")), F.col("rel_path")).alias("title"),
        F.sha2("markdown_text", 256).alias("file_hash"),
        "markdown_text",
        block.alias("frontmatter"),
        F.to_json(F.struct(F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("file_mtime_ns"))).alias("metadata_json"),
        F.lit("indexed").alias("status"),
    )


def frontmatter_map():
    """pandas UDF: a YAML block as a map of strings; an empty map for blocks that do not parse or are no mapping.

    PyYAML is used where it is installed, else a reader of flat `key: value` and list fields.
    """
    def flat(block: str) -> dict[str, str]:
        out: dict[str, str] = {}
        last = ""
        for line in block.split("\n"):
            if line[:1] in " \t-" and last and line.strip().startswith("- "):
                out[last] = ", ".join(x for x in (out[last], line.strip()[2:].strip()) if x)
            elif ":" in line and not line.startswith((" ", "#")):
                last, value = (x.strip() for x in line.split(":", 1))
                out[last] = value.strip("\"'")
        return out

    def parse(block: str | None) -> dict[str, str]:
        if not block:
            return {}
        try:
            import yaml
        except ImportError:
            return flat(block)
        try:
            found = yaml.safe_load(block)
        except yaml.YAMLError:
            return {}
        if not isinstance(found, dict):
            return {}
        return {str(k): ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v) for k, v in found.items()}

    @F.pandas_udf("map<string,string>")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(parse)

    return run

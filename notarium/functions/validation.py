"""Checks on front matter and paths, as column expressions that give arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TYPES = "article concept draft moc note plan project read report resource runbook sop system".split()
DOMAINS = "ai content ecom general personal sport strategy system trading".split()
PROPERTIES = "created created_by domain project source status tags topic type".split()
TAG_PREFIXES = ("type/", "status/", "domain/")


def frontmatter_errors(fields: Column, types: list[str] = TYPES, domains: list[str] = DOMAINS, agent: bool = False) -> Column:
    """Messages for a map of front matter fields; an empty array if it is valid."""

    def field(name: str) -> Column:
        return F.trim(F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit("")))

    def error(bad: Column, message: str) -> Column:
        return F.when(bad, F.lit(message))

    checks = [error(field(n) == "", f"missing {n}") for n in ("type", "domain", "created")]
    checks.append(error((field("type") != "") & ~field("type").isin(*types), "unknown type"))
    checks.append(error((field("domain") != "") & ~field("domain").isin(*domains), "unknown domain"))
    day = field("created").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(field("created"), "yyyy-MM-dd").isNotNull()
    checks.append(error((field("created") != "") & ~day, "created is no date"))
    if agent:
        checks.append(error(field("created_by") != "agent", "created_by must be agent"))
    checks.append(error((field("status") != "") & (field("type") != "article"), "status is for articles"))
    tags = F.transform(F.split(field("tags"), r"[,\s]+"), lambda t: F.regexp_replace(t, r"^[#\[\"']+|[\]\"']+$", ""))
    mirrored = F.exists(tags, lambda t: F.startswith(t, F.lit(TAG_PREFIXES[0])) | F.startswith(t, F.lit(TAG_PREFIXES[1])) | F.startswith(t, F.lit(TAG_PREFIXES[2])))
    checks.append(error(mirrored, "tag mirrors a property"))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def path_errors(path: Column, allowed: list[str], denied: list[str], size: Column | None = None, most: int = 200_000) -> Column:
    """Messages for a path to be written: relative, Markdown, no way up, under an allowed root and no denied one, small."""
    own = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.split(own, "/")

    def under(roots: list[str]) -> Column:
        hit = F.lit(False)
        for root in roots:
            bare = root.strip("/")
            hit = hit | (own == bare) | F.startswith(own, F.lit(bare + "/")) if bare else F.lit(True)
        return hit

    checks = [
        F.when(own == "", F.lit("empty path")),
        F.when(F.startswith(own, F.lit("/")) | own.rlike("^[A-Za-z]:"), F.lit("absolute path")),
        F.when(F.array_contains(parts, ".."), F.lit("path leads up")),
        F.when(~F.endswith(F.lower(own), F.lit(".md")), F.lit("not Markdown")),
        F.when(~under(allowed), F.lit("not in an allowed folder")),
        F.when(under(denied), F.lit("in a denied folder")) if denied else F.lit(None).cast("string"),
    ]
    if size is not None:
        checks.append(F.when(size > most, F.lit("too large")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())

"""Parsing of references: pull-request addresses, remotes, tracking branches, definition uses, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _group(col: Column, rx: str, i: int) -> Column:
    return F.when(col.rlike(rx), F.regexp_extract(col, rx, i))


def parse_pr_url(url: Column, strict: bool = False) -> Column:
    """``struct(owner, repo, number)``; NULL (or an error when strict) for anything else."""
    rx = r"github\.com/([^/]+)/([^/]+)/pull/(\d+)"
    valid = url.rlike(r"^https?://github\.com/") & url.rlike(rx)
    parsed = F.struct(
        F.regexp_extract(url, rx, 1).alias("owner"),
        F.regexp_extract(url, rx, 2).alias("repo"),
        F.regexp_extract(url, rx, 3).cast("bigint").alias("number"),
    )
    if not strict:
        return F.when(valid, parsed)
    error = F.raise_error(F.concat(F.lit("Invalid pull request URL: "), url))
    return F.when(valid, parsed).otherwise(error.cast("struct<owner:string,repo:string,number:bigint>"))


def parse_remote(line: Column) -> Column:
    """``struct(name, url, is_github, owner, repo)`` of a fetch line; NULL for other lines."""
    fetch = r"^(\S+)\s+(\S+)\s+\(fetch\)$"
    url = F.regexp_extract(line, fetch, 2)
    hub = r"github\.com[:/]([^/]+)/([^/.]+)"
    return F.when(
        line.rlike(fetch),
        F.struct(
            F.regexp_extract(line, fetch, 1).alias("name"),
            url.alias("url"),
            url.rlike(hub).alias("is_github"),
            _group(url, hub, 1).alias("owner"),
            _group(url, hub, 2).alias("repo"),
        ),
    )


def parse_tracking(ref: Column) -> Column:
    """``struct(remote, branch)``, split at the first slash."""
    remote = F.substring_index(ref, "/", 1)
    return F.struct(remote.alias("remote"), F.substring(ref, F.length(remote) + 2, F.length(ref)).alias("branch"))


_USE = r"^#defined/(signals|watches|reports)/(.+)$"


def parse_use(use: Column, strict: bool = True) -> Column:
    """``struct(kind, name)`` of ``#defined/<kind>/<name>``; NULL stays NULL, other text is an error."""
    parsed = F.struct(F.regexp_extract(use, _USE, 1).alias("kind"), F.regexp_extract(use, _USE, 2).alias("name"))
    bad = F.raise_error(F.concat(F.lit("Invalid reference format: "), use)).cast("struct<kind:string,name:string>")
    found = F.when(use.rlike(_USE), parsed)
    return found.when(use.isNotNull(), bad) if strict else found


def decode_content(content: Column, encoding: Column) -> Column:
    """Base64 payloads as UTF-8 text; NULL for any other encoding."""
    return F.when(encoding == "base64", F.unbase64(content).cast("string"))

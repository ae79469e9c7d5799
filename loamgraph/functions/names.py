"""Scalar operators on names, paths, addresses and messages, as Column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The address form, the skipped folders and the scanned extensions.
URL_PATTERN = r"^https?://(www\.)?github\.com/[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+/?$"
SKIPPED_FOLDERS = [".git", "__pycache__", "venv", ".venv", "node_modules", "docs", "docs_src", "tests", "scripts"]
SCANNED = [".py", ".js", ".ts", ".tsx", ".jsx"]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def url_valid(c: Column) -> Column:
    """Whether an address names a repository on the supported host."""
    return strip(c).rlike(URL_PATTERN)


def repo_identifier(c: Column) -> Column:
    """The last two parts of an address."""
    parts = F.split(F.regexp_replace(c, "/+$", ""), "/")
    return F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))


def error_category(c: Column) -> Column:
    """What went wrong while indexing, by the first rule whose words the message has (fixed values)."""
    low = F.lower(c)
    return (
        F.when(F.contains(c, F.lit("Git clone failed")) | F.contains(c, F.lit("GitHub URL")), "clone_failed")
        .when(F.contains(low, F.lit("not found")) | F.contains(low, F.lit("not available")), "git_missing")
        .when(F.contains(c, F.lit("Qdrant")) | F.contains(low, F.lit("connection")), "store_unavailable")
        .when(c.isNotNull(), "indexing_failed")
    )


def module_name(rel_path: Column) -> Column:
    """Dotted module of a repository-relative path; a package's __init__ is the package itself."""
    dotted = F.replace(F.regexp_replace(rel_path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def relative_module(current: Column, rel: Column) -> Column:
    """The module that a relative import names: as many parts of the current one are dropped as there are leading dots."""
    dots = F.length(F.regexp_extract(rel, r"^\.*", 0))
    suffix = F.regexp_replace(rel, r"^\.+", "")
    parts = F.split(current, r"\.")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    base = F.when(dots > 0, F.array_join(kept, ".")).otherwise("")
    return F.when(suffix == "", base).when(base == "", suffix).otherwise(F.concat(base, F.lit("."), suffix))


def decorator_key(c: Column) -> Column:
    """A decorator without its arguments and sign."""
    return F.regexp_replace(strip(F.substring_index(c, "(", 1)), "^@", "")


def visibility(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("_")), "private").when(name.isNotNull(), "public")


def docstring_strip(c: Column) -> Column:
    """A plain string literal without its quotes and outer white space; prefixed literals stay as they are."""
    q3, q3b, q1, q1b = '"""', "'''", '"', "'"
    both = lambda q: F.startswith(c, F.lit(q)) & F.endswith(c, F.lit(q))
    cut = lambda n: strip(F.substring(c, F.lit(n + 1), F.greatest(F.length(c) - 2 * n, F.lit(0))))
    return F.when(both(q3) | both(q3b), cut(3)).when(both(q1) | both(q1b), cut(1)).otherwise(c)


def basename(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "\\", -1), "/", -1)


def intent_label(intent: Column) -> Column:
    """For display: only the first underscore becomes a space."""
    return F.regexp_replace(intent, "^([^_]*)_", "$1 ")


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)

"""Which paths may be read. Syntax and ancestry are expressions; what needs the file system runs once per request batch."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def syntax_error(path: Column) -> Column:
    """The code of the first thing wrong with a path as it stands, or null."""
    return (
        F.when(path.isNull() | (strip(path) == ""), "INVALID_ARGUMENT")
        .when(F.instr(path, "\x00") > 0, "INVALID_ARGUMENT")
        .when(path.rlike("(?i)^data:"), "INVALID_ARGUMENT")
        .when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), "INVALID_ARGUMENT")
        .when(path.rlike(r"^\\\\[^\\]"), "PATH_NOT_ALLOWED")
    )


def platform_advice(path: Column) -> Column:
    """For a Windows path on a POSIX host, how it is spelt here."""
    here = F.concat(F.lit("/mnt/"), F.lower(F.substring(path, 1, 1)), F.lit("/"), F.replace(F.substring(path, F.lit(4), F.length(path)), F.lit("\\"), F.lit("/")))
    return F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.lit("Use '"), here, F.lit("' instead.")))


def is_within(path: Column, root: Column) -> Column:
    """Ancestry by components: /a/ws-evil is not in /a/ws."""
    base = F.regexp_replace(root, "/+$", "")
    return (path == root) | (path == base) | path.startswith(F.concat(base, F.lit("/")))


def within_any(path: Column, roots: Column) -> Column:
    return F.exists(roots, lambda r: is_within(path, r))


def candidates(path: Column, roots: Column) -> Column:
    """The path itself if it is absolute, else one below each root; the working directory is never asked."""
    return F.when(path.startswith("/"), F.array(path)).otherwise(F.transform(roots, lambda r: F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"), path)))


def normal_path(path: Column) -> Column:
    """Without empty and dot components, each .. taking one component with it; purely textual."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def textual_code(path: Column, roots: Column) -> Column:
    """What can be told of a path without a file system: a code, or null if some candidate is inside a root."""
    inside = F.exists(F.transform(candidates(strip(path), roots), normal_path), lambda p: within_any(p, roots))
    return F.coalesce(syntax_error(path), F.when(F.size(roots) == 0, "CONFIGURATION_ERROR"), F.when(platform_advice(path).isNotNull(), "PATH_NOT_ALLOWED"), F.when(~inside, "PATH_NOT_ALLOWED"))


def resolve_local(requests: DataFrame, roots: tuple[str, ...], column: str = "path") -> DataFrame:
    """Adds ``resolved`` and ``path_error`` for files on a file system that all executors share.

    Links are followed before ancestry is checked, and what lies outside is
    refused before anyone learns whether it exists.
    """
    real = tuple(os.path.realpath(os.path.expanduser(r)) for r in roots)

    def check(path: str) -> tuple[str | None, str | None]:
        expanded = os.path.expanduser(path.strip())
        tries = [expanded] if os.path.isabs(expanded) else [os.path.join(r, expanded) for r in real]
        inside = [p for p in map(os.path.realpath, tries) if any(p == r or os.path.commonpath([p, r]) == r for r in real)]
        if not inside:
            return None, "PATH_NOT_ALLOWED"
        found = next((p for p in inside if os.path.exists(p)), None)
        if found is None:
            return None, "FILE_NOT_FOUND"
        return (found, None) if os.path.isfile(found) else (None, "NOT_A_REGULAR_FILE")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [check(p) if e is None else (None, e) for p, e in zip(b.column(column).to_pylist(), b.column("path_error").to_pylist(), strict=True)]
            rest = [n for n in b.schema.names if n != "path_error"]
            yield pa.record_batch([*(b.column(n) for n in rest), pa.array([r for r, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string())], [*rest, "resolved", "path_error"])

    lit_roots = F.array(*[F.lit(r) for r in roots]) if roots else F.array().cast("array<string>")
    before = F.coalesce(syntax_error(F.col(column)), F.when(F.size(lit_roots) == 0, "CONFIGURATION_ERROR"), F.when(platform_advice(F.col(column)).isNotNull(), "PATH_NOT_ALLOWED"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.withColumn("path_error", before).mapInArrow(run, f"{schema}, resolved string, path_error string")

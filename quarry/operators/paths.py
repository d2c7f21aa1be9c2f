"""Operators on paths: ordered prefix rewrites, ownership, exclusion and suffix matches.

A prefix matches whole segments only. Joins on prefixes explode each path into its ancestors and join on equality, which
hashes and shuffles like any other join, where a join on ``startswith`` would compare every path with every prefix.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import composed


def nfc(path: Column) -> Column:
    """In normal form C, as paths typed and paths read from a file system must be to be equal."""
    return composed(path)


def normalised(path: Column) -> Column:
    """Forward slashes, none doubled and none at the end but for the root."""
    slashed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.when(F.length(slashed) > 1, F.regexp_replace(slashed, "/$", "")).otherwise(slashed)


def collapsed(path: Column) -> Column:
    """An absolute path without ``.`` and ``..``: a fold over its segments."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        none,
        lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(p))
        ),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def under(path: Column, prefix: Column | str) -> Column:
    """Whether the path is the prefix or lies below it."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def cleaned(path: Column) -> Column:
    """Without blanks around it, slashes forward."""
    return F.replace(F.trim(path), F.lit("\\"), F.lit("/"))


def prefix_form(prefix: str) -> str:
    """A configured prefix as paths are compared with it: normal form C, slashes forward, none at the end but the root's."""
    return unicodedata.normalize("NFC", prefix.strip().replace("\\", "/").rstrip("/")) or ("/" if prefix.strip() else "")


def composed_under(path: Column, prefix: str) -> Column:
    """Whether the path is the prefix or lies below it, in whatever normal form either is written."""
    own = prefix_form(prefix)
    return under(nfc(cleaned(path)), own) if own else F.lit(False)


def _remapped(path: Column, source: str, target: str) -> Column:
    """The composed path with one prefix for another; null where it isn't under it or a prefix is empty."""
    a, b = prefix_form(source), prefix_form(target)
    if not a or not b:
        return F.lit(None).cast("string")
    rest = F.ltrim(F.substring(path, F.lit(len(a) + 1), F.length(path)), F.lit("/"))
    return F.when(under(path, a), F.when(rest == "", F.lit(b)).otherwise(F.concat(F.lit(b.rstrip("/") + "/"), rest)))


#: A mapping: the server's prefix, the local one, and those that senders use.
Mapping = tuple[str, str, tuple[str, ...]]


def canonical(path: Column, mappings: list[Mapping]) -> Column:
    """The local form of a server's, a sender's or a local path: by the first mapping whose server or sender prefix it has.

    Compared and rewritten in normal form C; a path that no mapping covers comes back as it is, but for blanks and slashes.
    """
    own = nfc(cleaned(path))
    found = [_remapped(own, source, local) for remote, local, senders in mappings for source in (remote, *senders)]
    return F.coalesce(*found, cleaned(path))


def expanded(path: Column, mappings: list[Mapping]) -> Column:
    """The path itself, then every form that any mapping gives it, each once: server and local, and senders' to and from both.

    Empty and null paths have no forms.
    """
    own, found = nfc(cleaned(path)), []
    for remote, local, senders in mappings:
        found += [_remapped(own, remote, local), _remapped(own, local, remote)]
        for sender in senders:
            found += [_remapped(own, a, b) for a, b in ((sender, local), (sender, remote), (local, sender), (remote, sender))]
    first = F.array(cleaned(path))
    forms = F.array_distinct(F.concat(first, F.array_compact(F.array(*found)))) if found else first
    return F.when(F.coalesce(cleaned(path), F.lit("")) != "", forms).otherwise(F.array().cast("array<string>"))


def scan_targets(paths: DataFrame, path: str, roots: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """path, library, target, each once: what to scan for a path that isn't known, by every form of it that lies under a root.

    Of a form's roots the longest counts. The target is the first folder below it, or the root where the form lies in it directly.
    """
    forms = paths.select(path, F.explode(expanded(F.col(path), mappings)).alias("form")).distinct()
    found = longest_prefix(forms.select("form").distinct(), "form", roots)
    parts = F.filter(F.split(F.substring("form", F.length("root") + 1, F.length("form")), "/"), lambda p: p != "")
    target = F.when(F.size(parts) >= 2, F.concat("root", F.lit("/"), F.try_element_at(parts, F.lit(1)))).otherwise(F.col("root"))
    return forms.join(found, "form").select(path, "library", target.alias("target")).distinct()


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def folder_files(asked: DataFrame, files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """asked, file: the files of an extension anywhere below each asked path, each once; the path itself where there are none.

    Extensions count in any case. Null and empty paths are left out.
    """
    wanted = asked.select("asked").where(F.coalesce("asked", F.lit("")) != "").distinct()
    known = files.where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*extensions)).select("file").distinct()
    above = known.select("file", F.explode(ancestors(F.col("file"))).alias("asked")).where("asked <> file")
    below = wanted.join(above, "asked", "left")
    return below.select("asked", F.coalesce("file", "asked").alias("file"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def moved(path: Column, source: str, target: str) -> Column:
    """The path with its prefix replaced, null where it isn't under it."""
    return F.when(under(path, source), F.concat(F.lit(target), F.substring(path, F.lit(len(source) + 1), F.length(path))))


def rewritten(path: Column, rules: list[tuple[str, str]]) -> Column:
    """By the first rule that matches, else the path as it is."""
    return F.coalesce(*[moved(path, a, b) for a, b in rules], path)


def candidates(path: Column, rules: list[tuple[str, str]], keep_input: bool = True) -> Column:
    """Every rewrite in either direction in rule order, each once; the path itself first, or only if nothing matches."""
    found = F.array_compact(F.array(*[x for a, b in rules for x in (moved(path, a, b), moved(path, b, a))]))
    if keep_input:
        return F.array_distinct(F.concat(F.array(path), found))
    return F.when(F.size(found) == 0, F.array(path)).otherwise(F.array_distinct(found))


def one_way(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The rewrites of every matching rule, the path itself only where none matches."""
    found = F.array_compact(F.array(*[moved(path, a, b) for a, b in rules]))
    return F.when(F.size(found) == 0, F.array(path)).otherwise(found)


def owners(paths: DataFrame, path: str, roots: DataFrame, server: str, order: list[str]) -> DataFrame:
    """Each path's owners: of each server the first root, in order, that the path lies under.

    ``roots`` has a ``root`` column. The best of a server is kept by a combining aggregate.
    """
    steps = paths.withColumn("root", F.explode(ancestors(F.col(path))))
    matched = steps.join(roots, "root")
    rest = [c for c in roots.columns if c not in (server, "root")]
    first = F.min_by(F.struct("root", *rest), F.struct(*order, "root")).alias("owner")
    return matched.groupBy(path, server).agg(first).select(path, server, "owner.*")


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """Each path with its longest root; paths under none are left out."""
    steps = paths.withColumn("root", F.explode(ancestors(F.col(path))))
    longest = F.max_by(F.struct("root", *[c for c in roots.columns if c != "root"]), F.length("root")).alias("m")
    return steps.join(roots, "root").groupBy(path).agg(longest).select(path, "m.*")


def excluded(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether any rule (value, kind) covers the path. A pattern that isn't valid counts for nothing."""
    tests = [F.lit(False)]
    for value, kind in rules:
        if kind == "path":
            tests.append(under(path, value.rstrip("/")))
            continue
        try:
            re.compile(value)
        except re.error:
            continue
        tests.append(path.rlike(value))
    return reduce(lambda a, b: a | b, tests)


def common_suffix(left: Column, right: Column) -> Column:
    """How many trailing segments two paths share."""
    a, b = F.reverse(F.split(left, "/")), F.reverse(F.split(right, "/"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, F.lit(False))
    return F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")

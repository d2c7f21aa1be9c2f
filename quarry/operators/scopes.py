"""Which libraries a scan takes in, which hash a file's part has, and why a path belongs to nobody."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import paths


def in_scope(key: Column, title: Column, ids: list[str], titles: list[str]) -> Column:
    """Ids decide where any are given, else lower-cased titles, else everything is in."""
    if ids:
        return F.coalesce(key.cast("string").isin(*ids), F.lit(False))
    if titles:
        return F.coalesce(F.lower(title).isin(*titles), F.lit(False))
    return F.lit(True)


def in_recent_scope(key: Column, title: Column, explicit: list[str], titles: list[str], ids: list[str]) -> Column:
    """Explicit ids override the rest; else global ids or titles, and everything where neither is given."""
    if explicit:
        return in_scope(key, title, explicit, [])
    if not titles and not ids:
        return F.lit(True)
    by_id = in_scope(key, title, ids, []) if ids else F.lit(False)
    by_title = in_scope(key, F.trim(title), [], titles) if titles else F.lit(False)
    return by_id | by_title


def part_hash(parts: DataFrame, item: str, order: str, digest: str, path: str, target: str) -> DataFrame:
    """item, digest: of each item's parts the one whose path is the target's; null while it isn't analysed.

    The part that shares most trailing segments, if no other shares as many; else the only one with the target's file
    name; else the first of those that tie; else the first usable one. A digest is usable from two characters on. An
    item's parts are few (versions of one film), so they are gathered in a row.
    """
    depth = paths.common_suffix(paths.normalised(F.col(path)), paths.normalised(F.col(target)))
    row = F.struct(
        F.col(order).alias("ord"),
        F.col(digest).alias("digest"),
        depth.alias("depth"),
        (paths.basename(F.col(path)) == paths.basename(paths.normalised(F.col(target)))).alias("named"),
    )
    gathered = parts.groupBy(item).agg(F.array_sort(F.collect_list(row)).alias("parts"))
    deepest = F.array_max(F.transform("parts", lambda p: p.depth))
    tied = F.filter("parts", lambda p: (p.depth == deepest) & (p.depth > 0))
    named = F.filter("parts", lambda p: p.named)
    usable = lambda d: F.when(F.length(d) >= 2, d)
    first = lambda rows: usable(F.get(rows, F.lit(0))["digest"])
    anything = first(F.filter("parts", lambda p: F.length(p.digest) >= 2))
    chosen = (
        F.when(F.size(tied) == 1, first(tied))
        .when(F.size(named) == 1, first(named))
        .otherwise(F.coalesce(F.when(F.size(tied) > 1, first(tied)), anything))
    )
    return gathered.select(item, chosen.alias("digest"))


def inferred_prefixes(path: Column, roots: list[str]) -> Column:
    """struct(sender, server, root): the prefixes that differ where a root lies inside the path but not at its start.

    The longest root counts, at a segment's end, in any case of letters. The pair is that of the root's folder, so that
    it covers its siblings, unless that is the top. Null where no root is inside.
    """
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    low = F.lower(text)

    def found(root: str) -> Column:
        at = F.instr(low, root.lower())
        after = F.substring(low, at + len(root), F.lit(1))
        parent = root.rsplit("/", 1)[0]
        shown = parent or root
        extra = F.rtrim(F.left(text, at - 1), F.lit("/"))
        return F.when(
            (at > 1) & ((after == "") | (after == "/")),
            F.struct(F.concat(extra, F.lit(shown)).alias("sender"), F.lit(shown).alias("server"), F.lit(root).alias("root")),
        )

    wanted = sorted({r.rstrip("/") for r in roots if r.strip()}, key=lambda r: (-len(r), r))
    return F.coalesce(*map(found, wanted))


def _covers(pair: Column, row: tuple[str, str, tuple[str, ...]]) -> Column:
    """Whether a mapping row (remote, local, sender prefixes) joins the pair's two sides."""
    plain = lambda p: p.strip().rstrip("/").lower()
    server_side = [plain(row[0]), plain(row[1])]
    sender_side = [*server_side, *map(plain, row[2])]
    return F.lower(pair["server"]).isin(*server_side) & F.lower(pair["sender"]).isin(*sender_side)


def mismatch_class(path: Column, roots: list[tuple[str, str]], mappings: dict[str, list[tuple[str, str, tuple[str, ...]]]]) -> Column:
    """Why a path has no owner: ``covered`` (the owning server maps the prefix, so the file is missing), ``elsewhere``
    (only another server maps it), ``mismatch`` (a mapping is wanted) or ``unknown`` (no root is inside the path).

    ``roots`` are (server, root); a server owns a prefix if it has a root at or below it.
    """
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    pair = inferred_prefixes(path, [root for _, root in roots])
    owns = {
        server: any_of([(pair["server"] == r) | F.lit(r).startswith(F.concat(pair["server"], F.lit("/"))) for s, r in roots if s == server])
        for server in mappings
    }
    owner = any_of([owns[s] & _covers(pair, row) for s, rows in mappings.items() for row in rows])
    other = any_of([_covers(pair, row) for rows in mappings.values() for row in rows])
    return F.when(pair.isNull(), "unknown").when(owner, "covered").when(other, "elsewhere").otherwise("mismatch")


def resolved(requests: DataFrame, request: str, path: str, mappings: dict[str, list[tuple[str, str, tuple[str, ...]]]],
             roots: DataFrame, existing: DataFrame) -> DataFrame:
    """request, canonical, owners: a sender's path as the servers know it, and every server that owns any form of it.

    Forms are the path itself, then per server those by sender prefixes, then those by remote prefixes. Owned forms
    count: the first that exists, else the first; without any, the path stays and has no owners. ``roots`` has server,
    root and ord, ``existing`` a path column.
    """
    raw = F.col(path)
    steps = [raw]
    for rows in mappings.values():
        steps += [paths.moved(raw, sender, local) for _, local, senders in rows for sender in senders]
        steps += [paths.moved(raw, remote, local) for remote, local, _ in rows]
    forms = F.array_distinct(F.array_compact(F.array(*steps)))
    tried = requests.select(request, F.posexplode(forms).alias("place", "form"))
    own = paths.owners(tried.select("form").distinct(), "form", roots, "server", ["ord"]).select("form", "server")
    there = existing.select(F.col("path").alias("form")).distinct().withColumn("missing", F.lit(0))
    matched = tried.join(own, "form").join(there, "form", "left")
    chosen = matched.groupBy(request).agg(
        F.min_by("form", F.struct(F.coalesce("missing", F.lit(1)), "place")).alias("canonical"),
        F.array_sort(F.collect_set("server")).alias("owners"),
    )
    none = F.array().cast("array<string>")
    return requests.join(chosen, request, "left").select(
        request, F.coalesce("canonical", path).alias("canonical"), F.coalesce("owners", none).alias("owners")
    )

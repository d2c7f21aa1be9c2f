"""Webhook requests to typed rows: one projection for seven routes, over a table or a stream alike.

A request has ``route`` (radarr, sonarr, sportarr, plex, custom, incoming, server/<id>), ``pin`` (the server named in the
query string), ``form`` (the form's payload field, where it came as one) and ``body``. Payloads are parsed once, as
variants, so an entry of another shape than expected is left out by itself and never spoils its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events that are acted on, by sender.
ARR_EVENTS = {"radarr": ("Download",), "sonarr": ("Download", "OnDownload"), "sportarr": ("Download", "OnDownload")}
ADDED = ("library.new", "itemadded")
_BLANKS = " \t\n\r\x0b\x0c"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def raw(data: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(data, path, "string"), F.lit(""))


def text(data: Column, path: str) -> Column:
    """The value at a path as text without blanks around it; empty where there is none."""
    return stripped(raw(data, path))


def own_text(data: Column, path: str) -> Column:
    """Like ``text``, but of texts only: numbers and the like count as absent."""
    return F.when(F.schema_of_variant(F.try_variant_get(data, path, "variant")) == "STRING", text(data, path)).otherwise("")


def first_of(*values: Column) -> Column:
    """The first that isn't empty, else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def whole_number(data: Column, path: str) -> Column:
    return F.try_variant_get(data, path, "int")


def normal_path(path: Column) -> Column:
    """Without empty, ``.`` and ``..`` parts, slashes forward; a relative path keeps what leads out of it."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        up = F.when(last != "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done)
        return F.when(part == "..", up.otherwise(F.concat(done, F.array(part)))).otherwise(F.concat(done, F.array(part)))

    kept = F.array_join(F.aggregate(parts, none, step), "/")
    whole = F.when(rooted, F.concat(F.lit("/"), kept)).otherwise(first_of(kept, F.lit(".")))
    return F.replace(whole, F.lit("\\"), F.lit("/"))


def combined(base: Column, relative: Column) -> Column:
    """A file below a folder, normalised; empty where either is."""
    joined = F.when(relative.startswith("/"), relative).when(base.endswith("/"), F.concat(base, relative)).otherwise(F.concat(base, F.lit("/"), relative))
    return F.when((base == "") | (relative == ""), F.lit("")).otherwise(normal_path(joined))


def distinct_paths(found: Column) -> Column:
    """Normalised, each once, in the order met; empty ones go."""
    return F.array_distinct(F.transform(F.filter(found, lambda p: p != ""), normal_path))


def replaced_files(data: Column, folder: str, previous: str | None = None) -> Column:
    """Paths of files that a download replaced: absolute, or relative to the sender's folder."""
    base = text(data, folder)

    def path(entry: Column) -> Column:
        return first_of(text(entry, "$.path"), combined(base, text(entry, "$.relativePath")))

    entries = F.coalesce(F.try_variant_get(data, "$.deletedFiles", "array<variant>"), F.array().cast("array<variant>"))
    if previous:
        more = F.try_variant_get(data, previous, "variant")
        entries = F.when(more.isNotNull(), F.concat(entries, F.array(more))).otherwise(entries)
    return distinct_paths(F.transform(entries, path))


def file_path(data: Column, file: str, folder: str, flat: str | None = None) -> Column:
    own = raw(data, f"$.{file}.path")
    below = combined(text(data, folder), text(data, f"$.{file}.relativePath"))
    rest = first_of(below, text(data, flat)) if flat else below
    return F.when(own != "", stripped(own)).otherwise(rest)


def _code(season: Column, episode: Column) -> Column:
    two = lambda n: F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    return F.when(season.isNotNull() & episode.isNotNull(), F.concat(F.lit("S"), two(season), F.lit("E"), two(episode)))


def episode_title(data: Column) -> Column:
    """The series' title, or what stands for it, with its episodes' codes."""
    series = first_of(text(data, "$.series.title"), text(data, "$.eventTitle"), text(data, "$.instanceName"), F.lit("Unknown"))
    episodes = F.coalesce(F.try_variant_get(data, "$.episodes", "array<variant>"), F.array().cast("array<variant>"))
    codes = F.array_compact(F.transform(episodes, lambda e: _code(whole_number(e, "$.seasonNumber"), whole_number(e, "$.episodeNumber"))))
    return F.when(F.size(codes) == 0, series).otherwise(F.concat(series, F.lit(" "), F.array_join(codes, ", ")))


def metadata_title(data: Column) -> Column:
    """A library item's title: show, code and title of an episode, title and year of a film, else its bare title."""
    at = "$.Metadata."
    kind, title = F.lower(text(data, at + "type")), text(data, at + "title")
    show, number, year = text(data, at + "grandparentTitle"), whole_number(data, at + "index"), whole_number(data, at + "year")
    code = _code(whole_number(data, at + "parentIndex"), number)
    bare = (title == "") | (F.lower(title) == F.concat(F.lit("episode "), number.cast("string")))
    head = F.concat(show, F.lit(" - "), code)
    episode = F.when((show != "") & code.isNotNull(), F.when(bare, head).otherwise(F.concat(head, F.lit(" - "), title)))
    film = F.when(title != "", F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(title))
    return F.coalesce(F.when(kind == "episode", episode).when(kind == "movie", film), first_of(title, F.lit("Plex item")))


def metadata_files(data: Column) -> Column:
    media = F.coalesce(F.try_variant_get(data, "$.Metadata.Media", "array<variant>"), F.array().cast("array<variant>"))
    parts = F.flatten(F.transform(media, lambda m: F.coalesce(F.try_variant_get(m, "$.Part", "array<variant>"), F.array().cast("array<variant>"))))
    return F.filter(F.transform(parts, lambda p: own_text(p, "$.file")), lambda f: f != "")


def _is_object(data: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(data, path, "variant")).startswith("OBJECT"), F.lit(False))


def payload_kind(data: Column, keys: Column, by_form: Column) -> Column:
    """The sender by the payload's shape, the first rule that fits."""
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    event = raw(data, "$.eventType") != ""
    return (
        F.when(by_form, "plex")
        .when(has("NotificationType"), "jellyfin")
        .when(has("Event") & _is_object(data, "$.Server"), "emby")
        .when(event & has("movie", "movieFile"), "radarr")
        .when(event & has("series", "episodeFile", "episodes"), "sonarr")
        .when(has("path"), "path")
        .otherwise("unknown")
    )


def routed(requests: DataFrame, servers: dict[str, bool] | None = None, enabled: bool = True) -> DataFrame:
    """The requests with kind, event, outcome, title, paths, deleted_paths, server, identity and item_id.

    ``outcome`` is invalid (no JSON object), test, disabled, ignored, ignored_no_path, resolve (an item that must be
    looked up by ``item_id``), queued, or for a server's own route not_configured or server_disabled; another route is
    unknown_route. ``server`` is the pin of the query string or of the route, ``identity`` what the sender says of itself.
    ``servers`` lists configured ids and whether they are enabled. Null route, form or body count as absent.
    """
    columns = requests.columns
    none = F.array().cast("array<string>")
    by_form = F.coalesce(F.col("form"), F.lit("")) != ""
    given = F.when(by_form & (F.col("_to").isin("plex", "router")), F.col("form")).otherwise(F.col("body"))
    own = requests.withColumn("_to", F.when(F.col("route").rlike("^(incoming|server/.+)$"), "router").otherwise(F.coalesce("route", F.lit(""))))
    own = own.withColumn("_given", given).withColumn("_keys", F.json_object_keys("_given")).withColumn("_data", F.when(F.col("_keys").isNotNull(), F.try_parse_json("_given")))
    data, keys, to = F.col("_data"), F.coalesce(F.col("_keys"), none), F.col("_to")
    own = own.withColumn("kind", F.when(to != "router", to).otherwise(payload_kind(data, keys, by_form)))
    kind = F.col("kind")
    arr, routes = kind.isin("sonarr", "sportarr"), ("radarr", "sonarr", "sportarr", "custom")
    event = (
        F.when(kind == "plex", text(data, "$.event"))
        .when(kind == "emby", first_of(text(data, "$.Event"), text(data, "$.event"), text(data, "$.NotificationType")))
        .when(kind == "jellyfin", first_of(text(data, "$.NotificationType"), text(data, "$.Event")))
        .otherwise(text(data, "$.eventType"))
    )
    movie = file_path(data, "movieFile", "$.movie.folderPath")
    episode = file_path(data, "episodeFile", "$.series.path", "$.filePath")
    plain = first_of(own_text(data, "$.path"), raw(data, "$.movieFile.path"), raw(data, "$.episodeFile.path"))
    item = F.when(kind == "emby", first_of(text(data, "$.Item.Path"), text(data, "$.Item.path"), text(data, "$.Metadata.Path"))).otherwise(
        first_of(text(data, "$.ItemPath"), text(data, "$.Path"), text(data, "$.path"))
    )
    several = F.coalesce(F.try_variant_get(data, "$.file_paths", "array<variant>"), F.array().cast("array<variant>"))
    custom = distinct_paths(F.concat(F.array(own_text(data, "$.file_path")), F.transform(several, lambda p: own_text(p, "$"))))
    one = lambda path: F.filter(F.array(path), lambda p: p != "")
    found = (
        F.when(kind == "custom", custom)
        .when(kind == "plex", metadata_files(data))
        .when(kind.isin("emby", "jellyfin"), one(item))
        .when(to == "router", one(plain))
        .when(kind == "radarr", one(movie))
        .when(arr, one(episode))
        .otherwise(none)
    )
    own = own.withColumn("event", event).withColumn("_paths", F.coalesce(found, none))
    item_id = F.when(kind == "plex", raw(data, "$.Metadata.ratingKey")).when(kind == "emby", first_of(raw(data, "$.Item.Id"), raw(data, "$.Item.guid"))).when(
        kind == "jellyfin", first_of(raw(data, "$.ItemId"), raw(data, "$.Id"))
    )
    own = own.withColumn("item_id", F.nullif(item_id, F.lit("")))
    event, have, known = F.col("event"), F.size("_paths") > 0, F.col("item_id").isNotNull()
    acted = (
        F.when(kind == "radarr", event.isin(*ARR_EVENTS["radarr"]))
        .when(arr, event.isin(*ARR_EVENTS["sonarr"]))
        .when(kind == "plex", event == "library.new")
        .when(kind.isin("emby", "jellyfin"), F.lower(event).isin(*ADDED))
        .otherwise(kind.isin("custom", "path"))
    )
    from_router = to == "router"
    configured = F.create_map(*[F.lit(x) for pair in (servers or {}).items() for x in pair]) if servers else F.create_map().cast("map<string,boolean>")
    pinned = F.nullif(F.regexp_extract("route", "^server/(.+)$", 1), F.lit(""))
    live = F.try_element_at(configured, pinned)
    empty = data.isNull() | (~from_router & (kind != "plex") & (F.size(keys) == 0))
    outcome = (
        F.when(~kind.isin(*routes, "plex", "jellyfin", "emby", "path", "unknown") | (~from_router & ~to.isin(*routes, "plex")), "unknown_route")
        .when(empty, "invalid")
        .when(pinned.isNotNull() & live.isNull(), "not_configured")
        .when(pinned.isNotNull() & ~live, "server_disabled")
        .when(~from_router & (F.when(kind == "plex", event == "test.ping").otherwise(event == "Test")), "test")
        .when(~from_router & F.lit(not enabled), "disabled")
        .when(from_router & (kind.isin("radarr", "sonarr", "path")), F.when(have, "queued").otherwise("ignored_no_path"))
        .when(~acted, "ignored")
        .when((kind == "plex") & ~known, "ignored_no_path")
        .when(have, "queued")
        .when(known, "resolve")
        .otherwise("ignored_no_path")
    )
    own = own.withColumn("outcome", outcome)
    worked = F.col("outcome").isin("queued", "resolve", "ignored_no_path") & (~from_router | kind.isin("plex"))
    title = (
        F.when(kind == "radarr", first_of(text(data, "$.movie.title"), F.lit("Unknown")))
        .when(arr, episode_title(data))
        .when(kind == "plex", metadata_title(data))
        .when(kind == "custom", first_of(text(data, "$.title"), F.element_at(F.split(F.coalesce(F.try_element_at("_paths", F.lit(1)), F.lit("")), "/"), -1)))
    )
    gone = F.when(kind == "radarr", replaced_files(data, "$.movie.folderPath", "$.movieFile.previousFile")).when(arr, replaced_files(data, "$.series.path"))
    identity = F.when(kind == "plex", raw(data, "$.Server.uuid")).when(kind == "emby", first_of(raw(data, "$.Server.Id"), raw(data, "$.Server.uuid"))).when(kind == "jellyfin", raw(data, "$.ServerId"))
    return own.select(
        *columns, "kind", "event", "outcome",
        F.when(worked, title).alias("title"),
        F.when(F.col("outcome") == "queued", F.col("_paths")).otherwise(none).alias("paths"),
        F.when((F.col("outcome") == "queued") & ~from_router, F.coalesce(gone, none)).otherwise(none).alias("deleted_paths"),
        F.coalesce(pinned, F.nullif(stripped(F.col("pin")), F.lit(""))).alias("server"),
        F.nullif(identity, F.lit("")).alias("identity"),
        "item_id",
    )

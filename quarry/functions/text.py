"""Scalar functions on titles, search strings, priorities, times and versions, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words dropped from the right end of a release name, as they are compared, in lower case.
RELEASE_WORDS = (
    "1080p", "2160p", "720p", "480p", "web", "webrip", "webdl", "web-dl", "bluray", "blu-ray", "bdrip", "brrip",
    "hdrip", "hdtv", "dvdrip", "x264", "x265", "h264", "h265", "h.264", "h.265", "hevc", "avc", "aac", "ac3", "dts",
    "eac3", "atmos", "ddp5", "ddp7", "remux", "proper", "repack", "extended", "uncut", "rarbg", "yify", "yts", "ettv",
    "eztv", "10bit", "8bit", "hdr", "hdr10", "dv", "sdr", "5.1", "7.1", "2.0",
)
#: Fixed patterns: an episode mark and its older form in a search string, an episode mark and a year in a file name.
EPISODE = r"(?U)\b[Ss](\d{1,3})[Ee](\d{1,4})\b"
CROSS = r"(?U)\b(\d{1,3})[xX](\d{1,4})\b"
FILE_EPISODE = r"(?U)\b[Ss](\d{1,3})[Ee](\d{1,3})\b"
YEAR = r"\((?:19|20)\d{2}\)"
#: Fixed patterns: what is cut from a folder's name, a leading article, a season's folder, an episode in a file name, and
#: a version with what may follow it.
FOLDER_YEAR, FOLDER_TAG = r"\s*\([0-9]{4}\)\s*", r"\s*\[[^]]+\]\s*"
ARTICLE = r"(?i)^(?:the|a|an)\s+"
SEASON_FOLDER, FOLDER_EPISODE = r"(?i)^season\b", r"(?i)(?:S\d+E\d+|s\d+e\d+|\d+x\d+)"
VERSION = r"^(\d+)\.(\d+)\.(\d+)(?:\.(?:post|dev)\d+)?(?:-[a-zA-Z0-9.-]+)?(?:\+[a-zA-Z0-9.-]+)?$"


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("int")


def _before(text: Column, pattern: str) -> Column:
    """What stands before the first match, the whole text where there is none."""
    return F.element_at(F.split(text, pattern, 2), 1)


def _without_first(text: Column, pattern: str) -> Column:
    return F.array_join(F.split(text, pattern, 2), "")


def spaced(raw: Column) -> Column:
    """Dots and underscores as spaces, so that a mark between them is found."""
    return F.trim(F.regexp_replace(raw, r"[._]+", " "))


def mark(raw: Column, group: int) -> Column:
    """Season (1) or episode (2) of the first SxxEyy, else of the first NxN; null without either."""
    text = spaced(raw)
    old = F.when(text.rlike(CROSS), F.regexp_extract(text, CROSS, group))
    return _number(F.when(text.rlike(EPISODE), F.regexp_extract(text, EPISODE, group)).otherwise(old))


def season(raw: Column) -> Column:
    return mark(raw, 1)


def episode(raw: Column) -> Column:
    return mark(raw, 2)


def is_junk(word: Column) -> Column:
    """A release word, brackets aside, or 3 to 12 letters of which at least half are capitals; nothing but brackets too."""
    bare = F.btrim(F.lower(word), F.lit("[]()"))
    raw = F.btrim(word, F.lit("-[]()"))
    capitals = F.length(F.regexp_replace(raw, r"\P{Lu}", ""))
    shouted = raw.rlike(r"^\p{L}{3,12}$") & (capitals * 2 >= F.length(raw))
    return (bare == "") | bare.isin(*RELEASE_WORDS) | shouted


def title_words(raw: Column) -> Column:
    """The words, lower-cased, without the episode mark and without the junk at the right end.

    Hyphens part words. The fold runs from the right and keeps everything once a word is no junk.
    """
    text = spaced(raw)
    text = F.when(text.rlike(EPISODE), _without_first(text, EPISODE)).otherwise(_without_first(text, CROSS))
    parts = F.filter(F.split(text, r"[\s\-]+"), lambda w: w != "")
    kept = F.aggregate(
        F.reverse(parts),
        F.array().cast("array<string>"),
        lambda done, w: F.when((F.size(done) == 0) & is_junk(w), done).otherwise(F.concat(done, F.array(w))),
    )
    return F.transform(F.reverse(kept), F.lower)


def parsed_query(raw: Column) -> Column:
    """struct(title, season, episode, tokens) of a search string; an empty or null one has no tokens."""
    parts = title_words(F.coalesce(raw, F.lit("")))
    return F.struct(
        F.array_join(parts, " ").alias("title"), season(raw).alias("season"), episode(raw).alias("episode"), parts.alias("tokens")
    )


def rank_score(name: Column, title: Column, tokens: Column | list[str], halved: Column) -> Column:
    """1 for the title itself, 0.8 if the name starts with it, 0.5 for all tokens, 0.2 for some; halved on request.

    Blanks around the name don't count; an empty or null name scores 0. Tokens as a list make plain comparisons.
    """
    low, wanted = F.trim(F.lower(name)), F.trim(F.lower(title))
    if isinstance(tokens, list):
        hits, most = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0)), F.lit(len(tokens))
    else:
        hits, most = F.size(F.filter(tokens, lambda t: F.contains(low, t))), F.size(tokens)
    score = (
        F.when((most == 0) | (F.coalesce(name, F.lit("")) == ""), 0.0).when(low == wanted, 1.0).when(low.startswith(wanted), 0.8)
        .when(hits == most, 0.5).when(hits > 0, 0.2).otherwise(0.0)
    )
    return F.when(halved, score * 0.5).otherwise(score)


def plain_key(title: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")


def episode_code(season_no: Column, episode_no: Column) -> Column:
    return F.format_string("S%02dE%02d", season_no, episode_no)


def clean_title(path: Column) -> Column:
    """A file name's title: ``Show SxxEyy`` where it has an episode mark, else up to its year, else without its extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    edge = F.lit(" -._")
    show = F.btrim(F.regexp_replace(F.btrim(_before(stem, FILE_EPISODE), edge), YEAR, ""), edge)
    number = lambda i: _number(F.regexp_extract(stem, FILE_EPISODE, i))
    film = F.btrim(F.regexp_extract(stem, f"(?s)^(.*?{YEAR})", 1), edge)
    return (
        F.when(stem.rlike(FILE_EPISODE), F.trim(F.concat(show, F.lit(" "), episode_code(number(1), number(2)))))
        .when(stem.rlike(YEAR), film)
        .otherwise(stem)
    )


def title_prefix(title: Column) -> Column:
    """The first word of a title without years, tags, a leading article and accents; null below two letters."""
    cut = F.regexp_replace(F.regexp_replace(title, FOLDER_YEAR, " "), FOLDER_TAG, " ")
    bare = F.trim(without_accents(F.regexp_replace(F.trim(F.regexp_replace(cut, r"\s+", " ")), ARTICLE, "")))
    first = F.regexp_extract(bare, r"^(\S+)", 1)
    return F.when(F.length(first) >= 2, first)


def folder_prefix(path: Column) -> Column:
    """struct(prefix, episode): the title prefix of the folder that names a file's show or film, and whether it is an episode.

    The folder is the one above the first season's, else the file's own. An episode is known by a season's folder or by
    its file name.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    at = F.array_min(F.array_compact(F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike(SEASON_FOLDER), i))))
    folder = F.when(at.isNotNull(), F.try_element_at(parts, at)).otherwise(F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))))
    episode = at.isNotNull() | F.element_at(parts, -1).rlike(FOLDER_EPISODE)
    return F.struct(title_prefix(folder).alias("prefix"), F.coalesce(episode, F.lit(False)).alias("episode"))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no expression for; a batch of plain ASCII comes back as it is."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """Letters without their combining marks, by Unicode decomposition."""
    def bare(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))

    return text.map(bare)


def priority(label: Column, number: Column | None = None) -> Column:
    """1 to 3, given as a number or as one of three labels in any case; 2 for anything else, digits as text too."""
    low = F.lower(label)
    named = F.when(low == "high", 1).when(low == "low", 3).otherwise(2)
    return named if number is None else F.when(number.isin(1, 2, 3), number).otherwise(named)


def version(value: Column) -> Column:
    """struct(major, minor, patch), which compares by parts; null where the text isn't a version of three parts.

    After the parts may come a post or dev release, a hyphened and a plus-signed suffix, which don't count.
    """
    bare = F.regexp_replace(value, "^v+", "")
    number = lambda i: _number(F.regexp_extract(bare, VERSION, i))
    return F.when(bare.rlike(VERSION), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def minutes(clock: Column) -> Column:
    """Minutes since midnight of HH:MM, null where it isn't a time of day."""
    h, m = F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 1), F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 2)
    ok = clock.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    return F.when(ok, _number(h) * 60 + _number(m))


def in_window(now: Column, start: Column, end: Column) -> Column:
    """Half open; past midnight where the end comes first; equal ends switch it off."""
    inside = F.when(start < end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))
    return F.coalesce((start != end) & inside, F.lit(False))


def in_any_window(at: Column, windows: list[tuple[str, str, tuple[str, ...]]], enabled: bool = True) -> Column:
    """Whether a time lies in one of the windows (start, end, days as ``mon`` to ``sun``; none means every day).

    Days are read without blanks and in any case; unknown ones don't count. Switched off, no time does. The day is the one of the time itself, so the part of a window after midnight counts for the day it falls on. A
    window with an invalid time counts for nothing.
    """
    now, today = F.hour(at) * 60 + F.minute(at), F.lower(F.date_format(at, "EEE"))
    found = F.lit(False)
    for start, end, days in windows:
        known = [d for d in (str(day).strip().lower() for day in days) if d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")]
        on = today.isin(*known) if known else F.lit(True)
        found = found | (on & in_window(now, minutes(F.lit(start)), minutes(F.lit(end))))
    return found & F.lit(enabled)


def backoff(attempt: Column, delay: Column, schedule: tuple[int, ...] = (60, 300, 900, 3600, 7200)) -> Column:
    """Seconds to wait: the schedule's step, scaled by delay/30 but at least by half, one second or more."""
    step = F.element_at(F.array(*map(F.lit, schedule)), F.least(attempt, F.lit(len(schedule))).cast("int"))
    return F.greatest(F.lit(1), F.floor(step * F.greatest(F.lit(0.5), delay / 30))).cast("long")


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def shortened(title: Column, width: int, kind: Column | None = None) -> Column:
    """Cut or padded to ``width`` characters: a cut episode keeps its last six after an ellipsis, a film ends in one.

    Without ``kind`` every title is an episode's. The show's part of an episode loses its outer spaces.
    """
    show = F.trim(F.substring(title, F.lit(1), F.greatest(F.length(title) - 6, F.lit(0))))
    last = F.concat(F.lit("..."), F.right(title, F.lit(6)))
    cut = F.concat(F.left(show, F.lit(max(width - 9, 0))), last) if width > 9 else last
    if kind is not None:
        film = F.concat(F.left(title, F.lit(max(width - 3, 0))), F.lit("..."))
        cut = F.when(kind == "episode", cut).otherwise(film)
    whole = F.when(F.length(title) > width, cut).otherwise(title)
    return F.when(F.length(whole) < width, F.rpad(whole, width, " ")).otherwise(whole)


def progress(line: Column) -> Column:
    """struct of a progress line's eleven fields, null where one is missing: counters, sizes, times and speed.

    ``seconds`` is what has been coded, from H:M:S with a fraction.
    """
    def text(name: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(line, rf"\b{name}=\s*({pattern})", 1), F.lit(""))

    clock = text("time", r"\d+:\d{2}:\d{2}(?:\.\d+)?")
    part = lambda i: F.split(clock, ":")[i].cast("double")
    return F.struct(
        text("frame", r"\d+").cast("long").alias("frame"),
        text("fps", r"[0-9.]+").cast("double").alias("fps"),
        text("q", r"-?[0-9.]+").cast("double").alias("q"),
        text("size", r"\d+").cast("long").alias("size_kb"),
        clock.alias("time"),
        (part(0) * 3600 + part(1) * 60 + part(2)).alias("seconds"),
        text("bitrate", r"[0-9.]+").cast("double").alias("bitrate"),
        text("dup", r"\d+").cast("long").alias("dup"),
        text("drop", r"\d+").cast("long").alias("drop"),
        text("speed", r"-?[0-9.]+(?=x)").cast("double").alias("speed"),
        text("elapsed", r"[0-9:.]+").alias("elapsed"),
    )


def percent(done: Column, total: Column) -> Column:
    """0 to 100, and 0 where the total isn't known."""
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), done / total * 100))).otherwise(0.0)


def eta(seconds: Column) -> Column:
    """Seconds as ``5s``, ``3m 5s`` or ``2h 3m``."""
    s = F.greatest(seconds, F.lit(0)).cast("int")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60).cast("int"), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")))
    )

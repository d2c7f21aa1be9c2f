"""Webhook requests: every route by literal payloads, and the stream by offsets against the batch."""

import json

import pytest

from quarry.operators import hooks
from quarry.sources import inbox, published

REQUESTS = "route string, pin string, form string, body string"


def _routed(spark, *requests, **options):
    rows = [(r, p, f if f is None or isinstance(f, str) else json.dumps(f), b if b is None or isinstance(b, str) else json.dumps(b)) for r, p, f, b in requests]
    return hooks.routed(spark.createDataFrame(rows, REQUESTS).coalesce(1), **options).collect()


def test_radarr(spark):
    body = {"eventType": " Download ", "movie": {"title": " Up ", "folderPath": "/m/Up"}, "movieFile": {"relativePath": "./a/../Up.mkv", "previousFile": {"path": "/m/Up/older.mkv"}},
            "deletedFiles": [{"path": "/m/Up/old.mkv"}, "junk", {"relativePath": "x.mkv"}, {"path": "/m//Up/./old.mkv"}, {}, 5]}
    cases = [
        (body, "queued", "Up", ["/m/Up/Up.mkv"], ["/m/Up/old.mkv", "/m/Up/x.mkv", "/m/Up/older.mkv"]),
        ({"eventType": "Download", "movie": "odd", "movieFile": {"path": "/m/../x.mkv "}}, "queued", "Unknown", ["/m/../x.mkv"], []),
        ({"eventType": "Download", "movie": {"title": "A"}}, "ignored_no_path", "A", [], []),
        ({"eventType": "Test"}, "test", None, [], []),
        ({"eventType": "Grab", "movieFile": {"path": "/x"}}, "ignored", None, [], []),
        ({}, "invalid", None, [], []), ("[1]", "invalid", None, [], []), ("{no", "invalid", None, [], []), (None, "invalid", None, [], []),
    ]
    found = _routed(spark, *[("radarr", " s1 ", None, b) for b, *_ in cases])
    assert [(r.outcome, r.title, r.paths, r.deleted_paths) for r in found] == [tuple(c[1:]) for c in cases]
    assert {r.server for r in found} == {"s1"} and {r.kind for r in found} == {"radarr"}


def test_sonarr_and_sportarr(spark):
    episodes = [{"seasonNumber": 1, "episodeNumber": 5}, "odd", {"seasonNumber": 12, "episodeNumber": 106}, {"seasonNumber": 1}]
    cases = [
        ({"eventType": "OnDownload", "series": {"title": "Show", "path": "/tv/Show/"}, "episodeFile": {"relativePath": "S1/e.mkv"}, "episodes": episodes, "deletedFiles": [{"relativePath": "../o.mkv"}]},
         "queued", "Show S01E05, S12E106", ["/tv/Show/S1/e.mkv"], ["/tv/o.mkv"]),
        ({"eventType": "Download", "eventTitle": "Cup Final", "filePath": " /sp/f.ts "}, "queued", "Cup Final", ["/sp/f.ts"], []),
        ({"eventType": "Download", "instanceName": "box", "series": [], "episodes": {}}, "ignored_no_path", "box", [], []),
        ({"eventType": "Rename"}, "ignored", None, [], []),
    ]
    for route in ("sonarr", "sportarr"):
        found = _routed(spark, *[(route, None, None, b) for b, *_ in cases])
        assert [(r.outcome, r.title, r.paths, r.deleted_paths) for r in found] == [tuple(c[1:]) for c in cases]


def test_plex(spark):
    base = {"event": "library.new", "Server": {"uuid": "u1"}}
    film = {"type": "movie", "title": "Up", "year": 2009, "ratingKey": 7, "Media": [{"Part": [{"file": "/a.mkv"}, {"file": " "}]}, {"Part": "odd"}, {"Part": [{"file": "/b.mkv"}]}]}
    episode = {"type": "Episode", "grandparentTitle": "Show", "parentIndex": 1, "index": 3, "title": "Pilot", "ratingKey": "9"}
    cases = [
        ({**base, "Metadata": film}, "queued", "Up (2009)", ["/a.mkv", "/b.mkv"], "7"),
        ({**base, "Metadata": episode}, "resolve", "Show - S01E03 - Pilot", [], "9"),
        ({**base, "Metadata": {**episode, "title": "Episode 3"}}, "resolve", "Show - S01E03", [], "9"),
        ({**base, "Metadata": {"type": "movie", "title": "Up"}}, "ignored_no_path", "Up", [], None),
        ({**base, "Metadata": {"type": "track", "title": "Song", "ratingKey": "4"}}, "resolve", "Song", [], "4"),
        ({**base, "Metadata": 3}, "ignored_no_path", "Plex item", [], None),
        ({"event": "test.ping"}, "test", None, [], None),
        ({"event": "media.play", "Metadata": film}, "ignored", None, [], "7"),
    ]
    found = _routed(spark, *[("plex", None, b, "--boundary") for b, *_ in cases], ("plex", None, None, cases[0][0]), ("plex", None, "nope", "{}"))
    assert [(r.outcome, r.title, r.paths, r.item_id) for r in found[: len(cases)]] == [tuple(c[1:]) for c in cases]
    assert found[-2].outcome == "queued" and found[-1].outcome == "invalid" and found[0].identity == "u1"


def test_custom(spark):
    cases = [
        ({"file_path": "/a/./b.mkv", "file_paths": ["/a/b.mkv", " /c ", "", 5, "/c/"]}, "queued", "b.mkv", ["/a/b.mkv", "/c"]),
        ({"file_path": "..\\x", "title": " T "}, "queued", "T", ["../x"]),
        ({"file_paths": "odd"}, "ignored_no_path", "", []),
        ({"eventType": "Test"}, "test", None, []),
    ]
    found = _routed(spark, *[("custom", "", None, b) for b, *_ in cases])
    assert [(r.outcome, r.title, r.paths) for r in found] == [tuple(c[1:]) for c in cases] and found[0].server is None
    assert [r.outcome for r in _routed(spark, ("custom", None, None, cases[0][0]), ("custom", None, None, {"eventType": "Test"}), enabled=False)] == ["disabled", "test"]


def test_router(spark):
    cases = [
        (None, {"NotificationType": "ItemAdded", "ItemId": "i1", "ServerId": "j"}, "jellyfin", "resolve", []),
        (None, {"NotificationType": "ItemAdded", "ItemPath": "/j.mkv"}, "jellyfin", "queued", ["/j.mkv"]),
        (None, {"NotificationType": "PlaybackStart", "ItemPath": "/j.mkv"}, "jellyfin", "ignored", []),
        (None, {"Event": "library.new", "Server": {"Id": "e"}, "Item": {"Id": "4", "Path": "/e.mkv"}}, "emby", "queued", ["/e.mkv"]),
        (None, {"Event": "library.new", "Server": "x", "path": "/p"}, "path", "queued", ["/p"]),
        (None, {"eventType": "Download", "movie": {}, "movieFile": {"path": "/m"}}, "radarr", "queued", ["/m"]),
        (None, {"eventType": "Download", "episodes": []}, "sonarr", "ignored_no_path", []),
        (None, {"path": None}, "path", "ignored_no_path", []), (None, {"path": 5}, "path", "ignored_no_path", []),
        (None, {"other": 1}, "unknown", "ignored", []),
        (None, "plain words", "unknown", "invalid", []),
        ({"event": "library.new", "Metadata": {"ratingKey": 3}}, "--form", "plex", "resolve", []),
    ]
    for route in ("incoming", "server/s1"):
        found = _routed(spark, *[(route, None, f, b) for f, b, *_ in cases], servers={"s1": True, "s2": False})
        assert [(r.kind, r.outcome, r.paths) for r in found] == [tuple(c[2:]) for c in cases]
        assert {r.server for r in found} == {None if route == "incoming" else "s1"}
    body = {"path": "/p"}
    found = _routed(spark, ("server/s2", None, None, body), ("server/zz", None, None, body), ("nowhere", None, None, body), (None, None, None, body), servers={"s1": True, "s2": False})
    assert [r.outcome for r in found] == ["server_disabled", "not_configured", "unknown_route", "unknown_route"]


@pytest.mark.parametrize("path,normal", [("/a/../../b", "/b"), ("../a/../..", "../.."), ("a//b/.", "a/b"), ("./", "."), ("/", "/"), ("/..", "/"), ("a\\b", "a/b")])
def test_normal_paths(spark, path, normal):
    assert spark.createDataFrame([(path,)], "p string").select(hooks.normal_path(hooks.F.col("p")).alias("n")).first().n == normal


def test_stream_goes_on_behind_its_last_segment(spark, tmp_path):
    spark.dataSource.register(published.OutboxSource)
    box, out = tmp_path / "box", str(tmp_path / "out")

    def close(n, *lines):
        (box / f"segment={n}").mkdir(parents=True)
        (box / f"segment={n}" / "part.json").write_text("\n".join(lines))

    def run():
        rows = hooks.routed(inbox.stream(spark, str(box))).select("segment", "line", "route", "outcome")
        query = rows.writeStream.format("quarry_outbox").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    request = lambda route, body: json.dumps({"route": route, "body": body})
    close(0, request("custom", {"file_path": "/a"}), "not json", "[1]", request("radarr", '{"eventType":"Test"}'))
    close(1, request("incoming", {"path": "/b"}))
    run()
    read = lambda: sorted((r.segment, r.line, r.outcome) for r in published.pushed(spark, out, "segment long, line int, route string, outcome string").collect())
    first = [(0, 0, "queued"), (0, 1, "unknown_route"), (0, 2, "unknown_route"), (0, 3, "test"), (1, 0, "queued")]
    assert read() == first
    for note in (tmp_path / "cp" / "commits").glob("*0*"):
        note.unlink()
    run()  # the same offsets again
    close(3, request("custom", {"file_path": "/later"}))  # behind one that isn't closed yet
    run()
    assert read() == first
    close(2, request("custom", {}))
    run()
    assert read() == first + [(2, 0, "invalid"), (3, 0, "queued")]
    assert sorted((r.segment, r.line, r.outcome) for r in hooks.routed(inbox.batch(spark, str(box))).collect()) == read()


def test_empty_inbox(spark, tmp_path):
    assert hooks.routed(inbox.batch(spark, str(tmp_path / "none"))).count() == 0

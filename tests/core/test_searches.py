"""Searches over a small catalogue by their own rules, and queries that are read once."""

from quarry.functions import text as T
from quarry.operators import search

CATALOGUE = "id int, kind string, name string, turn int, path string, show_id int, season int, episode int"
ROWS = [
    (1, "show", "The Boys", 1, None, None, None, None), (2, "show", "The Boys Life", 2, None, None, None, None), (3, "movie", "The Boys", 3, "/m3", None, None, None),
    (4, "movie", "Wonder Boys", 4, "/m4", None, None, None), (5, "movie", "Bad Boys", 5, None, None, None, None),
    (11, "episode", "The Boys Life S01E01", 11, "/e11", 2, 1, 1), (12, "episode", "The Boys Life S01E02", 12, "/e12", 2, 1, 2), (13, "episode", "The Boys Life S02E01", 13, "", 2, 2, 1),
    (14, "episode", "The Boys Life S01E01", 14, "/e14", 2, 1, 1), (12, "episode", "again", 15, "/e12b", 2, 1, 2),
]


def _ids(rows):
    return [r.id for r in sorted(rows.collect(), key=lambda r: r.place)]


def _catalogue(spark):
    return spark.createDataFrame(ROWS, CATALOGUE)


def test_series_first(spark):
    table = _catalogue(spark)
    # The first show by turn has no episodes, so the next that begins alike answers.
    assert _ids(search.series_first(table, "the boys")) == [11, 14, 12]
    assert _ids(search.series_first(table, "The.Boys.S01E02")) == [12]
    assert _ids(search.series_first(table, "the boys s02e01")) == []
    assert _ids(search.series_first(table, "the boys", 1)) == [11] and _ids(search.series_first(table, "  ")) == []
    # No show begins so: all score alike, and the first show by turn that has episodes closes the answer.
    assert _ids(search.series_first(table, "boys")) == [11, 14, 12]
    films_first = spark.createDataFrame([(*r[:3], -r[0] if r[1] == "movie" else r[3], *r[4:]) for r in ROWS], CATALOGUE)
    assert _ids(search.series_first(films_first, "boys")) == [4, 3, 11, 14, 12] and _ids(search.series_first(films_first, "boys", 2)) == [4, 3]
    assert _ids(search.series_first(table, "onder boys")) == [4]


def test_hub_and_preview_search(spark):
    table = _catalogue(spark)
    assert _ids(search.hub_search(table, "the boys")) == [3, 11, 14, 12, 12, 11, 12, 14]
    assert _ids(search.hub_search(table, "the boys s01e02"))[:1] == [12] and _ids(search.hub_search(table, "")) == []
    assert _ids(search.preview_search(table, "boys life")) == [11, 14, 12, 13]
    assert _ids(search.preview_search(table, "boys s01e02")) == [12]
    assert _ids(search.preview_search(table, "boys")) == [11, 14, 12, 13, 3, 4, 5] and _ids(search.preview_search(table, "b")) == []


def test_two_pass_gives_an_id_once(spark):
    shows = spark.createDataFrame([(1, "Alpha"), (2, "Alpha Two")], "show_id int, name string")
    episodes = spark.createDataFrame([(1, 1, 1, 7), (2, 1, 1, 7), (2, 1, 2, 8), (1, 2, 1, 9)], "show_id int, season int, episode int, id int")
    found = search.two_pass(shows, episodes, "alpha", 10, 2).collect()
    assert [(r.id, r.show_id) for r in found] == [(7, 1), (9, 1)]


def test_the_search_is_read_once(spark):
    q = search.parsed(spark, "The.Boys.S01E02.1080p")
    assert (q.title, q.tokens, q.season, q.episode, q.one_episode) == ("the boys", ("the", "boys"), 1, 2, True)
    plan = spark.range(1).select(q.score(T.F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "aggregate" not in plan


def test_names_are_trimmed_and_empty_ones_score_nothing(spark):
    rows = spark.createDataFrame([(" The Boys ",), ("",), (None,), ("the boys are",)], "n string")
    q = search.parsed(spark, "the boys")
    assert [r.s for r in rows.select(q.score(T.F.col("n")).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.8]
    column = T.rank_score(T.F.col("n"), T.F.lit("the boys"), T.F.array(T.F.lit("the"), T.F.lit("boys")), T.F.lit(False))
    assert [r.s for r in rows.select(column.alias("s")).collect()] == [1.0, 0.0, 0.0, 0.8]


def test_windows_with_loose_days(spark):
    at = spark.sql("SELECT TIMESTAMP '2024-01-05 12:30:00' AS at")  # a Friday
    on = lambda windows, **o: at.select(T.in_any_window(T.F.col("at"), windows, **o).alias("q")).first().q
    assert on([("12:00", "13:00", (" Fri ",))]) and not on([("12:00", "13:00", ("sat", " SUN"))]) and not on([("12:00", "13:00", ())], enabled=False)

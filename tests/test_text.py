"""Text scans."""

from grainline.functions.text import missing_markers, phrase_hits


def test_phrase_hits_whole_words_any_case(spark):
    df = spark.createDataFrame(
        [(1, "We JOIN tables"), (2, "rejoined later"), (3, "use rank(x) and window=3"), (4, "fan-out, NULLs; not in"), (5, "éjoin")],
        "id int, text string",
    )
    got = {(r.id, r.phrase) for r in phrase_hits(df, "id", "text").collect()}
    assert got == {(1, "join"), (3, "rank("), (3, "window="), (4, "fan-out"), (4, "nulls"), (4, "not in")}


def test_missing_markers(spark):
    df = spark.createDataFrame([(1, "cumsum( x )", ["Q4", "Q1"]), (2, "partition_by = y", ["Q1", "Q9"])], "id int, q string, rows array<string>")
    markers = {"Q1": ("partition_by",), "Q4": ("time_shift", "cumsum", "change")}
    got = {(r.id, r.label) for r in missing_markers(df, "id", "q", "rows", markers).collect()}
    assert got == {(1, "Q1")}

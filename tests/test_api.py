"""Whole searches on a small library."""

import datetime as dt

import pytest

from shoal.operators import api as A


def axis(k, n=4):
    return [1.0 if i == k else 0.0 for i in range(n)]


@pytest.fixture(scope="module")
def library(spark):
    day = lambda y, m=1, d=1: dt.datetime(y, m, d)
    photos = spark.createDataFrame(
        [(1, day(2021, 12), "San Francisco, California", "phone", False), (2, day(2021, 6), "San Francisco, California", "phone", False), (3, day(2020, 6), "Rome, Italy", "tab", False), (4, day(2020, 7), "Rome, Italy", None, True),
         (5, None, None, "tab", False), (6, day(2021, 12, 2), "Rome, Italy", "tab", False), (7, day(2021, 12, 3), "Rome, Italy", "tab", False)], "photo_id long, ts timestamp_ntz, place string, device_id string, is_deleted boolean")
    people = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (6, 12), (7, 12)], "photo_id long, person_id long")
    persons = spark.createDataFrame([(10, "Mar", None), (11, "Anna", None), (12, None, 11), (13, "Zoe", None)], "person_id long, name string, merged_into long")
    aliases = spark.createDataFrame([("Rome, Italy", "Grandma")], "place string, alias string")
    members = spark.createDataFrame([("f", 1), ("f", 3), ("f", 4), ("g", 5)], "folder string, photo_id long")
    groups = spark.createDataFrame([(6, 6), (7, 6), (3, 3), (4, 3)], "photo_id long, rep long")
    vectors = spark.createDataFrame([(1, axis(0), None), (2, axis(1), [axis(2), axis(0)]), (3, axis(0), []), (4, axis(0), None), (5, axis(3), None), (6, [0.6, 0.8, 0.0, 0.0], None), (7, [0.8, 0.6, 0.0, 0.0], None)],
                                    "photo_id long, v array<double>, frames array<array<double>>")
    return A.Library(photos, people, persons, aliases, members, groups, vectors)


def encode(caption):
    return {"beach": axis(0), "marble countertop": axis(1), "decorations": axis(0), "cat": axis(3)}[caption]


def ids(df):
    return [r["photo_id"] for r in df.collect()]


def api(library, *, use=encode, floor=0.25, **request):
    return A.api_search(library, A.Request(**request), use, floor)


def test_requests(library):
    assert ids(api(library)) == [7, 1, 2, 3, 5]  # newest first, one of 6 and 7, none that is deleted, no date last
    assert ids(api(library, device="phone")) == [1, 2] and ids(api(library, folder="f")) == [1, 3] and ids(api(library, folder="none")) == []
    assert ids(api(library, names=["anna"])) == [7, 2, 3] and ids(api(library, names=["Anna", "mar"])) == [2] and ids(api(library, names=["Anna", "nobody"])) == []
    assert ids(api(library, timestamp="2021-12")) == [7, 1] and ids(api(library, location="rome")) == [7, 3] and ids(api(library, location="grandma")) == [7, 3]
    with pytest.raises(Exception, match="not a time"):
        api(library, timestamp="soon").collect()


def test_captions_collapse_and_pages(library):
    rows = api(library, caption="beach").collect()
    assert [(r["photo_id"], r["score"], r["dup_count"], r["rank"], r["total"]) for r in rows] == [(1, 1.0, 1, 1, 4), (2, 1.0, 1, 2, 4), (3, 1.0, 1, 3, 4), (7, 0.8, 2, 4, 4)]  # 2 by a frame
    assert [r["people"] for r in rows] == ["Mar", "Anna, Mar", "Anna", "Anna"]
    page = api(library, caption="beach", limit=2, offset=1).collect()
    assert [(r["photo_id"], r["rank"], r["total"], r["pages"]) for r in page] == [(2, 2, 4, 2), (3, 3, 4, 2)]
    assert ids(api(library, caption="beach", use=None)) == [7, 1, 2, 3, 5]


def test_free_text(library):
    said = A.interpreted(library, A.Request(q="Anna at grandma beach in june 2020"))
    assert (list(said.names), said.location, said.timestamp, said.caption) == (["Anna"], "grandma", "2020-06", "beach")
    assert ids(api(library, q="Anna at grandma beach in june 2020")) == [3]
    over = A.interpreted(library, A.Request(q="Anna at grandma beach in june 2020", names=["Mar"], timestamp="2021", location="francisco", caption="cat"))
    assert (over.names, over.location, over.timestamp, over.caption) == (["Mar"], "francisco", "2021", "cat")


def test_structured(library):
    of = lambda q, folder=None: A.structured(library, q, folder)
    rows, caption = of("marble countertop")  # Mar is no word of it
    assert sorted(ids(rows)) == [1, 2, 3, 5, 6, 7] and caption == "marble countertop"
    rows, caption = of("mar")
    assert sorted(ids(rows)) == [1, 2] and caption == ""
    assert sorted(ids(of("decorations 2021")[0])) == [1, 2, 6, 7] and of("decorations 2021")[1] == "decorations"
    assert sorted(ids(of("december 2021")[0])) == [1, 6, 7] and of("december 2021")[1] == ""
    rows, caption = of("san francisco or grandma may")  # any place; a month without a year stays
    assert sorted(ids(rows)) == [1, 2, 3, 6, 7] and caption == "or may"
    assert sorted(ids(of("anna mar")[0])) == [1, 2, 3, 6, 7] and ids(of("anna", "f")[0]) == [3]  # any person
    assert of("  ")[1] == "" and ids(of("  ")[0]) == []
    assert ids(A.structured_search(library, "decorations 2021", None, encode)) == [1, 2, 7, 6]
    assert ids(A.structured_search(library, "december 2021")) == [7, 6, 1]


def test_folders_and_similar_photos(library):
    of = lambda *a, **b: ids(A.smart_folder(library, A.Folder(*a, **b), encode))
    assert of("s", anchor=1) == [2, 3, 7, 6] and of("s", anchor=1, least=0.7) == [2, 3, 7]
    assert of("s", "beach", least=0.9) == [1, 2, 3] and of("s", "beach", minus="marble countertop", least=0.9) == []
    assert of("s", "december 2021") == [7, 6, 1] and sorted(of("f")) == [1, 3] and of("s", anchor=99) == []
    assert [(r["photo_id"], r["score"]) for r in A.similar_photos(library, 2).collect()] == [(1, 1.0), (3, 1.0), (6, 0.8), (7, 0.8)]  # by its own vector or a frame
    assert ids(A.similar_photos(library, 2, 1)) == [1] and ids(A.similar_photos(library, 99)) == []

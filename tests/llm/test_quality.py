import random

import pytest
from vectide.llm import quality as Q

COMMON = [("en", w) for w in "the of and in to is was by from with".split()] + [("de", w) for w in "der die und ist von in zu".split()] + [("en", None), (None, "x")]
SCHEMA = "id long, content string, lang string, stat int, score string"
PROSE = "The wall of Gor was old and the river ran by the mill. It is said to come from the hills in the north."


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame(COMMON, "lang string, word string")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", 1, "s") for i, t in rows], SCHEMA)


def test_statistics():
    lists = {"de": frozenset(["der", "die", "in"]), "en": frozenset(["the", "of", "in"])}
    assert Q.statistics("The wall of Gor.\n\nin-the sun", lists) == (7, 20 / 7, 2 / 22, 0.5, 4 / 7, "en")
    assert Q.statistics(" \n ", lists) == (0, 0.0, 0.0, 0.0, 0.0, "")


def test_ranks_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["en", "en", "de"]), s, r.choice([1.0, 1.0, 1.0, round(r.random(), 2)])) for i in range(400) for s in range(2)]
    df = spark.createDataFrame(rows, "id long, lang string, stat int, value double")
    got = {(x["id"], x["stat"]): (x["below"], x["upto"], x["total"]) for x in Q.ranks(df, 7).collect()}
    for i, lang, s, v in rows:
        own = [b for _, a, t, b in rows if a == lang and t == s]
        assert got[i, s] == (sum(b < v for b in own), sum(b <= v for b in own), len(own))
    assert len(got) == len(rows) and Q.ranks(df.where("false"), 3).count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, "prose"), ("• old wall\n• wide river\n• mill of Gor\n• stone bridge", "list"), ("1) old wall\n2) wide river\n3) mill of Gor\n4) bridge", "list"),
        ("Old wall ........ 4\nWide river of Gor ........ 9\nMill .......... 12", "list"), ("Gor: old wall\nHal: wide river\nNor: mill of Gor\nTal: bridge", "list"),
        ("name\tsize\nGor\t12\nHal\t13\nNor\t99", "table"), ("a,b,c\nGor,12,n/a\nHal,5,1999-01-02\nNor,7,n/a", "table"), ("name    size\nGor     12\nHal     13", "table"),
        ("9f" * 300, "junk"), ("+++---===///" * 20, "junk"), ("xqz vbbt rrkl wpsd qqtz bnmk ghjk plkj zxcv", "junk"), ("T h e w ! l l o f G o r i s o l d", "junk"), ("Home Login Help Home Top Home Back Login Help Home", "junk"),
    ],
)
def test_kinds(text, kind):
    lists: dict = {}
    for lang, w in COMMON:
        if lang and w:
            lists.setdefault(lang, set()).add(w)
    lists = {k: frozenset(v) for k, v in lists.items()}
    s = Q.statistics(text, lists)
    assert Q.kind_of(text, s, lists.get(s[5], frozenset())) == kind


def test_tables(spark, common):
    r = random.Random(2)
    prose = [(i, " ".join(r.choice(["The wall of Gor was old.", "A mill is by the river.", "It came from the north in the end."]) for _ in range(r.randint(3, 12)))) for i in range(60)]
    odd = [(100, "• old wall\n• wide river\n• mill of Gor\n• stone bridge"), (101, "name\tsize\nGor\t12\nHal\t13\nNor\t99"), (102, "9f" * 300), (103, ""), (104, None), (105, " \n"), (100, "• old wall\n• wide river\n• mill of Gor\n• stone bridge"), (None, "x"), (106, PROSE * 3000)]
    df = frame(spark, prose + odd)
    assert {x[:] for x in Q.found(df, common).select("id", "content_kind").collect()} == {(100, "list"), (101, "table"), (102, "junk")}
    rows = {x["id"]: x for x in Q.scored(df, common).collect()}
    assert len(rows) == 64 and max(rows[i]["score"] for i in range(60)) < rows[102]["score"] and all(len(x["tails"]) == 5 and min(x["tails"]) > 0 for x in rows.values())
    assert Q.stats(df, common).count() == 66
    assert Q.found(df.where("false"), common).count() == 0 and Q.stats(df, common.where("false")).where("common_share > 0").count() == 0


def test_common_kinds_are_found(spark, common):
    items, cells = "• old wall\n• wide river\n• mill of Gor\n• stone bridge", "name\tsize\nGor\t12\nHal\t13\nNor\t99"
    prose = [(i, f"{PROSE} The end of it was {i} in the north.") for i in range(40)]
    lists = [(100 + i, items) for i in range(20)] + [(100, items)]
    assert {x[:] for x in Q.found(frame(spark, prose + lists), common).collect()} == {(i, "list") for i in range(100, 120)}
    assert {x[:] for x in Q.found(frame(spark, [(1, items), (2, cells)]), common).collect()} == {(1, "list"), (2, "table")}

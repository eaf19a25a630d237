import pytest
from hypothesis import given, settings, strategies as st
from vectide.llm import splitting as S

words = st.lists(st.sampled_from(["wall", "the", "old.", "river,", "mill;", "\n", "\n\n", "x" * 37, "é", "𝄞"]), min_size=0, max_size=400).map(" ".join)


def check(text, limit, overlap):
    parts = S.cuts(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in parts) == text
    for i, (opens, own, end) in enumerate(parts):
        assert end - opens <= limit and opens <= own <= end and (i == 0 or own > opens or overlap == 0 or parts[i - 1][1] == own)
        assert own - opens <= overlap and (own < end or not text)
    return parts


@settings(max_examples=150, deadline=None)
@given(words, st.integers(30, 200), st.integers(0, 14))
def test_round_trip_and_limits(text, limit, overlap):
    check(text, limit, overlap)


@pytest.mark.parametrize("text", ["", "short", "x" * 5000, " " * 3000, "\n" * 3000, "ab " * 40_000])
def test_extremes(text):
    check(text, 1200, 120)


def test_pieces_are_balanced_and_natural():
    text = " ".join(f"Sentence number {i} of the wall." for i in range(120))
    parts = check(text, 1200, 120)
    assert len(parts) == -(-(len(text) - 120) // 1080)
    own = [e - s for _, s, e in parts]
    assert max(own) - min(own) < 400
    assert all(text[:e].rstrip().endswith(".") for _, _, e in parts[:-1])
    assert all(80 <= s - o <= 120 for o, s, _ in parts[1:])


def test_paragraphs_win():
    text = "w " * 290 + "\n\n" + "v " * 310
    assert S.cuts(text, 1200, 100)[0][2] == 582


def test_bad_overlap():
    with pytest.raises(ValueError):
        S.cuts("x" * 100, 50, 30)


def test_tables(spark):
    long = "The wall is old. " * 200
    rows = [(1, long, 9), (1, long, 9), (2, "x" * 1200, 1), (3, "x" * 1201, 1), (4, None, 1), (5, "", 1)]
    df = spark.createDataFrame(rows, "id long, content string, piece_index int")
    assert sorted(r["id"] for r in S.oversized(df).collect()) == [1, 3]
    got = S.split_chunks(df).orderBy("id", "piece_index").collect()
    assert [r["piece_index"] for r in got if r["id"] == 1] == list(range(len(S.cuts(long)))) and not [r for r in got if r["id"] == 4]
    assert [r["piece"] for r in got if r["id"] == 5] == [""]
    assert "".join(r["piece"][r["overlap_chars"] :] for r in got if r["id"] == 1) == long
    assert S.split_chunks(df.where("false")).count() == 0 and S.oversized(df.where("false")).count() == 0

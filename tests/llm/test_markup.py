import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from vectide.llm import markup as M
from vectide.llm import markup_train
from vectide.llm.markup_leaves import leaves

SCHEMA = "id long, content string, clean_text int, marked string"


def one(text):
    (t, items, y), = M.process([text])
    return M.is_marked(items, y), *M.render(t, items, y)


@pytest.mark.parametrize(
    "text",
    [
        "<h4>Great hall</h3>\nThe wall lost its mill to a fire.", "The wall is <b>old</b> and the river is wide.", "The wall&mdash; is old.", "# Great hall\n\nThe wall is old.",
        "The wall is `old` and wide.", "The wall is [old](/notes/wall.md) and wide.", "'''Wall''' is the name of a wall.", "The [[wall|old wall]] stands by the river.",
        "The wall stands.\n[[Category:Old walls]]", "The wall stands \\cite{wall1999}. It is old.", "The wall, where $a_i \\leq 56$, is old.", "\\section{Great hall}\nThe wall is old.",
        "The wall stands.<!-- old note --> It is wide.", "The wall stands.\n```\nSELECT a FROM b;\n```\nIt is wide.", "{{Infobox wall\n| name = Gor\n| area = 84\n}}\nThe wall is old.", "The wall is wide~~ and old.",
    ],
)
def test_markup_is_seen(text):
    assert one(text)[0]


@pytest.mark.parametrize(
    "text",
    [
        "", " \n ", "The wall is old and wide.", "Lamps cost $15, later $40 (in 1890).", "See D:\\logs\\march and E:\\old for 12 more.", "A footnote [4] and a gap [...] remain.",
        "With q < 0.05 and r >= 12 we stop, else x<3 holds.", "Tiles of 12 * 30 mm, later 3^4, fit.", "- one wall\n- two walls\n- three walls", "1) one wall\n2) two walls", "Set max_rows = 5 or leave {} there.",
        "Rows [[3, 4], [5, 6]] and [0.2, -0.7] were read.", "+-+-+-+-////+-+-+-....+-+-+-+-////+-+-+-", "Pipes of 3'' and 5'' were laid.", "Mills & Sons, No. #4, took ~30 % of it.", "Water -> steam -> power => light.",
    ],
)
def test_plain_signs_stay(text):
    marked, clean, _ = one(text)
    assert not marked and clean == text


def test_clean_text_keeps_structure():
    text = "<h2>Great hall</h2>\nThe wall is <b>old</b> &amp; wide.\n<ul><li>one wall</li><li>two walls</li></ul>\nHere $a_i \\leq 56$ holds.\n<pre><code>SELECT a FROM b;</code></pre>\nEnd of the wall."
    marked, clean, blocks = one(text)
    kinds = [k for k, _ in blocks]
    assert marked and "heading" in kinds and "list" in kinds and "code" in kinds and "formula" in kinds
    assert "Great hall" in clean and "- one wall" in clean and "$a_i \\leq 56$" in clean and "SELECT a FROM b;" in clean and "old & wide" in clean
    assert not any(s in clean for s in ("<b>", "<li>", "<h2>", "</ul>", "&amp;", "<pre>"))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab <>[]{}|\\`*_#=~^$&'!-\n/\"", max_size=120))
def test_leaves_cover_any_text(text):
    items = leaves(text)
    assert "".join(text[x.start : x.end] for x in items) == text
    assert all(a.end == b.start for a, b in zip(items, items[1:], strict=False))
    one(text)


def test_long_sequences_are_labelled_whole():
    text = "The wall is <b>old</b> and wide. " * 2500
    items = leaves(text)
    y = M.label([M.features(text, items)])[0]
    assert len(items) > 4 * M.SPAN
    tags = np.array([x.shape == "tag" for x in items])
    assert (y[tags] > M.LITERAL).mean() > 0.99


def test_state_is_carried_over_spans(monkeypatch):
    maker = markup_train.Maker(17)
    rows = [M.features(t, leaves(t)) for t in ("\n".join(maker.document()[0] for _ in range(n)) for n in (1, 4, 9, 30))]
    want = M.label(rows)
    for span in (7, 50):
        monkeypatch.setattr(M, "SPAN", span)
        assert all((a == b).all() for a, b in zip(M.label(rows), want, strict=True))


def test_families_can_be_left_out():
    maker = markup_train.Maker(3, markup_train.UNSEEN, "never")
    text = "".join(s for _ in range(300) for s, _ in maker.literal())
    assert " >= " in text and "US$" in text and "<=>" not in text and "°" not in text
    assert len(markup_train.sample(20, 4, markup_train.UNSEEN)) == 20
    recall, precision = markup_train.families(M.weights(), 300)
    assert recall > 0.95 and precision > 0.95


def test_held_out_accuracy_of_the_shipped_weights():
    leaf, text = markup_train.accuracy(M.weights(), 400, seed=991)
    assert leaf > 0.99 and text > 0.98


def test_training_learns():
    p = markup_train.train(documents=1500, epochs=8, seed=3, say=lambda _: None)
    leaf, _ = markup_train.accuracy(p, 120, seed=5)
    assert leaf > 0.75


def test_gradients():
    data = markup_train.sample(6, 1)
    rows = [d for d in data if len(d[0]) <= 12][:3] or data[:1]
    n = max(len(a) for a, _ in rows)
    x, y, mask = np.zeros((n, len(rows), 12), np.int32), np.zeros((n, len(rows)), np.int64), np.zeros((n, len(rows)), bool)
    for i, (a, b) in enumerate(rows):
        x[: len(a), i], y[: len(a), i], mask[: len(a), i] = a, b, True
    p = {k: v.astype(np.float64) for k, v in markup_train.start(0).items()}
    _, g = markup_train.gradients(p, x, y, mask)
    for name in ("hf", "xb", "o", "cb"):
        at = tuple(s // 2 for s in p[name].shape)
        old, eps = p[name][at], 1e-3
        p[name][at] = old + eps
        up, _ = markup_train.gradients(p, x, y, mask)
        p[name][at] = old - eps
        down, _ = markup_train.gradients(p, x, y, mask)
        p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-5)


def test_tables(spark):
    rows = [(1, "The <b>old</b> wall stands here.", 5, "x"), (1, "The <b>old</b> wall stands here.", 5, "x"), (2, None, None, None), (3, "", 1, ""), (4, "Plain words.", 1, ""), (None, "<p>no id</p>", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["id"] or 0) for r in M.found(df).collect()) == [0, 1]
    got = {r["id"]: r for r in M.clean(df).collect()}
    assert got[1]["clean_text"] == "The old wall stands here." and got[2]["clean_text"] is None and got[3]["clean_text"] == "" and not got[4]["marked"]
    assert M.found(df.where("false")).count() == 0 and M.clean(df.where("false")).count() == 0

import random

import pytest
from hypothesis import given, settings, strategies as st
from vectide.llm import leakage as L
from vectide.llm.words import words

V = [f"w{i}" for i in range(300)]


def case(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(V) for _ in range(r.randint(8, 60)))) for i in range(20)]
    docs = []
    for d in range(120):
        w = [r.choice(V) for _ in range(r.randint(0, 80))]
        if r.random() < 0.6:
            i, t = r.choice(items)
            part = words(t)
            at, n = r.randrange(max(1, len(part) - 11)), r.randint(9, 40)
            part = part[at : at + n]
            if r.random() < 0.3 and part:
                part[r.randrange(len(part))] = "odd"
            k = r.randint(0, len(w))
            w[k:k] = part
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w).upper() if r.random() < 0.5 else " ".join(w)))
    return items, docs


def brute(items, docs, window=12):
    out = set()
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}
        for d, x in docs:
            v = words(x)
            if any(tuple(v[k : k + window]) in grams for k in range(len(v) - window + 1)):
                out.add((d, i))
    return out


def frames(spark, items, docs):
    return spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, item_id int, gram string"), spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("most", [L.MAX_PIECES, 0])
def test_against_brute_force(spark, most):
    items, docs = case(3)
    d, e = frames(spark, items, docs)
    rows = L.leaks(d, e, max_pieces=most).collect()
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["run_words"] >= 12} == brute(items, docs)
    assert all(r["window_edits"] == 0 for r in rows if r["run_words"] >= 12) and any(r["window_edits"] == 1 for r in rows)


def test_one_wrong_word_is_found(spark):
    item = " ".join(f"w{i}" for i in range(30))
    for k in range(1, 12):
        w = [f"w{i}" for i in range(7, 19)]
        w[k] = "odd"
        d, e = frames(spark, [(1, item)], [(1, "x y " + " ".join(w) + " z")])
        got = L.leaks(d, e).collect()
        assert len(got) == 1 and got[0]["window_edits"] == 1, k


def test_two_wrong_words_are_found(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs, want = [], set()
    for k in range(1, 11):
        for j in range(k + 1, 11):
            w = [f"w{i}" for i in range(7, 19)]
            w[k], w[j] = "odd", "even"
            docs.append((100 * k + j, "x y " + " ".join(w) + " z"))
            want.add(100 * k + j)
    docs.append((5, "x " + " ".join(f"w{i}" if i % 4 else "odd" for i in range(8, 20)) + " y"))  # three wrong words
    d, e = frames(spark, [(1, item)], docs)
    for most in (L.MAX_PIECES, 0):
        got = {r["doc_id"]: r["window_edits"] for r in L.leaks(d, e, budget=2, max_pieces=most).collect()}
        assert got == dict.fromkeys(want, 2)


def test_cases(spark):
    item = " ".join(f"w{i}" for i in range(12))
    d, e = frames(spark, [(1, item), (2, "too short an item"), (3, None), (1, item)], [(1, item), (1, item), (2, None), (3, ""), (4, "w5 " * 100_000 + item.replace(" ", "--").upper()), (None, item)])
    assert {r[:] for r in L.found(d, e).select("doc_id", "item_id").collect()} == {(1, 1), (4, 1), (None, 1)}
    assert L.found(d.where("false"), e).count() == 0 and L.found(d, e.where("false")).count() == 0
    assert L.documents_touched(d, e).where("doc_id = 4").first()["items"] == [1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.sampled_from("abc"), max_size=12))
def test_myers(pattern, text):
    want = min(edits(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert L.myers(pattern, text) == want

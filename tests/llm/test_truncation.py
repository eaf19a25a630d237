import random

import numpy as np
import pytest
from vectide.llm import truncation as T

COMMON = frozenset("the is of and by alt der und el es la old".split()) - {"old"}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("The wall is old. The river is wi", "open"), ("The wall is old.", "closed"), ("The wall is old...", "mark"), ("The wall is ol…", "mark"), ("The wall [...]", "mark"), ("Is it old?", "closed"),
        ("v1.6.4", "title"), ("The wall is old.\n\nAccording", "stub"), ("dense storage branch", "title"), ("The wall is old.\n\nRegards,\nGeinia", "signed"), ("The wall is old.\n\n— Nébratha", "signed"), ("All fine.\n\nSee docs/wall.md", "pointer"),
        ("Some things:\n\n- old wall\n- wide river", "item"), ("name\tcount\nGor\t12", "row"), ("Do this:\n\n```\na = 1\n```", "fence"), ("Do this:\n\n```\na = 1", "code"), ("The wall is old and\nthe river is wide with 12 \n", "open"),
        ("Die Mauer ist alt und der", "open"), ("El muro es viejo y la", "open"),
    ],
)
def test_endings(text, kind):
    assert T.ending(text, COMMON)[0] == kind


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([("en", w) for w in sorted(COMMON)] + [(None, None)], "lang string, word string")


def test_fit_recovers_a_censored_distribution():
    r = np.random.default_rng(1)
    x = np.exp(r.normal(6.0, 0.7, 20_000))
    kept, cut = np.round(x[x < 600]), (x >= 600).sum()
    values, counts = np.unique(np.maximum(kept, 1), return_counts=True)
    mu, sd = T.fit(values, counts.astype(float), np.array([600.0]), np.array([float(cut)]))
    assert abs(mu - 6.0) < 0.05 and abs(sd - 0.7) < 0.05


def test_limits_are_found():
    r = np.random.default_rng(2)
    x = np.minimum(np.exp(r.normal(6.0, 0.7, 800)).astype(int) + 1, 512)
    values, counts = np.unique(x, return_counts=True)
    found = T.source_limits("chars", values, counts)
    assert [f[1] for f in found] == [512] and found[0][3] > 0.95
    values, counts = np.unique(np.exp(r.normal(6.0, 0.7, 800)).astype(int) + 1, return_counts=True)
    assert T.source_limits("chars", values, counts) == []
    long = np.concatenate([np.exp(r.normal(9.0, 1.0, 500)).astype(int), np.full(40, 200_000)])
    assert [f[1] for f in T.source_limits("chars", *np.unique(long, return_counts=True))] == [200_000]


def test_chance_is_the_poisson_tail():
    assert T.by_chance(3, 0.5, 1) == pytest.approx(1 - np.exp(-0.5) * (1 + 0.5 + 0.125), rel=0.05)
    assert T.by_chance(2, 3.0, 10) == 1.0 and T.by_chance(40, 0.1, 10**6) < 1e-12


def test_evidence_is_learned_from_posteriors():
    counts = [("closed", 0.0, 900), ("open", 0.0, 20), ("open", 0.99, 80), ("item", 0.0, 60), ("item", 0.99, 40), ("title", 0.0, 100), ("closed", 0.99, 2)]
    ratio, rate = T.evidence(counts, T.CUT)
    assert ratio["item"] > 1 and ratio["title"] < -2 and "open" not in ratio and 0.01 < rate < 0.03
    alone, _ = T.evidence(counts)
    assert alone["open"] > alone["item"] > alone["title"]
    none, _ = T.evidence([(k, 0.0, n) for k, _, n in counts], T.CUT)
    assert none["item"] < 0


def corpus():
    r = random.Random(5)
    rows, want = [], set()
    for i in range(900):
        source = r.choice(["hot", "hot", "cut", "free", None])
        text = " ".join(f"The {r.choice(['old', 'wide'])} wall of {r.choice(['Gor', 'Hal'])} stands near the {r.choice(['mill', 'river'])}." for _ in range(r.randint(1, 14)))
        if source == "cut" and len(text) > 300:
            text = text[:300]
        elif source == "hot" and r.random() < 0.05:
            text = text[: r.randint(25, len(text) - 2)]
        if not text.rstrip().endswith("."):
            want.add(i)
        rows.append((i, text, source, "x", 1))
    return rows, want


SCHEMA = "doc_id long, text string, source string, kind string, chars int"


def test_tables(spark, common):
    rows, want = corpus()
    more = [(2000, None, "cut", "", 1), (2001, "", None, "", 1), (2002, "  \n", "cut", "", 1), rows[0], rows[0], (2003, "The wall is old. " * 20_000, "free", "", 1), (2004, "Gor", "cut", "", 1)]
    df = spark.createDataFrame(rows + more, SCHEMA)
    got = [r["doc_id"] for r in T.found(df, common).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rates = {r["source"]: r for r in T.rates(df, common).collect()}
    assert rates["cut"]["share"] > 0.3 and rates["free"]["n_truncated"] == 0 and sum(r["n_texts"] for r in rates.values()) == 902
    assert T.limits(T.endings(df, common)).where("source = 'cut' and unit = 'chars' and size = 300").count() == 1
    assert T.method(df.where("false"), common).count() == 0 and T.found(df, common.where("false")).count() > 0
    assert T.found(df.where("false"), common).count() == 0 and T.rates(df.where("false"), common).count() == 0


def test_posterior_tips_the_scale(spark, common, monkeypatch):
    """A text that ends in a name counts as cut only where its source cuts at that very length."""
    r = random.Random(7)
    rows = [(i, ("The wall of Gor is old and wide and stands by the river there. " * 9)[: r.randint(30, 400)].rstrip() + ".", "a", "", 1) for i in range(300)]
    rows += [(1000 + i, (f"The {i} wall of Gor is old. " + "The wall of Gor is old. " * 20)[:200 - 12] + "\n- some ite ", "a", "", 1) for i in range(60)] + [(5000, "The wall is old.\n- some item", "a", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"] for x in T.found(df, common).collect()}
    assert {1000 + i for i in range(60)} <= got and 5000 not in got
    alone = {x["doc_id"]: x["truncated"] for x in T.method(df, common).collect()}
    assert len(alone) == 361 and all(alone[1000 + i] for i in range(60)) and not alone[5000]
    found = T.limits
    monkeypatch.setattr(T, "limits", lambda rows: found(rows).where("false"))
    assert not {x["doc_id"] for x in T.found(df, common).collect()} & {1000 + i for i in range(60)}

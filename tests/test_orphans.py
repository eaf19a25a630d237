import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from vectide.operators import orphans
from vectide.operators.components import components

T0 = datetime(2024, 1, 31, 23)
CHILD = "id long, ref long, written_at timestamp, loaded_at timestamp, ref_key string, gone string"
PARENT = "id long, loaded_at timestamp, deleted_at timestamp, ref_key string"


def brute(children, parents):
    out = set()
    for _, ref, written, loaded, *_ in children:
        if ref is None:
            continue
        own = [p for p in parents if p[0] == ref]
        first = min((p[1] for p in own if p[1]), default=None)
        state = "missing" if not own else "deleted" if any(p[2] for p in own) else "late" if first and loaded and first > loaded else None
        if state:
            out.add(("child", "ref", written.strftime("%Y-%m") if written else None, ref, state))
    return out


def check(spark, children, parents):
    tables = {"child": spark.createDataFrame(children, CHILD), "parent": spark.createDataFrame(parents, PARENT)}
    rows = orphans.failing(tables, (orphans.Reference("child", "ref", "parent", "id"),))
    got = [r[:] for r in rows.select("ref_table", "ref_field", "ref_month", "ref_key", "ref_state").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(children, parents)
    return rows


def test_random_against_brute_force(spark):
    r = random.Random(1)
    at = lambda: r.choice([None, T0 + timedelta(days=r.randint(0, 60))])
    parents = [(r.choice([None, *range(40)]), at(), r.choice([None, None, T0]), "x") for _ in range(60)]
    children = [(i, r.choice([None, 7, 7, 7, *range(80)]), at(), at(), "y", "z") for i in range(400)]
    rows = check(spark, children + children[:50], parents)
    assert orphans.counts(rows).count() > 3


@pytest.mark.parametrize(("children", "parents"), [([], []), ([(1, 5, T0, T0, "", "")], []), ([], [(1, T0, None, "")]), ([(1, None, None, None, None, None)], [(None, None, None, None)]), ([(1, 1, T0, T0, "", ""), (2, 1, T0, T0, "", "")], [(1, T0, None, "")])])
def test_edges(spark, children, parents):
    check(spark, children, parents)


@pytest.mark.parametrize("n", [1, 5000, 40_000])
def test_filter_never_denies_a_member(spark, n):
    keys = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, n)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)] + [(int(keys[0]),)] * 500, "id long")
    packed = orphans.bloom(df, "id", orphans.filter_bits(n))
    assert orphans.might_contain(keys, packed).all()
    assert orphans.might_contain(np.arange(20_000) + (1 << 40), packed).mean() < 0.03
    assert orphans.filter_bits(10**12) == orphans.MAX_FILTER_BITS and not orphans.might_contain(keys, orphans.bloom(df.where("false"), "id", 1 << 13)).any()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    on = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for x in on}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0

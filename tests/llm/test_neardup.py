import random

import numpy as np
import pytest
from vectide.llm import neardup as N
from vectide.llm.words import Hasher, shingle_sets, shingles, words

SCHEMA = "id long, content string, set_key string, key int, a int"


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(600)]
    base = [[r.choice(vocab) for _ in range(r.randint(20, 90))] for _ in range(40)]
    out = []
    for b in base:
        for _ in range(r.randint(1, 5)):
            w = list(b)
            for _ in range(r.randint(0, 8)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(vocab)], [w[k], r.choice(vocab)]])
            out.append(" ".join(w))
    return out


def brute(texts, size, threshold):
    s = {i: set(zip(*[words(t)[k:] for k in range(size)], strict=False)) for i, t in texts if t}
    s = {i: x for i, x in s.items() if x}
    return {(i, j) for i in s for j in s if i < j and len(s[i] & s[j]) >= threshold * len(s[i] | s[j])}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "q", 1, 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.5), (5, 0.8)])
def test_against_brute_force(spark, size, threshold):
    rows = list(enumerate(corpus()))
    want = brute(rows, size, threshold)
    got = [r[:] for r in N.found(frame(spark, rows), size, threshold).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(set(got)) >= 0.98 * len(want)


def test_cases(spark):
    t = "the old wall by the wide river stands in the sun"
    rows = [(1, t), (1, t), (2, t.upper() + "!"), (3, None), (4, ""), (5, "two words"), (6, "one two three"), (7, "one two three"), (8, "long " * 30_000), (None, t)]
    got = {r[:] for r in N.found(frame(spark, rows)).select("id_a", "id_b").collect()}
    assert got == {(1, 2), (6, 7)}
    groups = {r[:] for r in N.groups(frame(spark, rows)).select("id", "group_id", "n_links").collect()}
    assert groups == {(1, 1, 1), (2, 1, 1)}
    assert N.found(frame(spark, [])).count() == 0 and N.groups(frame(spark, [])).count() == 0


def test_copies_of_one_text_are_tied_by_the_first_id(spark):
    t = "the old wall by the wide river stands in the sun"
    n = N.EXPAND + 50
    rows = [(i, t) for i in range(n)] + [(n + 5, t + " today")]
    got = {r[:] for r in N.found(frame(spark, rows)).select("id_a", "id_b").collect()}
    assert got == {(0, i) for i in range(1, n)} | {(0, n + 5)}
    links = {r["id"]: r["n_links"] for r in N.groups(frame(spark, rows)).collect()}
    assert links[0] == links[7] and set(links.values()) <= {n - 1, n} and len(links) >= n


def test_a_large_class_keeps_links_between_different_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 6)
    t = "the old wall by the wide river stands in the sun"
    rows = [(i, t) for i in range(5)] + [(i, t.upper()) for i in range(5, 9)] + [(9, t + " today"), (10, t + "!")]
    got = {r[:] for r in N.found(frame(spark, rows)).select("id_a", "id_b").collect()}
    tied = {(0, i) for i in range(1, 5)} | {(5, i) for i in range(6, 9)}
    assert got == tied | {(0, 5), (0, 10), (5, 10), (0, 9), (5, 9), (9, 10)}


def test_prefixes_are_shortened_until_the_target():
    assert N.prefix_length(0.8, {}) == N.DEPTH and N.prefix_length(0.5, {}) == 3
    assert N.prefix_length(0.5, {8: 50}) == 4  # pairs that meet early outweigh what theory fears
    assert N.prefix_length(0.5, {8: 4000}) > 4 and N.deepest(0.5) == 6 and N.deepest(0.8) == 8 and N.deepest(0.01) == 1
    assert N.prefix_length(0.5, {8: 500, 3: 20}) == 3 and N.prefix_length(0.5, {8: 500, 0: 20}) == 1


def test_labels_are_tries():
    h = Hasher()
    a, b = shingles([f"a{i}" for i in range(300)], 3, h), shingles([f"a{i}" for i in range(100, 400)], 3, h)
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = N.labels([a, b], 2000)
    for depth in (1, 2):
        agree = ((x ^ y).view(np.uint64) >> np.uint64(N.below(depth)) == 0).mean()
        assert abs(agree - want**depth) < 0.05
    short = N.labels([a, b], 2000, 3)
    assert (short >> N.below(3) == N.labels([a, b], 2000) >> N.below(3)).all() and not (short & ((1 << N.below(3)) - 1)).any()
    assert sum(N.BITS) == 64 and len(N.BITS) == N.DEPTH and N.level(x, x) == N.DEPTH


def test_probes_find_all_similar_texts():
    h = Hasher()
    sets = [s for s in shingle_sets([words(t) for t in corpus(4)], 3, h) if len(s)]
    probes = N.Probes(sets[:30], 0.5)
    keys = N.set_keys(sets)
    got = [len(x) for x in probes.levels(sets, keys, N.labels(sets, depth=N.deepest(0.5)))]
    alike = [[keys[i] != keys[j] and len(np.intersect1d(x, y)) >= 0.5 * len(np.union1d(x, y)) for j, y in enumerate(sets[:30])] for i, x in enumerate(sets)]
    assert got == [sum(a) for a in alike] and N.Probes([], 0.5).levels(sets, keys, N.labels(sets)) == [[]] * len(sets)


def test_a_long_run_is_spread_in_blocks(spark, monkeypatch):
    n, other = 1000, 40
    rows = [(i, i, [7] * 2 + [1000 + i]) for i in range(n)] + [(n + i, n + i, [-5, 7 if i == 0 else 8, 5000 + i]) for i in range(other)]
    df = spark.createDataFrame(rows, "id long, set_key long, keys array<long>").repartition(3)
    whole = list(range(n + 1))
    want = {(a, b) for a in whole for b in range(a + 1, n + 1)} | {(n + a, n + b) for a in range(other) for b in range(a + 1, other)}
    for run in (32, 2048):
        monkeypatch.setattr(N, "RUN", run)
        got = [r[:] for r in N.meetings(df, N.DEPTH).select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_batches_hash_as_single_texts():
    h, texts = Hasher(), [words(t) for t in [*corpus(), "", "a", "a b", "a b c", "a b c a b c a b c"]]
    for got, ws in zip(shingle_sets(texts, 3, h), texts, strict=True):
        assert got.tolist() == shingles(ws, 3, h).tolist()

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from vectide.llm import packing as P


def naive(sizes, cap):
    """Sum-of-squares placement by trying every level."""
    levels, where = [], []
    for s in sizes:
        n = [sum(1 for x in levels if x == h) for h in range(cap)]
        best = None
        for h in range(cap - s, -1, -1):
            if h and not n[h]:
                continue
            m = list(n)
            if h:
                m[h] -= 1
            if h + s < cap:
                m[h + s] += 1
            cost = sum(x * x for x in m)
            if best is None or cost < best[0]:
                best = (cost, h)
        h = best[1]
        if h:
            levels[max(i for i, x in enumerate(levels) if x == h)] = -1
        levels.append(h + s if h + s < cap else -1)
        where.append((h, s))
    return where


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_chooses_the_least_sum_of_squares(sizes):
    p, fills, got = P.Packer(12), {}, []
    for s in sizes:
        box = p.place(s)
        got.append((fills.get(box, 0), s))
        fills[box] = fills.get(box, 0) + s
    assert got == naive(sizes, 12) and all(f <= 12 for f in fills.values())
    assert [len(x) for x in p.open] == p.counts.tolist()


def test_little_room_is_wasted():
    r = np.random.default_rng(1)
    p, sizes = P.Packer(2048), np.clip(r.lognormal(5.3, 0.9, 20_000), 1, 2048).astype(int)
    for s in sizes:
        p.place(int(s))
    assert sizes.sum() / (p.made * 2048) > 0.98


def best_fit(sizes, cap):
    room = []
    for s in sizes:
        fits = [k for k, x in enumerate(room) if x >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(cap - s)
    return len(room)


def test_close_to_best_fit_on_document_sizes():
    r = np.random.default_rng(4)
    for sizes in (r.integers(20, 400, 3000), r.integers(100, 900, 3000), np.clip(r.lognormal(5.3, 0.9, 3000), 1, 2048).astype(int)):
        p = P.Packer(2048)
        for s in sizes.tolist():
            p.place(s)
        assert p.made <= 1.02 * best_fit(sizes.tolist(), 2048)


def test_every_token_is_placed_once(spark):
    r = np.random.default_rng(6)
    rows = [(i, "wall " * int(n)) for i, n in enumerate(r.integers(0, 5000, 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x["doc_id"]: x["n_tokens"] for x in P.token_counts(df).collect()}
    spans: dict = {}
    for x in P.pack(df).collect():
        spans.setdefault(x["doc_id"], []).append((x["start_token"], x["n_tokens"]))
    assert spans.keys() == want.keys()
    for doc, parts in spans.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == want[doc] and len(parts) == max(1, -(-want[doc] // P.CAPACITY))


def test_tables(spark):
    rows = [(1, "wall " * 5000, 1), (2, None, 1), (3, "", 1), (4, "short text", 1), (4, "short text", 1), (None, "no id", 1), (5, "wall " * 2048, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = P.pack(df).orderBy("doc_id", "piece").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_tokens"] for r in by[1]][:2] == [2048, 2048] and [r["start_token"] for r in by[1]] == [0, 2048, 4096] and len(by[4]) == 1
    assert by[2][0]["container_id"] is None and by[3][0]["n_tokens"] == 0 and len(by[None]) == 1
    used = {}
    for r in got:
        if r["container_id"] is not None:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 2048 and P.fill(P.pack(df)).first()["containers"] == len(used)
    assert P.pack(df.where("false")).count() == 0


def test_tokens_are_the_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    with open(P.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("It's  a wall,\n\n 12 über!!  ", "a" * 300, "x 1 2\t\n", ""):
        assert P.count_tokens(t, P.TOKENIZER) == len(other.encode_ordinary(t))
    long = "The wall is old. " * 20_000
    assert abs(P.count_tokens(long, P.TOKENIZER, 5000) - len(other.encode_ordinary(long))) <= len(long) / 5000

"""SimHash, its vantage-point tree and the components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from locusframe.llm import simhash as S

from .corpus import frame, odd_rows, words


def brute_fingerprint(text):
    ws = (text or "").encode().lower().split()
    parts = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(points):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 2):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def near_points(n, seed=1):
    """Points with chains and balls of near ones."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(base) < n:
        x = rng.choice(base)
        for _ in range(rng.choice([1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        base.append(x)
    return np.array(sorted(set(base)), np.uint64)


def test_fingerprints():
    for k in range(12):
        t = words(k, k * 3) + (" ÄB C" if k % 2 else "")
        assert S.fingerprint(t) % (1 << 64) == brute_fingerprint(t)
    assert S.fingerprint(None) == S.fingerprint(" \n ") == 0


def test_link_within_a_shard(monkeypatch):
    monkeypatch.setattr(S, "_LEAF", 20)
    points = near_points(900)
    assert S.link(points, np.ones(len(points), bool), 2).tolist() == roots(points)


@pytest.mark.parametrize("shard", [40, 10**9])
def test_components_over_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD_POINTS", shard)
    monkeypatch.setattr(S, "_LEAF", 16)
    points = near_points(1500, 5)
    rows = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = {r.fp: r.root for r in S.components(S.linked_pairs(rows)).collect()}
    want = roots(points)
    groups = {}
    for k, r in enumerate(want):
        groups.setdefault(r, set()).add(int(points.view(np.int64)[k]))
    assert {x: min(g) for g in groups.values() if len(g) > 1 for x in g} == got


def test_odd_rows(spark):
    rows = odd_rows()
    out = S.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    zero = [r for r in out if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1} and sum(r.keep for r in zero) == 1
    assert {r.component_id for r in out if r.id in (6, 7)} == {6} and {r.component_id for r in out if r.id in (8,)} == {8}
    kept = S.drop_near_duplicates(frame(spark, rows))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == frame(spark, []).columns
    assert sorted(i for i, _ in got if i is not None) == [1, 4, 5, 6, 8, 9, 10] and (None, "a null id") in got
    assert S.near_duplicates(frame(spark, [])).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.root for r in S.components(edges).collect()} == {0}


@pytest.mark.parametrize("shard", [40, 10**9])
def test_direct_neighbours(spark, monkeypatch, shard):
    """Edges whose ends are near each other themselves, for every point that has a near one."""
    monkeypatch.setattr(S, "SHARD_POINTS", shard)
    monkeypatch.setattr(S, "_LEAF", 16)
    points = near_points(1500, 8)
    rows = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    edges = np.array([(r.a, r.b) for r in S.linked_pairs(rows, 3, direct=True).collect()], np.int64).view(np.uint64)
    assert (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 3).all()
    near = {int(p) for p in points if (np.bitwise_count(points ^ p) <= 3).sum() > 1}
    assert near == set(edges.ravel().tolist()) and 100 < len(near) < len(points)

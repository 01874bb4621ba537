"""Near copies against a brute force of the rule: five-word shingles, Jaccard similarity of 0.8 or more, links chain."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

from locusframe.llm import near_copies as N

from .corpus import frame, odd_rows, words

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402


def brute_kept(rows):
    """rows: (id, text) with different ids; the ids that stay."""
    sets = []
    for _, text in rows:
        ws = (text or "").encode().lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) / union >= 0.8:
                x, y = find(a), find(b)
                parent[x] = y
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return set(least.values())


def near_texts(seed, n):
    """Texts of a few families, edited by zero to five words, some behind a common passage."""
    rnd = random.Random(seed)
    common = words(5, 40)
    families = [words(100 + k, rnd.randint(20, 200)).split() for k in range(n // 8)]
    out = []
    for k in range(n):
        ws = list(rnd.choice(families))
        for _ in range(rnd.randint(0, 5)):
            ws[rnd.randrange(len(ws))] = f"edit{rnd.randrange(1000)}"
        out.append((k, (common + " " if k % 4 == 0 else "") + " ".join(ws)))
    return out + [(n, None), (n + 1, " "), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, "one two three")]


@pytest.mark.parametrize("centres", [16, 1])
def test_stage_brute_force(spark, monkeypatch, centres):
    monkeypatch.setattr(N, "CENTRES", centres)
    rows = near_texts(centres, 240)
    got = {r.doc_id for r in P.remove_near_duplicates(spark, frame(spark, rows), "").collect()}
    want = brute_kept(rows)
    assert got == want and len(want) < 200


def test_large_group_of_edited_copies(spark):
    """Copies of one text, most of them edited at places of their own, with the centres as they are: a group over several salts
    and rounds. Chains run through copies that no centre is near to."""
    rnd = random.Random(12)
    base = words(77, 60).split()
    rows = []
    for k in range(5000):
        ws = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4])):
            ws[rnd.randrange(len(ws))] = f"edit{rnd.randrange(10**6)}"
        rows.append((k, " ".join(ws)))
    sets = [N.shingles(t) for _, t in rows]
    known = {h: i for i, h in enumerate(sorted({int(h) for s in sets for h in s}))}
    # shared shingles through the few that stand in more than one set
    shared = np.bincount([known[int(h)] for s in sets for h in s]) > 1
    places = np.cumsum(shared) - 1
    bits = np.zeros((len(sets), int(shared.sum())), np.float32)
    for i, s in enumerate(sets):
        at = np.array([known[int(h)] for h in s])
        bits[i, places[at[shared[at]]]] = 1
    n = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    near = []
    for i in range(0, len(sets), 1000):
        both = bits[i : i + 1000] @ bits.T
        near.append(9 * both >= 4 * (n[i : i + 1000, None] + n))
    near = np.concatenate(near) | np.eye(len(sets), dtype=bool)
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            break
        root = new
    got = {r.doc_id for r in P.remove_near_duplicates(spark, frame(spark, rows), "").collect()}
    want = set(root.tolist())
    assert (len(got), len(got - want), len(want - got)) == (len(want), 0, 0) and 1 < len(got) < 4000


def test_very_long_texts(spark):
    """20,000 words: member rows stay of one size, whatever the text's length, and similar texts are found."""
    long = words(31, 20_000).split()
    edited, other = list(long), list(long)
    for k in range(0, 20_000, 60):
        edited[k] = "edit"
    for k in range(0, 20_000, 10):
        other[k] = f"other{k}"
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(other)), (4, words(5, 50))]
    got = {r.doc_id for r in P.remove_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert got == brute_kept(rows) == {1, 3, 4}
    assert len(N.sketch(N.shingles(rows[0][1]))) == N._PARITY


def test_odd_rows(spark):
    kept = N.drop_near_copies(frame(spark, odd_rows()))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == frame(spark, []).columns
    assert sorted(i for i, _ in got if i is not None) == [1, 4, 5, 6, 8, 9, 10] and (None, "a null id") in got
    assert N.drop_near_copies(frame(spark, [])).count() == 0


def test_parities_bound_the_difference():
    sets = [N.shingles(t) for _, t in near_texts(3, 60)] + [N.shingles(words(9, n)) for n in (300, 700, 3000)]
    bits = [N.parities(s).view(np.uint64) for s in sets]
    assert {len(b) for b in bits} >= {4, 8, 16, 64}
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            assert int(N.apart(x, y[None])[0]) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_the_tree_finds_links_first(spark, monkeypatch):
    """The stage's fingerprints go through the vantage-point tree, its pairs become links once their sets are similar, and what it has
    joined makes no pair by prefixes. Pairs further apart in bits are linked all the same."""
    rows, calls = near_texts(21, 240), []
    kept, pairs = N._confirmed, N._candidates
    monkeypatch.setattr(N, "_confirmed", lambda found, *rest: calls.append({(r.a, r.b) for r in found.collect()}) or kept(found, *rest))
    monkeypatch.setattr(N, "_candidates", lambda members, *rest: calls.append({(r.sid, r.root) for r in members.collect()}) or pairs(members, *rest))
    got = {r.doc_id for r in P.remove_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert got == brute_kept(rows)
    sets = {N.xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63): s for s in (N.shingles(t) for _, t in rows)}
    bits = {i: np.uint64(N.majority(s) % (1 << 64)) for i, s in sets.items()}
    near = {(a, b) for a in sets for b in sets if a < b and np.bitwise_count(bits[a] ^ bits[b]) <= N.RADIUS}
    tree, members, first = calls[:3]
    assert tree and tree <= near and {x for p in near for x in p} == {x for p in tree for x in p}
    joined = {p for p in tree if N.similar(sets[p[0]], sets[p[1]])}
    root = dict(members)
    assert all(root[a] == root[b] for a, b in joined if a in root and b in root)
    # by prefixes come others, which the tree's radius does not reach
    assert not joined & first and first - near


def test_small_batches(spark, monkeypatch):
    """Workers get few texts at once, and the session's own number is there again afterwards."""
    seen, points = [], N.linked
    monkeypatch.setattr(N, "linked", lambda *given: seen.append(int(spark.conf.get(N._BATCH_KEY))) or points(*given))
    before = spark.conf.get(N._BATCH_KEY)
    assert N.drop_near_copies(frame(spark, [(1, "a b"), (2, "A b"), (3, "c")])).count() == 2
    assert seen == [N._BATCH] and spark.conf.get(N._BATCH_KEY) == before

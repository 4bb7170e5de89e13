"""Near-duplicate groups: few pairs, no lost link."""

import re

import numpy as np
import pytest

from ledgerlink.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def many_near_copies(n, seed=3):
    """Texts that differ from one common text in a few places each; all form one component or nearly so."""
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        words = list(base)
        for k in draw.choice(len(base), int(draw.integers(1, 4)), replace=False):
            words[k] = f"x{i}-{k}"
        out.append(" ".join(words))
    return out


def plain_components(texts):
    """Lowest place reachable by links, pair by pair."""
    sets = []
    for t in texts:
        w = WORDS.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_spanning_forests_span():
    draw = np.random.default_rng(4)
    for _ in range(50):
        n = int(draw.integers(2, 20))
        a, b = draw.integers(0, n, 60), draw.integers(0, n, 60)
        for most in (1, 3):
            chosen = jaccard.forests(a, b, n, most)
            assert len(set(chosen.tolist())) == len(chosen) <= most * (n - 1)
            want, got = components_of(n, zip(a, b)), components_of(n, zip(a[chosen], b[chosen]))
            assert want == got


def components_of(n, links):
    root = list(range(n))
    for x, y in links:
        x, y = root[x], root[y]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("block", [2048, 200])
def test_a_large_group_of_near_copies_needs_few_pairs(spark, save, monkeypatch, block):
    texts = many_near_copies(1500 if block > 1000 else 500)
    asked = []
    plain = jaccard.verified
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets: asked.append(pairs.count()) or plain(pairs, sets))
    where = save(documents=[(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.op5_jaccard(spark, where).collect()}
    if block < 1000:
        assert [got[i] for i in range(len(texts))] == plain_components(texts)
    else:
        assert set(got.values()) == {0}
    assert sum(asked) < 2 * len(texts)

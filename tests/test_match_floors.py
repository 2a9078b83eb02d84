"""Closest names: characters that don't share a bucket, common subsequences, and many anagrams."""

import random
from difflib import SequenceMatcher

import numpy as np

from trailgraph.functions import match


def test_different_characters_have_a_bucket_each():
    (one, _), (other, _) = match._counts(["x", "8", "é"], ["8"])  # 64 apart: "x" was taken for "8"
    assert np.minimum(one, other[0]).sum(axis=1).tolist() == [0, 1, 0]


def test_common_subsequences_bound_matching_blocks():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab#0é🙂") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            row = [0, *_next(row, c, b)]
        assert match.common(a, [b]) == [row[-1]]
        assert sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) <= row[-1]


def _next(old, c, b):
    left = 0
    for k, d in enumerate(b):
        left = old[k] + 1 if c == d else max(left, old[k + 1])
        yield left


def test_anagrams_and_floors(spark, monkeypatch):
    monkeypatch.setattr(match, "NAME_BLOCK", 50)
    monkeypatch.setattr(match, "ENTITY_BLOCK", 7)
    names = [f"Customer#{k:05d}" for k in range(0, 3000, 3)] + ["8ustomer#00000", "🙂a", "aé"]
    wanted = [f"xCustomer#{k:05d}" for k in range(0, 3000, 150)] + ["Customr#00120", "a🙂", "éa", "none"]
    got = match.closest(spark.createDataFrame([(w,) for w in wanted], "entity string"), spark.createDataFrame([(n,) for n in names], "name string"))
    expected = {}
    for w in wanted:
        score, name = min((-SequenceMatcher(None, w, n).ratio(), n) for n in names)
        if -score >= 0.5:
            expected[w] = (name, -score)
    assert {r["entity"]: (r["name"], r["score"]) for r in got.collect()} == expected

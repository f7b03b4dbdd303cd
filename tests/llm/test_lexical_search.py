"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marquee.llm import lexical_search
from tests.llm.helpers import LOWER, ODD, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items):
    """(item, rank, doc, score) by the formula."""
    held = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict[int, Counter] = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(terms_of(text))
    rows = []
    for item, times in asked.items():
        scores = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * total // length
            score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in times.items() if c[t])
            if score:
                scores.append((-score, doc is None, doc or 0))
        rows += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scores)[:10])]
    return sorted(rows)


ITEMS = [(1, "same row, twice TWICE"), (2, "word5 word6 and7 word5"), (2, "more: word9"), (3, None), (4, ""), (5, "nowhere"), (None, "same"), (6, "É é 日本語 ünïcödé"), (7, "x"), (8, "Two words idiot quoted c_d")]


def found(spark, docs, items, **more):
    frame = lexical_search.lexical_search(docs, spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, term string"), **more)
    assert frame.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("block", [lexical_search.BLOCK, 5])
def test_odd_rows(spark, block):
    rows = ODD + [(100 + k, "same row twice") for k in range(30)]
    assert found(spark, table(spark, rows), ITEMS, block=block) == plain_search(rows, ITEMS)


def test_random_documents(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randrange(1, 40)))) for k in range(600)]
    rows += [(600 + k, rows[k % 7][1]) for k in range(200)] + [(900 + k, rows[3][1] + f" w{k}") for k in range(50)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(40)]
    assert found(spark, table(spark, rows).repartition(3), items) == plain_search(rows, items)


def test_empty_tables(spark):
    assert found(spark, table(spark, []), ITEMS) == []
    assert found(spark, table(spark), []) == []
    assert found(spark, table(spark), [(3, None), (None, "same")]) == []


@pytest.mark.parametrize("leaf", [1, 4, 1000])
def test_tree(leaf):
    """Each document is in one leaf, paths divide by frequent terms first, and bounds hold for all that lies below."""
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.choice(30, rng.integers(0, 9), replace=False)) for _ in range(200)] + [np.array([0, 1, 2])] * 50
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    terms = np.concatenate(lists)
    tfs, m = rng.integers(1, 6, len(terms)), rng.integers(25, 200, len(lists))
    tree = lexical_search.Tree(m, bounds, terms, tfs, 30, leaf)
    leaves = [k for k, c in enumerate(tree.children) if not c]
    assert sorted(np.concatenate([tree.order[tree.first[k] : tree.last[k]] for k in leaves]).tolist()) == list(range(250))
    for k in range(len(tree.first)):
        docs = tree.order[tree.first[k] : tree.last[k]]
        want = np.zeros(30, int)
        for d in docs:
            np.maximum.at(want, lists[d], tfs[bounds[d] : bounds[d + 1]])
        assert (tree.maxima[k] == want).all() and tree.least[k] == m[docs].min()
        if not tree.children[k] and len(docs) > leaf:
            assert len({tuple(lists[d]) for d in docs}) == 1
    asked, weights = np.array([3, 7, 20]), np.array([5, 9, 2])
    scores = [int(sum(w * (10**9 * int(f) // (1000 * int(f) + 8 * int(m[d]))) for t, f in zip(lists[d], tfs[bounds[d] : bounds[d + 1]], strict=True) for a, w in zip(asked, weights, strict=True) if a == t)) for d in range(250)]
    best = tree.search(asked, weights, [], list(range(250)))
    assert best == sorted((-s, False, d) for d, s in enumerate(scores) if s)[:10]


def test_search_leaves_out_subtrees():
    """What cannot reach the best ten is not scored."""
    lists = [np.array([k % 20]) for k in range(2000)]
    tfs = np.array([1 + 50 * (k < 40) for k in range(2000)])
    tree = lexical_search.Tree(np.full(2000, 100), np.arange(2001), np.concatenate(lists), tfs, 20, 8)
    scored = []

    class Watched(list):
        def __getitem__(self, k):
            scored.append(k)
            return super().__getitem__(k)

    best = tree.search(np.array([3]), np.array([1]), [], Watched(range(2000)))
    assert [d for _, _, d in best] == [3, 23, *range(43, 203, 20)] and len(set(scored)) <= 200

"""The prefix trie against writing every sequence out."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    ways = {}
    for c, turns in own.items():
        base, h = c - int(math.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        ways[c] = tuple(turns if base == c else own.get(base, [])[:h] + turns[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, way in sorted(ways.items()):
        ends[way].append(str(c))
        for d in range(len(way) + 1):
            members[way[:d]].append(c)
            if d:
                children[way[: d - 1]].add(way[:d])
    saved = {w: (len(m) - 1) * len(WORD.findall(w[-1][1])) if w else 0 for w, m in members.items()}
    out = []
    for w, m in members.items():
        below = [x for x in members if x[: len(w)] == w]
        out.append((m[0], len(w), members[w[:-1]][0] if w else None, len(m), len(children[w]), sum(not children[x] for x in below), sum(saved[x] for x in below), hashlib.sha256(",".join(ends[w]).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    """Conversations with further columns of clashing names."""
    clashing = "depth place p own base h component weight slice line conv".split()
    return spark.createDataFrame([(*r, *["z"] * len(clashing)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in clashing))


def found(spark, rows, **more):
    out = prefix_trie.prefix_trie(frame(spark, rows), **more)
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(map(tuple, out.collect()), key=str)


ODD = [
    (0, 0, "user", "hello there"), (0, 1, "bot", None), (0, 2, None, "x"), (0, 2, None, "x"), (0, None, "user", "before all"), (1, 5, "user", "one"), (1, 5, "user", "one"), (2, 0, "user", "a b c"),
    (None, 0, "user", "left out"), (21, 0, "u", "alone"), (22, 0, "u", "alone"), (22, 1, "u", ""), (40, 3, "user", "y" * 5000), (41, 1, "a", "bc"), (42, 1, "ab", "c"), (-3, 0, "user", "negative"), (60, None, None, None),
]


@pytest.mark.parametrize("most", [4])
def test_odd_rows(spark, most):
    assert found(spark, ODD, most=most) == plain_trie(ODD)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def family(rng, n):
    """Conversations that share turns to different depths: short ones, copies and a long one."""
    rows = []
    for c in range(n):
        say = [rng.choice(["a", "b", "a b", "c c c"]) for _ in range(rng.randrange(1, 7))] if c % 3 else ["a", "b", "a b"]
        rows += [(c, t, "user", s) for t, s in enumerate(say)]
    return rows + [(n, t, "user", "a") for t in range(40)] + [(n + 1, t, "user", "a") for t in range(25)]


@pytest.mark.parametrize("most", [40])
def test_random_conversations(spark, most):
    rows = family(random.Random(most), 120)
    assert found(spark, rows, most=most) == plain_trie(rows)


def test_no_conversation_is_in_one_task(spark):
    """A conversation with half of all turns, and turns that all share, still give the right sums over slices."""
    rows = [(0, t, "user", f"t{t % 7}") for t in range(300)] + [(c, 0, "user", "t0") for c in range(20, 320)]
    assert found(spark, rows, most=200) == plain_trie(rows)


def test_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(2).alias("v"))
    got = prefix_trie.running(rows, ["g"], ["o"], ["v"]).collect()
    assert all(r["before_v"] == 2 * (r["o"] // 3) for r in got) and len(got) == 1000


def random_tree(rng, n, deep):
    parent = [-1] + [rng.randrange(max(0, k - deep), k) for k in range(1, n)]
    children = defaultdict(list)
    for k in range(1, n):
        children[parent[k]].append(k)
    weight = [rng.randrange(1, 4) for _ in range(n)]
    for k in range(n - 1, 0, -1):
        weight[parent[k]] += weight[k]
    place, stack = {0: 0}, [0]
    while stack:
        k = stack.pop()
        at = place[k] + 1
        for c in children[k]:
            place[c] = at
            at += weight[c]
            stack.append(c)
    return parent, children, weight, place


@pytest.mark.parametrize(("n", "deep"), [(1, 1), (60, 1), (200, 3), (200, 200)])
def test_local_decomposition(n, deep):
    rng = random.Random(n + deep)
    parent, children, weight, place = random_tree(rng, n, deep)
    leaf, save = [int(not children[k]) for k in range(n)], [rng.randrange(5) for _ in range(n)]
    sums = [np.array(leaf), np.array(save)]
    for k in range(n - 1, 0, -1):
        for s in sums:
            s[parent[k]] += s[k]
    state = {
        "place": [place[k] for k in range(n)], "above": [place[parent[k]] if k else -1 for k in range(n)], "last": [place[k] + weight[k] for k in range(n)], "component": [0] * n, "weight": weight,
        "total": [weight[0]] * n, "leaf": leaf, "save": save, "leaves": [0] * n, "saved": [0] * n,
    }
    out = prefix_trie.decompose({c: np.array(v) for c, v in state.items()})
    assert out["leaves"].tolist() == sums[0].tolist() and out["saved"].tolist() == sums[1].tolist()

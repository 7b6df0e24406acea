"""Links that connect similar sets against all pairs, and how many pairs are made for them."""

import random

import pytest

from corpuslab.operators import links
from corpuslab.operators.components import components

SETS = "node bigint, n bigint, shingles array<bigint>"


def near_copies(count, size, seed):
    """Sets of ``size`` shingles in which up to a fifth differ from the first."""
    rng = random.Random(seed)
    number = lambda: rng.randrange(-(1 << 63), 1 << 63)
    base = [number() for _ in range(size)]
    out = [base]
    for _ in range(count - 1):
        changed = set(rng.sample(range(size), rng.randint(1, size // 5)))
        out.append([number() if at in changed else x for at, x in enumerate(base)])
    return dict(enumerate(out))


def linked(sets, percent):
    sets = {key: set(found) for key, found in sets.items()}
    return {
        (a, b) for a in sets for b in sets
        if a > b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    }


def reached(keys, pairs):
    root = {key: key for key in keys}
    while True:
        new = dict(root)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("size", [1, 40, 600])
def test_links_connect_what_all_pairs_do(spark, size):
    sets = near_copies(90, size, size) if size > 5 else {0: [5], 1: [5], 2: [7]}
    want = linked(sets, 85)
    whole = spark.createDataFrame([(key, len(found), found) for key, found in sets.items()], SETS)
    signatures = whole.selectExpr("explode(array(1L, 2L)) AS signature", "node", "n", "n AS shared")
    found = {(r.a, r.b) for r in links.resolved_links(signatures, whole, 85).collect()}
    assert found <= want
    assert reached(sets, found) == reached(sets, want)


def test_pairs_that_cannot_link_are_not_made(spark):
    sets = near_copies(120, 300, 1)
    whole = spark.createDataFrame([(key, len(found), found) for key, found in sets.items()], SETS)
    rows = whole.selectExpr("1L AS signature", "node", "n", "n AS shared", "node AS label").join(links._parities(whole), "node")
    leaders = rows.filter("node >= 60")
    groups = spark.createDataFrame([(1, 120)], "signature bigint, fan_in bigint")
    made = {(r.a, r.b) for r in links._candidates(rows, leaders, groups, 85).collect()}
    want = {(a, b) for a, b in linked(sets, 85) if a >= 60}
    assert want <= made
    # 5,370 pairs meet; all of them were made and verified before.
    assert len(made) < 2 * len(want) + 200


def test_maps_of_nodes_with_several_sets_decide_nothing(spark):
    data = [(1, 2, [3, 4]), (1, 2, [3, 4]), (2, 2, [3, 4]), (3, 2, [3, 4]), (3, 3, [3, 4, 6])]
    got = {r.node: r.parity for r in links._parities(spark.createDataFrame(data, SETS)).collect()}
    assert got[1] is None and got[3] is None
    assert got[2] == [(1 << 3) + (1 << 4)] + [0] * 7


def test_components_take_no_step_more_than_needed(spark, monkeypatch):
    """Links that are stars take no step, and the last step is not repeated to see that it changed nothing."""
    from corpuslab.operators import components as module

    steps = []
    smallest = module._smallest
    monkeypatch.setattr(module, "_smallest", lambda edges: steps.append(1) or smallest(edges))

    def found(links):
        steps.clear()
        return {r.node: r.component for r in module.components(spark.createDataFrame(links, "a long, b long")).collect()}

    assert found([(5, 1), (1, 7), (9, 2), (3, 3), (1, 5)]) == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2} and not steps
    assert found([(1, 2), (2, 3), (8, 9)]) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and len(steps) == 2
    chain = [(i, i + 1) for i in range(40)]
    assert found(chain) == dict.fromkeys(range(41), 0)
    assert found([]) == {} and not steps

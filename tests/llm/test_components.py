import random

import pytest

from edictum.llm.components import connected_components


def brute(edges):
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(None, 3), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {x["node"]: x["component"] for x in got} == brute(edges) and len(got) == len(brute(edges))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0

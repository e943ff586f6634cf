import random
import re
from collections import Counter, defaultdict

import pytest

from pagequarry.llm.components import connected_components
from pagequarry.llm.near_join import choose_bands, keep_one, near_join


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128
    with pytest.raises(ValueError):
        choose_bands(0.01, 0.999, 8)


def test_the_bands_of_the_production_parameters():
    bands, rows = choose_bands(0.8, 0.999)
    assert (bands, rows) == (18, 5) and round(1 - (1 - 0.8**rows) ** bands, 4) == 0.9992


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j != k).items():
            if n * 9 >= 4 * (len(s) + len(sets[j])):
                links[k] += 1
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    order = lambda i: (i is None, i or 0)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), i), i, key=order)
    return Counter((i, first[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def rows():
    r = random.Random(2)
    base = [r.choice("abcdefghijk") * r.randint(1, 3) for _ in range(60)]
    out = [(0, ""), (1, None), (2, "a b"), (3, "a  b"), (4, "c d e"), (None, "n o p q r s"), (5, "n o p q r s"), (6, "k l m n o p"), (6, "k l m n o p")]
    for i in range(120):
        w = list(base) if i % 2 else [r.choice("lmnopq") * r.randint(1, 3) for _ in range(60)]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"z{r.randint(0, 99)}"
        out.append((10 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [2000, 25])
def test_against_brute_force(spark, block):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, cid string").repartition(3)
    got = near_join(df, block=block).collect()
    assert Counter((x.doc_id, x.class_id, x.n_links) for x in got) == brute(rows())


def test_keep_one(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, n string")
    got = keep_one(df)
    assert got.columns == df.columns
    classes = {c for _, c, _ in brute(rows())}
    assert Counter(r.doc_id for r in got.collect()) == Counter(classes)
    assert keep_one(df.where("false")).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in touched}

"""The Jaccard join against brute force: every pair of similarity 0.8 or more is a link."""

import random

import pytest

from matchlight.llm import chosen_path
from matchlight.llm.components import components


def shingles(text):
    w = (text or "").split(" ") if not text else text.split()
    if not w or not text:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(texts):
    sets = [shingles(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in range(len(texts))}


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, class_id int, a string, n_links int").repartition(4)


def got(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(5))
    return " ".join(w)


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "one two", "a b c d e", "a b c d e", "a b c d f"]
    for _ in range(30):
        base = prose(rng, rng.choice((20, 80, 300)))
        texts += [base] * rng.randint(1, 3)
        texts += [edited(rng, base, rng.randint(1, 6)) for _ in range(rng.randint(0, 6))]
    rng.shuffle(texts)
    assert got(chosen_path.join(table(spark, texts))) == brute(texts)


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randint(0, 4)) for _ in range(600)] + [prose(rng, 60) for _ in range(200)]
    shared = prose(rng, 30)
    texts += [shared + " " + prose(rng, 70) for _ in range(300)]
    texts += [texts[0]] * 40
    assert got(chosen_path.join(table(spark, texts))) == brute(texts)


def test_excerpts_of_a_large_group(spark):
    """An excerpt at 0.77 of a large group's leader, and an excerpt of it that is not near the leader and meets it in the large buckets only."""
    texts = []
    for seed in (744, 1135, 1424):
        rng = random.Random(seed)
        base = prose(rng, 200)
        w = base.split()
        texts += [edited(rng, base, 1) for _ in range(320)] + [" ".join(w[:155]), " ".join(w[:126])]
    assert got(chosen_path.join(table(spark, texts))) == brute(texts)


def test_near_the_threshold(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(250):
        base = prose(rng, 104)
        w = base.split()
        w[-rng.choice((8, 10, 11, 12, 13)) :] = prose(rng, 11).split()
        texts += [base, " ".join(w)]
    assert got(chosen_path.join(table(spark, texts))) == brute(texts)


def test_one_document_of_each_class_stays(spark):
    rng = random.Random(3)
    base = prose(rng, 100)
    texts = [prose(rng, 50), base, base, edited(rng, base, 1), None, ""]
    docs = table(spark, texts)
    left = chosen_path.distinct(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 4, 5]
    assert chosen_path.join(docs.limit(0)).count() == chosen_path.distinct(docs.limit(0)).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)] + [(60, 50), (50, 70)], [(0, i) for i in range(1, 200)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    root = {x: x for l in links for x in l if l[0] != l[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["root"] for r in components(df).collect()} == root


def test_repeated_rows_are_copies(spark):
    rng = random.Random(8)
    base = prose(rng, 60)
    texts = [None, "", base, edited(rng, base, 1), prose(rng, 40), "one two"]
    docs = table(spark, texts)
    once, twice = got(chosen_path.join(docs)), chosen_path.join(docs.union(docs)).collect()
    assert len(twice) == 12
    for r in twice:
        c, n = once[r["doc_id"]]
        assert (r["class_id"], r["n_links"]) == (c, 2 * n + 1 if texts[r["doc_id"]] else 0)
    assert sorted(r["doc_id"] for r in chosen_path.distinct(docs.union(docs)).collect()) == sorted(r["doc_id"] for r in chosen_path.distinct(docs).collect())

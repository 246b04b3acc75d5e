"""Similar documents: the components are those of all pairs at 0.8 and of no other pair."""

import random
from collections import defaultdict

from citaforge.llm import simhash


def word(rng):
    return f"{rng.choice('bcdfgklm')}{rng.randrange(10**9):x}"


def words(rng, n):
    return [word(rng) for _ in range(n)]


def scattered(rng, block, n):
    """The block with n words of its own put in, all of 5 words apart or more."""
    out = list(block)
    for at in sorted(rng.sample(range(1, len(block) // 6), n), reverse=True):
        out.insert(6 * at, word(rng))
    return out


def exact(texts, t=0.8):
    """The smallest id of each text's component, by all pairs."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if b < a and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def check(spark, texts):
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(4)
    found = defaultdict(set)
    for d, c in simhash.similar_documents(df).collect():
        found[d].add(c)
    want = exact(texts)
    assert {d: {c} for d, c in want.items()} == found
    return want


def test_near_copies_among_texts_that_share_a_passage(spark):
    rng = random.Random(31)
    block, texts = words(rng, 235), {}
    for i in range(250):  # unlike each other, but for the passage
        texts[i] = own = block + words(rng, 65)
        texts[1000 + i] = scattered(rng, own, 7)
    want = check(spark, texts)
    assert all(want[1000 + i] == i for i in range(250))


def test_texts_just_under_the_similarity_stay(spark):
    rng = random.Random(32)
    block = words(rng, 260)
    texts = {i: block + words(rng, 39) for i in range(80)}  # all pairs at 0.767
    want = check(spark, texts)
    assert all(want[d] == d for d in texts)


def test_contiguous_edits_are_found(spark):
    rng = random.Random(33)
    texts = {}
    for i in range(150):
        own = words(rng, 304)
        texts[i] = own
        texts[200 + i] = own[:-33] + words(rng, 33) if i % 2 else own + words(rng, 74)  # at 0.802 and 0.802
    want = check(spark, texts)
    assert all(want[200 + i] == i for i in range(150))

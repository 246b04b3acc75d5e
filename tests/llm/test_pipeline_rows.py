"""Stages of the pipeline on documents whose ids are null or repeat."""

import random
from collections import Counter

import corpus_pipeline
from citaforge.llm import simhash

from .test_queries import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], SCHEMA).repartition(3)


def benchmark(spark, path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def texts(df):
    return Counter(r["text"] for r in df.collect())


def test_different_texts_of_one_id_stay(spark, tmp_path):
    rng = random.Random(41)
    rows = [(d, prose(rng, 60), "s") for d in (None, None, None, 7, 7, 8)]
    again = [rows[0], rows[3], (9, rows[5][1], "s"), (None, rows[4][1], "s")]
    assert texts(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows + again), str(tmp_path))) == Counter(t for _, t, _ in rows)


def test_one_contaminated_row_of_an_id_goes(spark, tmp_path):
    rng = random.Random(42)
    item = prose(rng, 20)
    benchmark(spark, tmp_path, [(1, item)])
    rows = [(d, prose(rng, 60), "s") for d in (None, None, 7, 7)]
    bad = [(None, prose(rng, 60) + " " + item, "s"), (7, prose(rng, 60) + " " + item, "s")]
    assert texts(corpus_pipeline.drop_contaminated(spark, frame(spark, rows + bad), str(tmp_path))) == Counter(t for _, t, _ in rows)


def test_mixing_takes_each_row_by_itself(spark, tmp_path):
    rng = random.Random(43)
    rows = [(d, prose(rng, 60), f"s{i % 3}") for i, d in enumerate([None] * 9 + [7] * 9)]
    rows += rows[:2]
    found = texts(corpus_pipeline.mix_sources(spark, frame(spark, rows), str(tmp_path)))
    repeated = Counter(t for _, t, _ in rows)
    assert found and all(n <= 3 * repeated[t] for t, n in found.items())


def test_an_item_without_an_id_counts(spark, tmp_path):
    rng = random.Random(44)
    item = prose(rng, 20)
    benchmark(spark, tmp_path, [(None, item), (1, prose(rng, 20))])
    rows = [(1, prose(rng, 60), "s"), (2, prose(rng, 60) + " " + item, "s")]
    assert texts(corpus_pipeline.drop_contaminated(spark, frame(spark, rows), str(tmp_path))) == Counter([rows[0][1]])


def linked(pairs, nodes):
    """The nodes' groups by the pairs."""
    group = {i: {i} for i in nodes}
    for a, b in pairs:
        together = group[a] | group[b]
        group.update(dict.fromkeys(together, together))
    return group


def test_near_duplicates_meet_in_balls_of_fingerprints(spark, monkeypatch):
    """Pairs at two bits are asked so that they connect all such texts; shingles add pairs across their components only."""
    rng = random.Random(45)
    base = [prose(rng, 300) for _ in range(12)]
    near = [" ".join(w if rng.random() > 0.004 else f"new{rng.randrange(10**9)}" for w in t.split()) for t in base for _ in range(6)]
    found = dict(enumerate([*base, *near, "", "two words"]))
    fps = {d: simhash.simhash(t.encode()) for d, t in found.items()}
    ids = {d: simhash._set_id(simhash.shingle_set(t.encode(), 5)) for d, t in found.items()}
    by_id = {i: fps[d] for d, i in ids.items()}
    close = lambda a, b: (by_id[a] ^ by_id[b]).bit_count() <= 2
    want = linked([(a, b) for a in by_id for b in by_id if a < b and close(a, b)], by_id)
    assert sum(len(g) > 1 for g in want.values()) > 20
    asked, confirmed = [], simhash._confirmed

    def spy(docs, pairs, *rest):
        asked.append([(r["a"] % 2**64, r["b"] % 2**64) for r in pairs.collect()])
        return confirmed(docs, pairs, *rest)

    monkeypatch.setattr(simhash, "_confirmed", spy)
    kept = texts(corpus_pipeline.drop_near_duplicates(spark, frame(spark, [(d, t, "s") for d, t in found.items()]), ""))
    assert linked([p for p in asked[0] if close(*p)], by_id) == want
    assert all(b not in want[a] for a, b in asked[0] if not close(a, b))
    assert kept == Counter([*base, "", "two words"])  # the links out of a ball's reach are found too

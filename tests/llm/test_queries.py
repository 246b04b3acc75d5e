"""Registered corpus queries: against their SQL, and the pipeline against its parts."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citaforge.llm import queries, simhash

from . import fixtures

DIR = "/root/testdata/sf0.001"


def rows(found):
    return sorted(map(tuple, found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Tables with hard rows in every column."""
    path = tmp_path_factory.mktemp("hard")
    texts = fixtures.texts()
    fixtures.docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    words = texts[16].split()
    items = [(1, " ".join(words[5:40])), (2, " ".join(words[30:50])), (3, "one two three"), (4, None), (None, " ".join(words[60:70])), (5, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(d, None, t) for d, t in texts.items()] + [(100, "u", texts[29]), (101, "u", texts[29])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    talk = [(c, t, r, x) for c in range(5) for t, r, x in ((0, "user", texts[30]), (1, "assistant", None), (2, None, "é|<["), (2, "assistant", "\\"))]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", queries.ORACLES)
@pytest.mark.parametrize("where", ["given", "hard"])
def test_query_equals_its_sql(spark, hard, name, where):
    link, path = duckdb.connect(), DIR if where == "given" else hard
    for t in "documents pages conversations benchmark".split():
        link.execute(f"create view {t} as select * from '{path}/{t}.parquet{'' if where == 'given' else '/*.parquet'}'")
    df = queries.QUERIES[name](spark, path)
    names = sorted(df.columns)
    want = link.execute(f"select {', '.join(names)} from ({queries.ORACLES[name]}) z").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    if where == "hard":  # rows that repeat an id are one group in the SQL's joins
        want, got = set(want), set(got)
    assert rows(got) == rows(want)


def prose(rng, n):
    return "The report of the day is that " + " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10**6):x}" for _ in range(n)) + " and it is done."


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    clean = {i: prose(rng, 60 + i) for i in range(40)}
    item = prose(rng, 20)
    docs = clean | {100: clean[3], 101: clean[3] + " ", 102: "too short", 103: None, 104: "", 105: prose(rng, 60) + " " + item, 106: " ".join(f"{w}***" for w in clean[5].split()), 107: "buy it now " * 60}
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in docs.items()] + [(7, clean[7], "en", "s1", 1), (None, prose(rng, 80), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == list(corpus_pipeline.COLUMNS)
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([r["doc_id"] for r in now.select("doc_id").collect()])
    assert set(seen[0]) == set(clean) | {100, 101, 105, None}
    assert sorted(seen[1], key=str) == sorted([*clean, 105, None], key=str)
    assert sorted(seen[2], key=str) == sorted([d for d in seen[1] if d != 105], key=str)
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].count(d) for d in seen[3]) <= 3
    assert sorted(seen[4], key=str) == sorted(seen[3], key=str)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == len(seen[3]) and final.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == final.agg(F.sum("n_tokens")).first()[0]


def test_pipeline_on_no_documents(spark, tmp_path):
    fixtures.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fingerprints_equal_the_built_in_hash(spark):
    df = spark.createDataFrame([("a b c",), ("é ß x",)], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    for r in df:
        assert simhash.simhash(r["t"].encode()) == r["h"] & (1 << 64) - 1


def test_similar_documents(spark):
    rng = random.Random(21)
    texts, edited = {}, {}
    for i in range(60):
        words = prose(rng, 80 + 5 * i).split()
        texts[i] = " ".join(words)
        for k in range(3):  # some words in a hundred changed
            new = [w if rng.random() > 0.012 else f"new{rng.randrange(10**9)}" for w in words]
            texts[1000 + 3 * i + k] = edited[1000 + 3 * i + k] = " ".join(new)
    hot = prose(rng, 300).split()
    for k in range(150):  # a large group of near copies
        texts[5000 + k] = " ".join([*hot[:k], f"odd{k}", *hot[k:]])
    texts |= {9000: "", 9001: None, 9002: "a b", 9003: "A  B", 9004: texts[0]}
    rows = [(d, t, "x") for d, t in texts.items()] + [(9004, texts[0], "y"), (None, texts[1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(4)
    found = defaultdict(set)
    for r in simhash.similar_documents(df).collect():
        found[r["doc_id"]].add(r["component_id"])
    split = {d: (t or "").lower().split() for d, t in texts.items()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in split.items()}
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    near = [(d, (d - 1000) // 3) for d in edited if like(d, (d - 1000) // 3) >= 0.85]
    assert len(near) > 80 and sum(found[a] == found[b] for a, b in near) >= 0.97 * len(near)
    for d, roots in found.items():
        root = min(roots)
        if d is not None and root != d:
            assert len(roots) == 1 and like(d, root) > 0.6
    assert all(found[5000 + k] == {5000} for k in range(150))
    assert found[9000] == found[9001] == {9000} and found[9002] == found[9003] == {9002} and found[9004] == found[0] == {0} and found[None] == found[1]
    assert simhash.similar_documents(fixtures.empty(spark)).count() == 0

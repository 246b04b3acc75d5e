"""The operators against brute force on small tables with hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citaforge.llm import chat, decontaminate, mixing, pii, quality_model, quality_rules, simhash, suffix_dedup, token_files, warc

from . import brute, fixtures


def matches(found, expected, key="doc_id"):
    for r in found:
        want = expected[r[key]]
        assert {k: r[k] for k in want} == want, r[key]


def test_quality_rules(spark):
    out = quality_rules.apply_rules(fixtures.docs(spark)).select("doc_id", "quality.*")
    found = fixtures.rows(out)
    assert len(found) == len(fixtures.texts()) + 3
    matches(found, {d: brute.quality(t) for d, t in fixtures.texts().items()})
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert not kept[4] and not kept[5] and not kept[27] and not kept[28]
    assert quality_rules.apply_rules(fixtures.empty(spark)).count() == 0


def test_quality_rules_keep_clean_prose(spark):
    text = "The quick brown fox and the lazy dog went to the river, and it is said that they have been there with the others for a long while. " * 1
    varied = " ".join(f"{text} Item {i} of the list is not like that one." for i in range(1)) + " Many further words follow here so that the document has more than fifty words in all, as the rule asks of it, and none of them repeat."
    assert quality_rules.apply_rules(spark.createDataFrame([(1, varied)], "doc_id long, text string")).first()["quality"]["kept"]


def test_pii(spark):
    out = pii.find_pii(fixtures.docs(spark)).select("doc_id", "text", *pii.digest(F.col("pii")))
    found = fixtures.rows(out)
    matches(found, {d: brute.pii(t) for d, t in fixtures.texts().items()})
    by = {r["doc_id"]: r for r in found}
    assert by[26]["spans"].count("iban:") == 1 and by[26]["spans"].count("ssn:") == 2
    assert pii.find_pii(fixtures.empty(spark)).count() == 0


def test_pii_context_moves_scores_and_redaction_masks(spark):
    df = spark.createDataFrame([(1, "my phone: +4930123456 ok"), (2, "zzz +4930123456"), (3, "n 123-45-6789"), (4, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.redact(pii.find_pii(df)).collect()}
    assert out[1]["pii"][0]["score"] > out[2]["pii"][0]["score"]
    assert out[3]["pii"] == [] and out[4]["text"] is None
    assert out[1]["text"] == "my phone: [phone] ok"


def test_pii_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789 .-+@()ab_%é1234") for _ in range(rng.randrange(1, 160))) for _ in range(400)]
    out = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", *pii.digest(F.col("pii")))
    matches(fixtures.rows(out), {i: brute.pii(t) for i, t in enumerate(texts)})


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("spread", [4096, 5, 1, 0])
def test_suffix_dedup(spark, monkeypatch, keep, spread):
    texts = {d: t for d, t in fixtures.texts().items() if len(t or "") < 20000}
    rng = random.Random(5)
    shared = fixtures.prose(rng, 33)
    for d in range(100, 130):  # one passage in many surroundings, shorter and longer than a window
        texts[d] = fixtures.prose(rng, rng.randrange(5, 40)) + " " + shared + (" tail" * (d % 3)) + fixtures.prose(rng, rng.randrange(5, 40))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    if spread:
        monkeypatch.setattr(suffix_dedup.find_repeats, "__defaults__", (200, "none", 40, spread))
    else:  # a worker's memory ends within a group
        monkeypatch.setattr(suffix_dedup, "ORDER_BYTES", 1000)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(df, keep=keep).collect()}
    data = {d: (t or "").encode() for d, t in texts.items()}
    assert found == (brute.repeats(data) if keep == "none" else brute.later_repeats(data))


def test_suffix_dedup_on_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x" * 300), (1, "x" * 300), (None, "y" * 100), (2, None)], "doc_id long, text string")
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicate(df, keep="none").collect()]
    assert sorted(found, key=str) == sorted([(1, 300, 300), (1, 300, 300), (None, 100, 0), (2, 0, 0)], key=str)
    assert suffix_dedup.deduplicate(fixtures.empty(spark), keep="none").count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 100) for _ in range(5000))
    whole = suffix_dedup.text_runs(text, 50, 10)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    parts = suffix_dedup.text_runs(text, 50, 10)
    assert set(parts[3] - parts[2] - 49) >= {1} and sum(parts[3] - parts[2] - 49) == sum(whole[3] - whole[2] - 49) == 5000 - 49


def test_longest_previous_factors():
    for text in (b"", b"a", b"aaaa", b"abracadabra", b"mississippi", bytes(random.Random(2).choice(b"ab") for _ in range(60))):
        want = [max((k for j in range(i) for k in range(len(text) - i + 1) if text[j : j + k] == text[i : i + k]), default=0) for i in range(len(text))]
        assert suffix_dedup.longest_previous_factors(text).tolist() == want


@pytest.mark.parametrize("length", [1, 2, 4, 5, 6, 9, 10, 13, 20, 33])
def test_factors_reach_a_length(length):
    rng = random.Random(length)
    for n in (length, 40, 300):
        text = bytes(rng.choice(b"ab") for _ in range(n)) + b"abcabcabc" * (n // 20)
        starts = np.arange(len(text) - length + 1)
        before, after = suffix_dedup.factors(np.frombuffer(text, np.uint8), starts, length)
        lpf, back = suffix_dedup.longest_previous_factors(text), Counter(text[i : i + length] for i in starts)
        assert before.tolist() == (lpf[starts] >= length).tolist()
        assert (before | after).tolist() == [back[text[i : i + length]] > 1 for i in starts]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", fixtures.texts()[30]), (1, 2, None, None), (2, 0, "assistant", "é" * 50), (3, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (4, 5, "sys|<tem", "\\"), (4, None, "user", "[")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    found = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["learnt"]) for r in out.collect()}
    assert found == {c: ([x[1:] for x in sorted(v)], "".join(x[2] for x in sorted(v) if x[1] == "assistant")) for c, v in by.items()}
    assert chat.render(df.limit(0)).count() == 0


def test_chat_events(spark):
    events = [(1, 0, 0, "message", "user", "q"), (1, 1, 2, "delta", "assistant", "lo"), (1, 1, 1, "delta", "assistant", "hel"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", "assistant", "bye"), (1, 1, 5, "delta", None, "!"), (1, 2, 0, "message", "user", "old"), (1, 2, 9, "edit", "user", "new")]
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string").withColumn("message", F.lit("m"))
    found = sorted(tuple(r) for r in chat.fold_events(df).collect())
    assert found == [(1, 0, "user", "q"), (1, 1, "assistant", "bye!"), (1, 2, "user", "new")]


def test_chat_logs_fold_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", fixtures.texts()[30]), (1, 1, "assistant", "b"), (2, 0, "assistant", "é😀漢" * 7), (2, 1, "assistant", None), (2, 2, "assistant", ""), (3, None, None, None), (None, 0, "user", fixtures.texts()[17]), (4, 0, "user", "twice"), (4, 0, "user", "twice")]
    log = chat.logged_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds == {"message": 10, "delta": 20, "regenerate": 5, "edit": 5}
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, chat.fold_events(log).collect()), key=key) == sorted([(c, n, r or "", t or "") for c, n, r, t in rows], key=key)


def test_mixing(spark):
    df = fixtures.docs(spark)
    found = fixtures.rows(mixing.mix(df))
    source = {d: (f"src{d % 4}" if d % 5 else None) for d in fixtures.texts()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in found:
        assert r["size"] == count(fixtures.texts()[r["doc_id"]]) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
    want = brute.mix_targets(sizes)
    assert len(found) == len(fixtures.texts()) + 3
    for r in found:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
    again = fixtures.rows(mixing.mix(df.repartition(3)))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_mixing_comes_near_its_targets(spark, ranges):
    rng = random.Random(4)
    rows = [(i, fixtures.prose(rng, rng.randrange(1, 60)), "abcdef"[min(5, rng.randrange(12))]) for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ranges=ranges)
    for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r["t"] - r["n"]) <= 31, r


def test_targets_spread_the_excess(spark):
    for sizes in ({"a": 1, "b": 50, "c": 7, None: 3}, {"a": 0, "b": 0}, {"a": 5}, {"s%02d" % i: i * i for i in range(25)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = brute.mix_targets(sizes)
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    found = fixtures.rows(token_files.round_trip(fixtures.docs(spark), path))
    rows = sorted([*fixtures.texts().items(), *[(d, fixtures.texts()[d]) for d in (0, 29, 4)]], key=lambda x: (x[0], x[1] or ""))
    want, at = [], 0
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    assert token_files.round_trip(fixtures.empty(spark), path).count() == 0


def test_token_memory_is_bounded(monkeypatch):
    path = tokenizer_path()
    texts = [f"word{i} other{i} <|endoftext|>" for i in range(600)]
    whole = token_files.encode_texts(texts, path)
    token_files._ENCODERS.clear()
    monkeypatch.setattr(token_files, "MEMO", 10)
    assert all((a == b).all() for a, b in zip(whole, [x for i in range(0, 600, 50) for x in token_files.encode_texts(texts[i : i + 50], path)]))
    token_files._ENCODERS.clear()


def test_words_with_signs_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(7)
    pool = ["IN!!", "de%%%", "|", "est&&&", "la.&&&", "(716)", "THTI.!!", "Eux***", "x", "naïve", "ß$$$", "A,", "b.", "c!,", "d#.\ne"]
    texts = [" ".join(["Begin", *rng.choices(pool, k=30)]) for _ in range(300)]
    token_files._ENCODERS.clear()
    token_files.encode_texts(["a"], path)
    e, made = token_files._ENCODERS[path], []
    split = e._split
    monkeypatch.setattr(e, "_split", lambda text: made.append(text) or split(text))
    for text, ids in zip(texts, token_files.encode_texts(texts, path)):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], repr(text)
    made = [x for x in made if x != "Begin"]  # the first word of each
    assert made and len(made) == len(set(made))
    long = "漢字" * 2000 + "。 " + "ab!" * 2000 + " end"
    assert token_files.encode_texts([long], path)[0].tolist() == [*t.encode(long, add_special_tokens=False).ids, 2]
    assert max(map(len, [*e.words, *e.pieces])) <= token_files.LONGEST
    token_files._ENCODERS.clear()


def test_tokens_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["".join(rng.choice([" ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "Bc", "é", "漢", "1", "½", "'s", "'", ".", ". ", ", ", ".\n", "!?", "😀", "\u0301", "_", "<|endoftext|>", "\0", "\2"]) for _ in range(rng.randrange(25))) for _ in range(6000)]
    texts.append("a <|endoftext|> b")
    for text, ids in zip(texts, token_files.encode_texts(texts, path)):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], repr(text)
    assert ids.tolist() == [64, 220, 50256, 275, 2]  # an added token's string is that token


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000, 300_000])
def test_segments_round_trip(n, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100_000)
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=60_000).astype(np.uint32)
    docs = np.split(ids, [n // 3, n // 2])
    data = token_files.encode_segment(docs, 5)
    lengths, out = token_files.decode_segment(data)
    assert lengths.tolist() == [len(d) for d in docs] and (out == ids).all()
    if n > 200_000:
        assert (token_files.decode_segment(data, range(1, 2))[1] == ids[100_000:200_000]).all()
        broken = bytearray(data)
        broken[-8] ^= 1
        with pytest.raises(ValueError):
            token_files.decode_segment(bytes(broken))


@pytest.mark.parametrize("block", [8 << 20, 150])
def test_decontamination(spark, block):
    texts = fixtures.texts()
    words = (texts[16] or "").split()
    items = {1: " ".join(words[100:130]), 2: " ".join(words[125:140]), 3: "one two three", 4: "absent words only here in this one item of the list", 5: None, 6: "...", 7: texts[17][:40], 11: " ".join(words[100:108]).upper() + "!", 12: texts[0]}
    bench = spark.createDataFrame([*items.items(), (1, items[1])], "item_id long, text string")
    out = decontaminate.find_contamination(fixtures.docs(spark), bench, block_bytes=block)
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["contaminated"]) for r in fixtures.rows(out)}
    assert found == brute.contamination(texts, items)
    assert found[16][2] >= 3
    assert decontaminate.find_contamination(fixtures.empty(spark), bench).count() == 0
    none = decontaminate.find_contamination(fixtures.docs(spark), bench.limit(0)).agg(F.sum("n_hit"), F.sum("n_words")).first()
    assert none[0] == 0 and none[1] > 9000


def test_simhash(spark):
    found = fixtures.rows(simhash.near_duplicates(fixtures.docs(spark)))
    want = brute.components(fixtures.texts())
    assert len(found) == len(want) + 3
    assert {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found} == want
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_ball_links_find_every_pair_and_chain(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for x in prints[:30]:
        y = x
        for _ in range(rng.randrange(1, 12)):  # chains of one to three flipped bits
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                y ^= 1 << b
            prints.append(y)
    prints = list(dict.fromkeys(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    up = {x: x for x in signed}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert {x: roots.get(x, x) for x in signed} == {x: top(x) for x in signed}


def test_connected_joins_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long").where("a != b")
    assert {(r["node"], r["root"]) for r in simhash.connected(links).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_warc(spark):
    texts = {d: t for d, t in fixtures.texts().items()} | {50: "z" * 500_000, 51: "z" * 500_000, 52: "é\r\n\r\n0\r\n\r\n" * 9000}
    rows = [(d, f"http://x/{d}\r\nBad: 1" if d % 2 else None, t, "extra") for d, t in texts.items()] + [(None, None, "only here", "x"), (29, None, texts[29], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, mark string").repartition(3)
    found = fixtures.rows(warc.round_trip(df))
    first = {}
    for d, t in sorted(texts.items()):
        first.setdefault(t or "", d)
    assert len(found) == len(rows)
    for r in found:
        text = (texts[r["page_id"]] if r["page_id"] is not None else "only here") or ""
        want = first.get(text, None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), warc.digest(text.encode()))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == r["page_id"] else ("revisit", want))
    least = fixtures.rows(warc.round_trip(df, least=1000))
    assert {r["page_id"] for r in least if r["record_type"] == "revisit"} == {51}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_splits_pages_and_keeps_ids(spark):
    ids = ["a:b", "x/y %20", "é<>", "plain", "1.2"]
    df = spark.createDataFrame([(x, "http://h", f"{x} " * 900 * k) for k, x in enumerate(ids)], "page_id string, url string, html string")
    archives = warc.write_archives(df).collect()
    records = [(r["segmented"], f) for r in archives for f, _ in warc.parse_archive(bytes(r["data"]))]
    kinds = Counter((cut, f["warc-type"]) for cut, f in records)
    assert kinds[True, "response"] > 0 and kinds[True, "continuation"] > kinds[True, "response"] and kinds[False, "response"] > 0
    assert kinds[True, "warcinfo"] + kinds[False, "warcinfo"] == len(archives) and all("warc-date" in f and "warc-record-id" in f for _, f in records)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.round_trip(df).collect()) == sorted((x, len((f"{x} " * 900 * k).encode())) for k, x in enumerate(ids))


def test_warc_segments_are_verified(spark):
    records = warc.response_records("urn:page:1:0.0", "u", b"payload" * 5000, 1000)
    data = b"".join(random.Random(1).sample(records, len(records)))
    frame = lambda d: spark.createDataFrame([("a", True, bytearray(d))], "archive string, segmented boolean, data binary")
    assert warc.read_archives(frame(data)).first()["payload_bytes"] == 35000
    with pytest.raises(Exception, match="do not make up"):
        warc.read_archives(frame(b"".join(records[:-2] + records[-1:]))).collect()
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def junk(rng, n):
    return " ".join(f"{w}{rng.choice(['***', '$$$', '###'])}" for w in fixtures.prose(rng, n).split())


def test_quality_model(spark):
    rng = random.Random(11)
    clean = [(i, " ".join(f"{a} the" for a in fixtures.prose(rng, 80, 4000).split()) + ".") for i in range(240)]
    bad = [(1000 + i, junk(rng, 80)) for i in range(40)] + [(2000 + i, "buy now cheap " * 40) for i in range(40)]
    df = spark.createDataFrame([*clean, *bad, (5000, None), (5001, "")], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in quality_model.classify(df, sample=200).collect()}
    assert len(found) == 322 and all(0 <= r["score"] <= 1 for r in found.values())
    right = sum(found[d]["kept"] for d, _ in clean) + sum(not found[d]["kept"] for d, _ in bad)
    assert right >= 0.98 * (len(clean) + len(bad)) and all(found[d]["kept"] for d, _ in clean)
    assert {d: r["score"] for d, r in found.items()} == {r["doc_id"]: r["score"] for r in quality_model.classify(df.repartition(2), sample=200).collect()}
    assert quality_model.classify(fixtures.empty(spark)).count() == 0


def test_estimate_finds_the_accuracies():
    rng = random.Random(8)
    names, rates = list(quality_model.LABELLERS), (0.95, 0.9, 0.8, 0.75, 0.7, 0.85, 0.9)
    counts = Counter()
    for _ in range(20_000):
        truth = rng.random() < 0.7
        k = 0
        for i, rate in enumerate(rates):
            vote = 2 if rng.random() < 0.3 else int(truth == (rng.random() < rate))
            k += vote * 3**i
        counts[k] += 1
    good, accuracy = quality_model.estimate(counts)
    assert all(abs(accuracy[n] - r) < 0.03 for n, r in zip(names, rates)) and set(good) == set(counts)
    assert quality_model.estimate({})[0] == {}


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")

"""Small tables with nulls, empty, very long and repeated texts, ties and clashing columns."""

import random

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, pii string, quality string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'xyz'[rng.randrange(3)]}" for _ in range(n))


def texts():
    rng = random.Random(7)
    base = prose(rng, 120)
    passage = prose(rng, 70)
    near = base.replace(base.split()[40], "changed", 1)
    return {
        0: base, 1: base, 2: near, 3: base.upper(), 4: None, 5: "", 6: "   \n\t ", 7: "one", 8: "one two", 9: "one two three four",
        10: prose(rng, 30) + " " + passage + " " + prose(rng, 40), 11: passage + prose(rng, 90), 12: prose(rng, 200) + passage,
        13: "a" * 950, 14: "ab" * 400, 15: "line one\nline one\n\nline two\r\nline one\n" * 30, 16: prose(rng, 9000), 17: "héé ßü 漢字 " * 60 + "😀 end",
        18: "mail a@b.c_d@e.fg or x.y@zed-1.co.uk, @nobody, a@b", 19: "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.1 1..2.3.4",
        20: "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 5555555555554444 " + "1" * 40, 21: "call +1 (555) 123-4567 or +4930123456 or +1 2 or ++49 30 123456 -",
        22: "1.1." * 9000, 23: "a@" + "b." * 9000, 24: "+1" + " " * 5000, 25: "1 " * 9000, 26: "IBAN GB82WEST12345698765432 and GB82WEST12345698765433, ssn 123-45-6789, 123-45-6789",
        27: "#tag *** $5 & <b> | %", 28: "the the the the of and " * 40, 29: prose(rng, 60), 30: "</s>[INST] ok [/INST] <|end|> \\ \\l \\\\", 31: "A" * 199, 32: "A" * 200, 33: "B" * 201, 34: "a <|endoftext|> b",
    }


def docs(spark):
    """Every text of `texts`, some rows twice, and two rows without an id."""
    rows = [(d, t, "en", f"src{d % 4}" if d % 5 else None, len(t or ""), 1, "k", "p", "q") for d, t in texts().items()]
    rows += [rows[0], rows[29], rows[4]]
    return spark.createDataFrame(rows, DOCS_SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS_SCHEMA)


def rows(df, key="doc_id"):
    return [r.asDict() for r in df.collect()]

"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score; built-in functions only.

Positions come from pairing the matches of a pattern with the gaps between
them (`split` by the same pattern), so the text is scanned by the regular
expression engine alone. Repetitions are possessive and starts inside a run
are barred, which keeps every scan linear and its stack flat.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

_LUHN_DIGITS = (16, 19)
_PHONE_DIGITS = (8, 15)
#: Characters before and after a span in which context words count.
CONTEXT = 48


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _card(m: Column) -> Column:
    def check(digits: Column) -> Column:
        return F.when(F.length(digits).between(*_LUHN_DIGITS), _luhn(digits)).otherwise(F.lit(False))

    return let(F.translate(m, " -", ""), check)


def _ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))


def _phone(m: Column) -> Column:
    return F.length(F.translate(m, " ().-+", "")).between(*_PHONE_DIGITS)


def _iban(m: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, the number is 1 modulo 97."""
    moved = F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. `gate` is a cheap test that every text with a match passes; `accept` the validator; spans scoring under `least` go."""

    name: str
    pattern: str
    gate: str
    accept: object
    context: str
    score: float
    least: float = 0.0


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, "mail|contact|correo|courriel", 0.9),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip, r"\bip\b|address|server|host", 0.7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9](?:[ -]?[0-9]){15}", _card, "card|visa|credit|carte|tarjeta|karte", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _phone, r"phone|tel|call|mobil|fax", 0.6),
    # Beyond the base: kept if the checksum or the words nearby confirm it.
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", _iban, "iban|account|bank|konto|compte|cuenta", 0.8, 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", None, "ssn|social|security", 0.3, 0.5),
)
BASE = ("email", "ip", "card", "phone")
_BOOST = 0.25
_SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _located(text: Column, kind: Kind) -> Column:
    """Every match with its place in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out"))

    def paired(m: Column) -> Column:
        return F.aggregate(F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), F.length(b).alias("gap"))), start, step, lambda acc: acc["out"])

    return let(found, lambda m: F.when(F.size(m) > 0, paired(m)).otherwise(F.array().cast("array<struct<m:string,s:int,e:int>>")))


def _spans(text: Column, kind: Kind) -> Column:
    def scored(x: Column) -> Column:
        left = F.greatest(x["s"] - CONTEXT, F.lit(0))
        near = F.lower(F.concat(F.substring(text, left + 1, x["s"] - left), F.lit(" "), F.substring(text, x["e"] + 1, F.lit(CONTEXT))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), _BOOST).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].cast("long").alias("start"), x["e"].cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    found = _located(text, kind)
    if kind.accept is not None:
        found = F.filter(found, lambda x: kind.accept(x["m"]))
    out = F.transform(found, scored)
    if kind.least:
        out = F.filter(out, lambda x: x["score"] >= kind.least)
    gate = text.contains(kind.gate) if kind.gate == "@" else text.rlike(kind.gate)
    return F.when(gate, out).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds `pii`: per row the spans (kind, start, end, score) by kind as listed, then start.

    Offsets are code points, ends exclusive. One projection without a shuffle;
    a null text counts as empty and has no span; repeated rows are treated
    alike; an empty table gives an empty one; a column `pii` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("pii", let(text, lambda t: F.concat(*[_spans(t, k) for k in kinds])))


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """Replaces each span of `pii` in `text` by its kind; of overlapping spans the one that starts first, and then the longest, wins."""
    ordered = F.array_sort(F.transform(F.col("pii"), lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x["kind"].alias("k"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    before, after = mask.split("{}")

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(before), x["k"], F.lit(after))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct((-x["e"]).alias("at"), piece.alias("out")))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return docs.withColumn("text", F.when(F.size("pii") > 0, done).otherwise(F.col("text")))


def digest(pii: Column) -> list[Column]:
    """Counts and digests of the base kinds, and all spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda k: lambda x: x["kind"] == k
    base = F.filter(pii, lambda x: reduce(lambda a, b: a | b, [x["kind"] == k for k in BASE]))
    return [
        *[F.size(F.filter(pii, of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(pii, line), ",").alias("spans"),
    ]

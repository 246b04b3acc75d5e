"""Scalar functions of the domain as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CLASS_MARKS, DIGIT_OF, INCIDENTS, UNITS

# The Latin letters that carry a mark in the languages served, and their bare forms.
_MARKED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
_HYPHENS = r"\-‐-―−"
_DIGITISH = f"[0-9{''.join(sorted(DIGIT_OF))}]"
_LETTERS, _DIGITS = "".join(DIGIT_OF), "".join(DIGIT_OF.values())


def strip_accents(text: Column) -> Column:
    """Without diacritics: composed Latin letters, and combining marks."""
    return F.regexp_replace(F.translate(text, _MARKED, _BARE), r"\p{M}", "")


def text_key(text: Column) -> Column:
    """Lower case, no accents, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def count_digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}"))


def split_unit(text: Column) -> Column:
    """Struct (text, unit): a closing federal unit of one or two letters taken off."""
    end, goias = rf"\s*[/({_HYPHENS}]\s*([A-Za-z]{{1,2}})\s*\)?[\s.]*$", rf"\s*[/({_HYPHENS}]\s*(?:G0|6O)\s*\)?[\s.]*$"
    unit = F.upper(F.regexp_extract(text, end, 1))
    taken = (F.length(unit) == 1) | unit.isin(*UNITS)
    cut = lambda p: strip(F.regexp_replace(text, p, ""))
    both = lambda t, u: F.struct(t.alias("texto"), u.alias("uf"))
    return F.when(taken, both(cut(end), unit)).when((unit == "") & text.rlike(goias), both(cut(goias), F.lit("GO"))).otherwise(both(strip(text), F.lit(None).cast("string")))


def _mapped(text: Column, pattern: str, repaired) -> Column:
    """The text with `repaired` applied to each match of `pattern`: gaps and matches zipped."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda a, b: F.concat(a, F.coalesce(repaired(b), F.lit("")))), "")


def repair_digits(text: Column) -> Column:
    """Misread letters back to digits, length kept: whole tokens, letters beside a digit, groups between separators (eight rounds)."""
    swap = lambda c: F.translate(c, _LETTERS, _DIGITS)
    token = r"[0-9A-Za-z][0-9A-Za-z.\-–—/]*[0-9A-Za-z]|[0-9A-Za-z]"
    number = lambda t: t.rlike("[0-9]") & t.rlike(r"[0-9A-Za-z].*[0-9A-Za-z]") & ~t.rlike(f"[A-Za-z&&[^{_LETTERS}]]")
    whole = _mapped(text, token, lambda t: F.when(number(t), swap(t)).otherwise(t))
    beside = _mapped(text, f"(?<=[0-9])[{_LETTERS}]|[{_LETTERS}](?=[0-9])", swap)
    # equal lengths: a digit of either wins
    out = F.array_join(F.zip_with(F.split(whole, ""), F.split(beside, ""), lambda a, b: F.when(b.rlike("[0-9]"), b).otherwise(a)), "")
    inner = rf"(?<=[0-9][.{_HYPHENS}/]){_DIGITISH}+(?=[.{_HYPHENS}/]|\s*$|\s+[^\w\s]|\s*[/(])"
    loose = rf"(?<![\w.])[lIi](?=\.?\s+{_DIGITISH}{{3}}[.\s]\s?{_DIGITISH}{{3}}\b)"
    rounds = F.sequence(F.lit(1), F.lit(8))
    fixed = F.aggregate(rounds, out, lambda acc, _: _mapped(_mapped(acc, inner, swap), loose, swap))
    return F.when(text == "", text).otherwise(fixed)


def identifier_digits(text: Column) -> Column:
    """Digits of the longest number of a cited text, unit and noise taken off; the first of equal ones."""
    found = F.regexp_extract_all(repair_digits(split_unit(text)["texto"]), F.lit(rf"[0-9](?:[\s.{_HYPHENS}/]*[0-9])*"), F.lit(0))
    ranked = F.transform(found, lambda m, i: F.struct(F.length(only_digits(m)).alias("n"), (-i).alias("i"), only_digits(m).alias("d")))
    return F.coalesce(F.array_max(ranked)["d"], F.lit(""))


def integer_of(text: Column) -> Column:
    """The number of a precedent or article, noise undone; null without digits."""
    return F.nullif(only_digits(repair_digits(text)), F.lit("")).cast("bigint")


def year_of(text: Column, pivot: int = 30) -> Column:
    """A year of four digits, or of two: up to `pivot` of this century."""
    n = text.cast("int")
    return F.when(F.length(text) == 4, n).when(F.length(text) == 2, n + F.when(n <= pivot, 2000).otherwise(1900))


def article_key(number: Column, letter: Column) -> Column:
    base = F.replace(number, F.lit("."), F.lit("")).cast("bigint").cast("string")
    return F.concat(base, F.coalesce(F.concat(F.lit("-"), F.upper(letter)), F.lit("")))


def class_marks(text: Column) -> Column:
    """Sorted marks of the class of proceedings; each place gives the first alternative that matches there."""
    start = r"(?:(?<![a-z])|(?<=\bn[oa]s)|(?<=\bn[oa])|(?<=\bd[oa]s)|(?<=\bd[oa]))"
    whole = "|".join(f"{start}(?:{p})(?![a-z])" for p, _ in CLASS_MARKS)

    def mark(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, name in reversed(CLASS_MARKS):
            out = F.when(m.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text_key(text), F.lit(whole), F.lit(0)), mark)))


def affinity(cited: Column, recorded: Column) -> Column:
    """Marks in common, less the incidents of one side alone."""
    apart = F.array_union(F.array_except(cited, recorded), F.array_except(recorded, cited))
    return F.size(F.array_intersect(cited, recorded)) - F.size(F.array_intersect(apart, F.array(*[F.lit(x) for x in sorted(INCIDENTS)])))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 if they are disjoint."""
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(both > 0, both / ((a1 - a0) + (b1 - b0) - both)).otherwise(F.lit(0.0))


def located(text: Column, pattern: str) -> Column:
    """array<struct<inicio, fim, trecho>> of a pattern's matches in code points: matches paired with the gaps between them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<inicio:int,fim:int,trecho:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("inicio"), e.alias("fim"), x["m"].alias("trecho")))).alias("out"))

    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """array<struct<inicio, fim>> of sentences: they end at a stop before white space or the end, unless a word of one to three letters stands before it."""
    stop = r"(?<!\b[A-Z])(?<!\b[A-Za-z]{2})(?<!\b[A-Za-z]{3})[.!?](?=\s|$)"
    ends = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(located(text, stop), lambda m: m["fim"]), F.array(F.length(text))))
    pairs = F.transform(ends, lambda e, i: F.struct(F.get(ends, F.greatest(i - 1, F.lit(0))).alias("inicio"), e.alias("fim")))
    return F.filter(pairs, lambda p: p["fim"] > p["inicio"])

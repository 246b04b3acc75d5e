"""Text functions on Python strings, for the operators that scan whole documents."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .lexicon import CLASS_MARKS, CONFUSED_AS, DIGIT_OF, INCIDENTS, UNITS

HYPHENS = r"\-‐-―−"
OCR_LETTERS = "".join(sorted(DIGIT_OF))
DIGITISH = rf"[\d{OCR_LETTERS}]"
#: Letters of the alphabets that border a number or a word.
LETTER = "A-Za-zÀ-ÿ"

#: A number in a document may be broken by space; in the base it may not.
NUCLEUS = re.compile(rf"\d(?:[\s.{HYPHENS}/]*\d)*")
TIGHT_NUCLEUS = re.compile(rf"\d(?:[.{HYPHENS}/]*\d)*")

_TOKEN = re.compile(r"[0-9A-Za-z][0-9A-Za-z.\-–—/]*[0-9A-Za-z]|[0-9A-Za-z]")
_UNIT_END = re.compile(rf"\s*[/({HYPHENS}]\s*([A-Za-z]{{1,2}})\s*\)?[\s.]*$")
_GOIAS_END = re.compile(rf"\s*[/({HYPHENS}]\s*(?:G0|6O)\s*\)?[\s.]*$")
_INNER_GROUP = re.compile(rf"(?<=\d[.{HYPHENS}/])({DIGITISH}+)(?=[.{HYPHENS}/]|\s*$|\s+[^\w\s]|\s*[/(])")
_LOOSE_THOUSAND = re.compile(rf"(?<![\w.])([lIi])(?=\.?\s+{DIGITISH}{{3}}[.\s]\s?{DIGITISH}{{3}}\b)")
_REPAIR = str.maketrans(DIGIT_OF)


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@lru_cache(1 << 16)
def text_key(text: str) -> str:
    """Lower case, without accents, white space collapsed."""
    return re.sub(r"\s+", " ", strip_accents(text).lower()).strip()


def count_digits(text: str) -> int:
    return sum(map(str.isdigit, text))


def split_unit(text: str) -> tuple[str, str | None]:
    """The text without a closing federal unit, and that unit. A single letter is a unit cut short."""
    if m := _UNIT_END.search(text):
        unit = m[1].upper()
        return (text[: m.start()].strip(), unit) if len(unit) == 1 or unit in UNITS else (text.strip(), None)
    if m := _GOIAS_END.search(text):
        return text[: m.start()].strip(), "GO"
    return text.strip(), None


def _is_number(token: str) -> bool:
    marks = [c for c in token if c.isalnum()]
    return len(marks) > 1 and any(map(str.isdigit, marks)) and all(c in DIGIT_OF for c in marks if c.isalpha())


_CONFUSED = re.compile(f"[{OCR_LETTERS}]")


def repair_digits(text: str) -> str:
    """Letters that stand for digits become digits; the length stays.

    First whole tokens that are numbers, then letters beside a digit of the
    text as given, then groups between separators until nothing changes.
    """
    if not _CONFUSED.search(text):
        return text
    out = _TOKEN.sub(lambda m: m[0].translate(_REPAIR) if _is_number(m[0]) else m[0], text)
    beside = {i for i, c in enumerate(text) if c in DIGIT_OF and (text[i - 1 : i].isdigit() or text[i + 1 : i + 2].isdigit())}
    if beside:
        out = "".join(c.translate(_REPAIR) if i in beside else c for i, c in enumerate(out))
    for _ in range(8):
        spans = [m.span(1) for p in (_INNER_GROUP, _LOOSE_THOUSAND) for m in p.finditer(out)]
        new = out
        for a, b in spans:
            new = new[:a] + new[a:b].translate(_REPAIR) + new[b:]
        if new == out:
            break
        out = new
    return out


def identifier_digits(text: str) -> str:
    """The digits of the longest number; of equal ones the first."""
    found = NUCLEUS.findall(repair_digits(split_unit(text)[0]))
    best = max(found, key=count_digits, default="")
    return "".join(filter(str.isdigit, best))


def numbers_of(text: str) -> set[str]:
    """All numbers of a text by both readings of space, digits only."""
    return {"".join(filter(str.isdigit, m)) for p in (TIGHT_NUCLEUS, NUCLEUS) for m in p.findall(text)} - {""}


@lru_cache(4096)
def noisy(word: str) -> str:
    """A pattern for a fixed word that recognises the noise of single letters."""

    def letter(c: str) -> str:
        bare = strip_accents(c)
        forms = {c, bare, CONFUSED_AS.get(bare.lower(), c), DIGIT_OF.get(bare) or DIGIT_OF.get(bare.lower(), c)}
        single, double = sorted(f for f in forms if len(f) == 1), sorted(f for f in forms if len(f) > 1)
        one = re.escape(single[0]) if len(single) == 1 else f"[{''.join(single)}]"
        return f"(?:{'|'.join([one, *double])})" if double else one

    return "".join(map(letter, word))


_MARK_START = r"(?:(?<![a-z])|(?<=\bn[oa]s)|(?<=\bn[oa])|(?<=\bd[oa]s)|(?<=\bd[oa]))"
_MARKS = re.compile("|".join(f"(?P<m{i}>{_MARK_START}(?:{p})(?![a-z]))" for i, (p, _) in enumerate(CLASS_MARKS)))


_DIGITS = re.compile(r"\d")


@lru_cache(1 << 14)
def _marks_of(key: str) -> tuple[str, ...]:
    return tuple(sorted({CLASS_MARKS[int(m.lastgroup[1:])][1] for m in _MARKS.finditer(key)}))


def class_marks(text: str) -> list[str]:
    """The marks of the class of proceedings, sorted. Digits are no part of them, so that they are remembered for all numbers."""
    key = _DIGITS.sub("0", text_key(text))
    return list(_marks_of(key) if len(key) <= 200 else _marks_of.__wrapped__(key))


def affinity(cited: set[str], recorded: set[str]) -> int:
    """Marks in common, less the incidents that only one side has."""
    return len(cited & recorded) - len((cited ^ recorded) & INCIDENTS)


def iou(a: tuple[int, int], b: tuple[int, int]) -> float:
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    return both / (a[1] - a[0] + b[1] - b[0] - both) if both else 0.0

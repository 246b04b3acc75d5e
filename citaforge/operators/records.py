"""Precedents and provisions of the base, read from the first line of their records."""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions.lexicon import COURTS
from ..functions.strings import text_key
from .keys import article_key, court_acronym, law_code

# How records introduce themselves.
_MARK = r"(?:n\s*[.º°o]{0,2}\s*)"
_PRECEDENT = re.compile(rf"^\s*S[úu]mula\s+(?P<vinculante>Vinculante\s+)?{_MARK}?(?P<numero>\d+)(?:\s*,?\s*d[oa]\s+(?P<tribunal>[^\n]+))?", re.IGNORECASE)
_ARTICLE = re.compile(
    r"^\s*Art(?:igo|\.)\s*(?P<artigo>\d+(?:\.\d{3})*)\s*[º°o]?\s*(?:[-‐]\s*(?P<sufixo>[A-Z])\b)?(?:\s*,[^\n]*?,)?\s+d[aoe]s?\s+(?P<diploma>[^\n]+)", re.IGNORECASE
)
_LAW = re.compile(rf"(?P<tipo>Lei\s+Complementar|Decreto[-‐\s]*Lei|Lei)\s+{_MARK}?(?P<numero>\d+(?:\.\d{{3}})*)(?:[^\n]*?\b(?P<ano>(?:18|19|20)\d{{2}})\b)?", re.IGNORECASE)
_CHARTER = re.compile(
    r"(?:Constitui[çc][ãa]o\s+(?:Federal|da\s+Rep[úu]blica)|CRFB|CF)\b(?:\s*/\s*(?P<curto>\d{2,4})\b|[^\n]*?\b(?P<ano>(?:18|19|20)\d{2})\b)?", re.IGNORECASE
)
_ACRONYM = re.compile(r"[A-Z]{2,5}\d{0,2}[A-Z]{0,3}")
_COURT_KEYS = {text_key(name): acronym for acronym, name in COURTS.items()}


@lru_cache(1 << 12)
def recorded_court(text: str | None) -> str:
    """The acronym of a court as a record or its column writes it, or empty."""
    name = re.split(r"[,;:()]|\s[-–]\s", text or "", maxsplit=1)[0].strip()
    key = text_key(name)
    full = next((a for k, a in _COURT_KEYS.items() if key.startswith(k)), "")
    return full or next((a for part in ([name, name.split()[0]] if name else []) if _ACRONYM.fullmatch(a := court_acronym(part))), "")


def precedent(text: str, court: str | None) -> dict | None:
    """Court, whether binding, and number of a precedent; None if they can't be read."""
    m = _PRECEDENT.match(text.lstrip("﻿"))
    if not m:
        return None
    found = recorded_court(m["tribunal"]) or recorded_court(court) or ("STF" if m["vinculante"] else "")
    return {"tribunal": found, "vinculante": bool(m["vinculante"]), "numero": int(m["numero"])} if found else None


def _base_year(year: str | None) -> int | None:
    if year is None or len(year) == 4:
        return int(year) if year else None
    return int(year) + (1900 if int(year) > 30 else 2000)


def provision(text: str) -> dict | None:
    """Code, article, and the number and year of the law; only the charter of 1988 is one."""
    m = _ARTICLE.match(text.lstrip("﻿"))
    if not m:
        return None
    article = article_key(m["artigo"], m["sufixo"])
    if c := _CHARTER.match(m["diploma"]):
        return {"codigo": "CF", "artigo": article, "lei": None, "ano": 1988} if _base_year(c["curto"] or c["ano"]) in (None, 1988) else None
    law = _LAW.match(m["diploma"])
    if not law:
        return None
    kind = re.sub(r"[-‐\s]+", " ", law["tipo"].lower())
    kind = "decreto-lei" if kind.startswith("decreto") else kind
    number = law["numero"].replace(".", "")
    return {"codigo": law_code(kind, number), "artigo": article, "lei": number, "ano": int(law["ano"]) if law["ano"] else None}

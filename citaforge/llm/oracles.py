"""DuckDB SQL for the queries that SQL can express over whole tables.

The others have none: suffix windows are bytes (3), models, sampling keys and
fingerprints need hashes that DuckDB lacks (5, 6, 10), tokens a tokenizer (7).
Those are held against brute force in the tests.
"""

from __future__ import annotations

from .chat import END, ESCAPES
from .decontaminate import MIN_ITEMS, WINDOW
from .pii import BASE, CONTEXT, KINDS
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, SYMBOLS

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VALUE = "(instr('0123456789abcdef', substr(h, {}, 1)) - 1)"
_FIVE = " + ".join(f"{16 ** (4 - i)} * {_VALUE.format(f'5 * g + {i + 1}')}" for i in range(5))
_DIGEST = f"list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('{_BASE32}', 1 + ((({_FIVE}) >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '')"

WARC = f"""
select page_id, octet_length(encode(p)) as payload_bytes, {_DIGEST} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to
from (select page_id, p, sha1(p) as h, min(page_id) over (partition by p) as first from (select page_id, coalesce(html, '') as p from pages) x) y
"""

_SAID = "'</s>[INST] ok [/INST]'"
_ESCAPED = "".join(["\\", *ESCAPES])
_LENGTH = "2 * length({0}) - length(translate({0}, '" + _ESCAPED + "', ''))"

CHAT = f"""
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum({_LENGTH.format("role")} + {_LENGTH.format("text")} + {4 + len(END)}) as bigint) as formatted_chars
from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-1, 0, 'user', {_SAID}), (-1, 1, 'assistant', {_SAID})) r
group by conv_id
"""

# The base patterns as their contract states them; kinds beyond it stand between other characters, so they are whole runs.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "[A-Za-z0-9]+",
    "ssn": "[0-9-]+",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: (2 - i % 2) * cast(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) as int) - case when i % 2 = 0 and cast(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) as int) > 4 then 9 else 0 end)) % 10 = 0"
_LETTER_VALUES = "list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)"
_SSN = next(k for k in KINDS if k.name == "ssn")
_NEAR = f"lower(substr(t, greatest(s - {CONTEXT}, 0) + 1, s - greatest(s - {CONTEXT}, 0)) || ' ' || substr(t, e + 1, {CONTEXT}))"
_ACCEPT = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || right(p, 3) as int) > 255)) = 0",
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
    "iban": f"regexp_full_match(m, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') and list_reduce(list_prepend(cast(0 as bigint), {_LETTER_VALUES}), lambda a, v: case when v < 10 then (a * 10 + v) % 97 else (a * 100 + v) % 97 end) = 1",
    "ssn": f"regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') and regexp_matches({_NEAR}, '{_SSN.context}')",
}


def _spans(n: int, kind: str) -> str:
    """Rows (id, kind, number of the kind, start, end): matches placed by the lengths of what lies before."""
    p = _PATTERNS[kind]
    located = f"select id, t, f[i] as m, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as bigint) as s from (select id, t, f, g, unnest(range(1, len(f) + 1)) as i from (select id, t, regexp_extract_all(t, '{p}') as f, string_split_regex(t, '{p}') as g from d) a where len(f) > 0) b"
    if kind in ("iban", "ssn"):  # only texts with such a run, since every word is one
        located = located.replace("from d) a", f"from d where regexp_matches(t, '{'[A-Z]{2}[0-9]{2}[A-Z0-9]{11}' if kind == 'iban' else '[0-9]{3}-[0-9]{2}-[0-9]{4}'}')) a")
    return f"select id, '{kind}' as kind, {n} as k, cast(s as bigint) as s, cast(e as bigint) as e from (select *, s + length(m) as e from ({located}) c) q where {_ACCEPT[kind]}"


_LINE = "kind || ':' || s || ':' || e"
PII = f"""
with d as (select row_number() over () as id, doc_id, coalesce(text, '') as t from documents),
     x as ({" union all ".join(_spans(n, k.name) for n, k in enumerate(KINDS))})
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join (select id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)}, string_agg({_LINE}, ',' order by k, s) filter (k < {len(BASE)}) as base, string_agg({_LINE}, ',' order by k, s) as spans from x group by id) y using (id)
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as w from documents),
     b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
     windows as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as g
                 from (select item, w, least(len(w), {WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from b where len(w) > 0) x),
     grams as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
               from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from windows) s) y),
     hits as (select doc_id, grams.n, i, item from grams join windows using (n, g)),
     covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) z group by doc_id),
     found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= {MIN_ITEMS} as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""

_METRICS = {
    "mean_word_chars": "word_chars / cast(greatest(n_words, 1) as double)",
    "symbol_ratio": "n_symbols / cast(greatest(n_words, 1) as double)",
    "digit_ratio": "n_digits / cast(greatest(word_chars, 1) as double)",
    "stop_words": "stops",
    "dup_line_ratio": "n_dup_lines / cast(greatest(n_lines, 1) as double)",
}
_FAILS = " or ".join(f"{_METRICS[r.metric]} {op} {bound}" for r in RULES for op, bound in (("<", r.low), (">", r.high)) if bound is not None)
_STOPS = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"

QUALITY = rf"""
with t as (select row_number() over () as id, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
     g as (select id, i, count(*) over (partition by id, w[i], w[i + 1], w[i + 2]) as n from (select id, w, unnest(range(1, len(w) - 1)) as i from t) x),
     r as (select id, count(distinct p) as n_repeat_words from (select id, unnest([i, i + 1, i + 2]) as p from g where n > 1) y group by id),
     m as (select doc_id, cast(len(w) as bigint) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
                  length(t) - length(translate(t, '0123456789', '')) as n_digits, cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
                  len(list_filter({_STOPS}, lambda s: list_contains(w, s))) as stops, coalesce(n_repeat_words, 0) as n_repeat_words
           from t left join r using (id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words or {_FAILS}) as kept
from m
"""

ORACLES = {"op1_warc": WARC, "op2_pii": PII, "op4_chat": CHAT, "op8_decontaminate": CONTAMINATION, "op9_quality_rules": QUALITY}

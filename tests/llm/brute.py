"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": len(w) < 50 or 100 * len(hit) > 50 * len(w)}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    n = Counter(x[0] for x in found)
    return {**{f"n_{k}": n[k] for k in ("email", "ip", "card", "phone")}, "base_sha256": sha(",".join(f"{k}:{s}:{e}" for k, s, e in found))}


def chat(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0], x[1] or "", x[2] or ""))]
    learnt = "".join(t for r, t in rows if r == "assistant")
    return {"n_turns": len(rows), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in rows)), "loss_chars": len(learnt), "loss_sha256": sha(learnt)}


def mix_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: source to size. The excess goes round until no source is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, open_w = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        out = {s: fixed.get(s, rest * w[s] / open_w if open_w else 0) for s in names}
        over = [s for s in names if s not in fixed and out[s] > cap * sizes[s]]
        if not over:
            return out
        fixed |= {s: cap * sizes[s] for s in over}


def repeats(docs, length=200):
    """docs: id to bytes. Per id (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = defaultdict(list)
    for d, b in docs.items():
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((d, i))
    cover = {d: bytearray(len(b)) for d, b in docs.items()}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + length] = b"\x01" * length
    return {d: (len(b), sum(c := cover[d]), len(re.findall(b"\x01+", bytes(c))), sha(bytes(x for x, r in zip(b, c) if not r))) for d, b in docs.items()}


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def contamination(docs, items, size=8):
    """docs: id to text; items: id to text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = {}
    grams = defaultdict(set)
    for k, t in items.items():
        w = split(t)
        for g in [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else []):
            grams[g].add(k)
    sizes = {len(g) for g in grams}
    for d, t in docs.items():
        w = split(t)
        hit, got = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    got |= grams[g]
        out[d] = (len(w), len(hit), len(got), sha(",".join(sorted(map(str, got)))), len(got) >= 2)
    return out


def fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(docs, radius=2):
    """docs: id to text. id to (fingerprint, smallest id reachable)."""
    f = {d: fingerprint(t) for d, t in docs.items()}
    up = {d: d for d in f}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(f)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (f"{f[d]:016x}", top(d)) for d in ids}


def later_repeats(docs, length=200):
    """As `repeats`, but the first occurrence of each string stays: in the order of ids, then of places."""
    seen, out = set(), {}
    for d in sorted(docs):
        b, cover = docs[d], bytearray(len(docs[d]))
        for i in range(len(b) - length + 1):
            if (w := b[i : i + length]) in seen:
                cover[i : i + length] = b"\x01" * length
            seen.add(w)
        out[d] = (len(b), sum(cover), len(re.findall(b"\x01+", bytes(cover))), sha(bytes(x for x, r in zip(b, cover) if not r)))
    return out

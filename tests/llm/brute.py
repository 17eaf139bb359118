"""Plain Python forms of the contracts, one document at a time."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

SPACES = "\x20\x09-\x0d"


def library_ids(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], t


def u32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def crc(ids):
    return zlib.crc32(u32(ids))


def words(text):
    return re.findall(f"[^{SPACES}]+", text or "")


def quality(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if grams[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    found = []
    for no, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", " -")), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), no, m.end(), kind))
    found.sort()
    counts = Counter(k for *_, k in found)
    base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return counts["email"], counts["ip"], counts["card"], counts["phone"], hashlib.sha256(base.encode()).hexdigest(), base


def shingles(text):
    text = "" if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_components(docs):
    """docs: (doc_id, text). doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    shared = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def kept_by_quality(docs):
    """docs: (doc_id, text, source). doc_ids that the rules and their host's verdict keep."""
    rows, hosts = {}, {}
    for d, text, source in docs:
        n, chars, symbols, dup, repeat = quality(text)
        lines = sum(1 for x in (text or "").split("\n") if words(x))
        base = n < 50 or 100 * repeat > 50 * n
        more = (symbols > 0.1 * max(n, 1)) + (dup > 0.3 * max(lines, 1)) + (not 3 <= chars / max(n, 1) <= 12)
        rows[d] = base, more, source
        k = hosts.setdefault(source, [0, 0])
        k[0] += 1
        k[1] += base or more > 0
    rates = [f / n for n, f in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    noise = sum(1 / n for n, _ in hosts.values()) / len(hosts)
    strength = max(m * (1 - m) / max(v - m * (1 - m) * noise, 1e-6) - 1, 1.0)
    rate = {h: (f + m * strength) / (n + strength) for h, (n, f) in hosts.items()}
    return {d for d, (base, more, h) in rows.items() if not base and more < (1 if rate[h] >= 0.5 else 2)}


def masked(text, spans):
    """Spans as kind:start:end, replaced by their kinds in order; one that begins inside another goes."""
    out, at = "", 0
    for kind, start, end in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def kneser_ney_ratio(word, toxic, ordinary):
    """Log-likelihood ratio of a word under two six-gram models (gram -> count) over shared continuation counts."""
    orders = [Counter()] * 6
    orders[5] = set(toxic) | set(ordinary)
    for k in range(4, -1, -1):  # how many distinct longer grams end in one of k + 1 characters
        orders[k] = Counter(g[1:] for g in orders[k + 1])

    def share(counts, gram, lower):
        same = [n for g, n in counts.items() if g[:-1] == gram[:-1] and n]
        return (max(counts.get(gram, 0) - 0.75, 0) + 0.75 * len(same) * lower) / sum(same) if same else lower

    total, padded = 0.0, "\x02" * 5 + word + "\x03"
    for i in range(len(padded) - 5):
        gram, p = padded[i : i + 6], 1 / (1 + len(orders[0]))
        for k in range(5):
            p = share(orders[k], gram[5 - k :], p)
        total += math.log(share(toxic, gram, p)) - math.log(share(ordinary, gram, p))
    return total

"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def removed_units(units: list, length: int) -> list[list[bool]]:
    """Per document which units are covered by a window that starts anywhere else too."""
    seen = Counter(tuple(u[i : i + length]) if not isinstance(u, bytes) else u[i : i + length] for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length]) if not isinstance(u, bytes) else u[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def op1(rows, length=35):
    words = [WORD.findall(t or "") for _, t in rows]
    return sorted((i, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for (i, _), w, g in zip(rows, words, removed_units(words, length)))


def op9(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, g in zip(rows, texts, removed_units(texts, length)):
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((i, len(t), sum(g), spans, sha(bytes(b for b, y in zip(t, g) if not y))))
    return sorted(out)


def op5(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = set()
        for k in range(len(w) - 4):
            if grams[tuple(w[k : k + 5])] > 1:
                hit.update(range(k, k + 5))
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed))
    return sorted(out)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def op7(rows):
    out = []
    for i, t in rows:
        t = t or ""
        found = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            found.append((m.start(), 0, "email", m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(x) <= 255 for x in m.group().split(".")):
                found.append((m.start(), 1, "ip", m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, "card", m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
        found.sort()
        n = Counter(f[2] for f in found)
        out.append((i, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))))
    return sorted(out)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op8(rows, bits=2):
    fps = [(i, fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= bits:
                x, y = root(fps[a][0]), root(fps[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, f"{f:016x}", root(i)) for i, f in fps)


def jaccard_groups(rows, least=0.8, width=5):
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)])
    inverted = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            inverted[g].add(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s for j in inverted[g] if j < i}:
            both = len(s & sets[j])
            if both >= least * (len(s) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def folded(text):
    """Letters lower-cased, every run of other ASCII characters one space, no space at the ends."""
    raw = (text or "").encode()
    return re.sub(rb" +", b" ", bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in raw.lower())).strip()


def least_edits(item, text):
    """Least edits that turn the item into any stretch of the text."""
    row = [0] * (len(text) + 1)
    for a in item:
        nxt = [row[0] + 1]
        for j, b in enumerate(text):
            nxt.append(min(row[j] + (a != b), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return min(row)


def op4(rows, items):
    """(doc, item): edits, over all pairs: a tenth of the item's folded bytes as budget, whole words under 8."""
    out = {}
    for i, t in rows:
        text = b" " + folded(t) + b" "
        for k, item in items:
            want = folded(item)
            if len(want) < 8:
                if want and b" " + want + b" " in text:
                    out[i, k] = 0
            elif (n := least_edits(want, text)) <= len(want) // 10:
                out[i, k] = n
    return out

"""Plain versions of the contracts, row by row on the driver, to hold small results against."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(SPACE_WORD, text or "")


def alnum(text):
    return re.findall(ALNUM_WORD, (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_rules(text):
    words = spaced(text)
    lines = Counter()
    repeated_lines = 0
    for line in (text or "").split("\n"):
        if spaced(line):
            repeated_lines += lines[line] > 0
            lines[line] += 1
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    marked = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated_lines, len(marked), failed)


def licenses(text):
    words = alnum(text)
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def substring_dedup(rows, window=20):
    """``rows``: (doc_id, text) in the order of rows that share an id; (doc_id, n_words, n_removed, digest) of each."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    words = [spaced(t) for _, t in rows]
    first = {}
    for r, mine in enumerate(words):
        for i in range(len(mine) - window + 1):
            first.setdefault(tuple(mine[i:i + window]), (r, i))
    out = []
    for r, mine in enumerate(words):
        gone = set()
        for i in range(len(mine) - window + 1):
            if first[tuple(mine[i:i + window])] != (r, i):
                gone |= set(range(i, i + window))
        out.append((rows[r][0], len(mine), len(gone), sha(" ".join(w for i, w in enumerate(mine) if i not in gone))))
    return out


def shingle_components(rows, percent=80):
    """``rows``: (doc_id, text) in order; a (n_shingles, component_id) for each."""
    sets = []
    for _, text in rows:
        words = spaced((text or "").translate(LOWER))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5
                    else {tuple(words)} if words else set())
    holders = defaultdict(list)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, mine in enumerate(sets):
        shared = Counter(j for s in mine for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(mine) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for s in mine:
            holders[s].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), (rows[i][0] if not s else least.get(find(i)))) for i, s in enumerate(sets)]


def contamination(rows, items, window=13):
    index = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            index[tuple(words[i:i + size])].add(item)
    sizes = sorted({len(k) for k in index})
    out = []
    for _, text in rows:
        words = alnum(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = index.get(tuple(words[i:i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        names = sorted(str(i) for i in found if i is not None)
        out.append((len(words), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    text = text or ""
    found = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found["phone"].append(m.span())
    listed = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return (*(len(v) for v in found.values()), sha(listed))


def ranked(rows, items, k=10):
    """``rows``: (doc_id, text); ``items``: (item_id, text); (item_id, rank, doc_id, score), null ids last among equals."""
    counts = [(d, Counter(alnum(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    total = sum(c.total() for _, c in counts)
    frequency = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 10 + (90 * c.total() * len(counts)) // total
            score = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * frequency[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(alnum(text)) if c[t])
            if score:
                found.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return out


def hard_negatives(rows, k=5):
    """``rows``: (vec_id, vector, label)."""
    vectors = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows
               if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda f: (-f[0], f[1] is None, f[1] or 0)
    out = []
    for a, (i, v, y) in enumerate(vectors):
        if i is None or i % 100:
            continue
        scores = [(sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(vectors) if b != a]
        for s, j, _ in sorted((f for f in scores if f[2] == y), key=order)[:k]:
            fits = [f for f in scores if f[2] != y and 80 * s <= 100 * f[0] <= 100 * s]
            out += [(i, j, n + 1, g, s, t) for n, (t, g, _) in enumerate(sorted(fits, key=order)[:k])]
    return out

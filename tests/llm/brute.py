"""Plain Python versions of the corpus operators, over a list of (key, text)."""

import re
from collections import Counter
from itertools import combinations

import regex

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups(n, linked):
    """Least member of each member's component."""
    of = list(range(n))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x
    for a, b in linked:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def prob_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in every) for x in a if x in b)


def near_class(rows):
    """Class of each row: the least position in sorted distinct texts' component."""
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2)
             if bags[i].keys() & bags[j].keys() and prob_jaccard(bags[i], bags[j]) >= 0.8]
    of = dict(zip(texts, groups(len(texts), pairs)))
    return [of[t or ""] for _, t in rows]


def removed_lines(rows):
    """Places of removed lines for each distinct (key, text)."""
    docs = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    seen = {}
    places = []
    for d in docs:
        for at, raw in enumerate(d[2].split("\n")):
            line = raw.strip(SPACE).lower()
            if line:
                places.append((d, at, seen.setdefault(line, len(seen))))
    lines = list(seen)
    sets = [{x[i:i + 7] for i in range(max(1, len(x) - 6))} for x in lines]
    pairs = [(i, j) for i, j in combinations(range(len(lines)), 2)
             if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    of = groups(len(lines), pairs)
    kept, gone = set(), {}
    for d, at, line in places:
        if of[line] in kept:
            gone.setdefault((d[1] if d[0] else None, d[2]), []).append(at)
        kept.add(of[line])
    return gone


def item_words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def leaks(docs, items):
    """{(doc key, item key): (similarity, start)} over all windows."""
    out, first = {}, {}
    for k, t in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0)):
        first.setdefault(tuple(item_words(t)), k)
    for key, text in docs:
        w = item_words(text)
        for iw, item in first.items():
            n, size = len(iw), min(5, len(iw))
            if not n or len(w) < size:
                continue
            ib = Counter(iw[i:i + size] for i in range(n - size + 1))
            for s in range(max(0, len(w) - n) + 1):
                win = w[s:s + n]
                wb = Counter(tuple(win[i:i + size]) for i in range(len(win) - size + 1))
                c = sum((wb & ib).values())
                sim = c / (sum(wb.values()) + sum(ib.values()) - c)
                if sim >= 0.8 and sim > out.get((key, item), (0, 0))[0]:
                    out[key, item] = (sim, s)
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def quality(text):
    text = text or ""
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {p for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def capacity(sizes, shards):
    """Least capacity of a contiguous cut of the sizes into that many shards."""
    for c in range(max(sizes), sum(sizes) + 1):
        used, n = 0, 1
        for s in sizes:
            if used + s > c:
                used, n = 0, n + 1
            used += s
        if n <= shards:
            return c


def host_path(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def url_rule(url, rules):
    host, path = host_path(url)
    fit = [(-len(h + p), h + p, v) for v, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit)[1:] if fit else (None, "allow")

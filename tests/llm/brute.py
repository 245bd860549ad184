"""Plain Python versions of what the operators compute."""

import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    n = min(words, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def near_duplicates(rows, words=2):
    """rows: (id, text) with distinct ids -> {id: (size, component, kept)}."""
    sets = {i: shingles(t, words) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    c = components(ids, links)
    return {i: (len(sets[i]), c[i], c[i] == i) for i in ids}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, n=13):
    """rows: (id, text) -> [(id, n_words, n_hit, item ids)]."""
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        for s in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[s:s + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, hit, got = WORD.findall(lower(text)), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                of = windows.get(tuple(w[s:s + m]))
                if of:
                    hit.update(range(s, s + m))
                    got |= of
        out.append((i, len(w), len(hit), got))
    return out


PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def personal_data(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2:
                x = [int(c) for c in d[::-1]]
                if not 14 <= len(d) <= 19 or (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10:
                    continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def maximal_chats(rows):
    """rows: (conv, turn, role, text) -> {conv: sorted distinct turns} of the maximal ones."""
    chats = defaultdict(set)
    for c, t, r, x in rows:
        chats[c].add((-1 if t is None else t, r or "unknown" if r is None else r, x or ""))
    v = {c: sorted(s) for c, s in chats.items()}
    keep = {}
    for c, a in v.items():
        last = a[-1][0]
        longer = any(len(b) > len(a) and [x for x in b if x[0] <= last] == a for b in v.values())
        same = [d for d, b in v.items() if b == a and d is not None]
        if not longer and (c is None and not same or c is not None and c == min(same)):
            keep[c] = a
    return keep


def lengths_are_packed(rows, size):
    """rows: (sequence, offset, length): gapless from 0 and within ``size``; how many sequences."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def count(rows):
    return Counter(map(tuple, rows))

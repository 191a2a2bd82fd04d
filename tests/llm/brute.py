"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(ids, links):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def ngram_components(docs, n=3, percent=90):
    """doc_id -> (set size, smallest linked id)"""
    sets = {i: shingle_set(t, n) for i, t in docs}
    owners = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            owners[x].add(i)
    pairs = {p for o in owners.values() for p in itertools.combinations(sorted(o), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = components(list(sets), links)
    return {i: (len(s), top[i]) for i, s in sets.items()}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    kinds = [k for _, k, _ in spans]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return kinds.count(0), kinds.count(1), kinds.count(2), sha(joined), joined


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window=13):
    """One tuple per document, in order: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = defaultdict(set)
    for i, text in items:
        w = bench_words(text)
        for at in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[at : at + window])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def chats(rows):
    """conv_id -> n_turns, turns_sha256, loss_chars, loss_sha256 of rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)
    return out


def exact(docs):
    """doc_id -> keep_id, group_size, text_sha256, the largest id staying."""
    by = Counter()
    keep = {}
    for i, t in docs:
        x = (t or "").translate(LOWER)
        by[x] += 1
        keep[x] = max(keep.get(x, i), i)
    return {i: (keep[x], by[x], sha(x)) for i, t in docs for x in [(t or "").translate(LOWER)]}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def repeated_words(docs, size=50):
    """doc_id -> places of the words that lie in a run of ``size`` words that another document has, too."""
    runs = defaultdict(list)
    for i, text in docs:
        words = (text or "").translate(LOWER).split()
        for at in range(len(words) - size + 1):
            runs[tuple(words[at : at + size])].append((i, at))
    out = defaultdict(set)
    for places in runs.values():
        if len({i for i, _ in places}) > 1:
            for i, at in places:
                out[i].update(range(at, at + size))
    return dict(out)


def alike_places(x, y, least):
    """Places of x and of y in stretches of ``least`` or more, equal at both ends, whose sets share 0.8 of their items."""
    mine, others = set(), set()
    equal = [(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if a == b]
    for i, j in equal:
        for k, m in equal:
            if k - i + 1 >= least and m - j + 1 >= least:
                a, b = set(x[i : k + 1]), set(y[j : m + 1])
                if 5 * len(a & b) >= 4 * len(a | b):
                    mine.update(range(i, k + 1))
                    others.update(range(j, m + 1))
    return mine, others

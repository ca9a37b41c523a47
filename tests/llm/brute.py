"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingles(text: str | None, n: int = 5) -> set:
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return set()
    size = min(n, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_duplicates(rows: list[tuple], percent: int, n: int = 5) -> list[tuple]:
    """(id, n_shingles, component, kept) of (id, text) with distinct ids; null ids alone."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[root(i)] = min(least.get(root(i), id_), id_)
    return [(id_, len(s), least.get(root(i)) if id_ is not None else None, id_ is None or least[root(i)] == id_) for i, ((id_, _), s) in enumerate(zip(rows, sets, strict=True))]


def phrase_places(text: str | None, phrases: dict[str, str]) -> dict:
    w = ALNUM.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return {"n_words": len(w), "n_base": len(at), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({label for _, label in at}))}


def removed_repeats(texts: list[str | None], length: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return out


def text_counts(text: str | None) -> tuple:
    t = text or ""
    w = SPACED.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def kept_lines(rows: list[tuple], min_chars: int, min_docs: int) -> list[tuple]:
    """(n_lines, n_dropped, text) of each (id, text)."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    low = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for id_, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low(id_))
    out = []
    for id_, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == low(id_)]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def contamination(text: str | None, items: list[tuple], window: int) -> tuple:
    """(n_words, n_hit, item ids as sorted strings)."""
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for id_, item in items:
        v = ALNUM.findall((item or "").translate(LOWER))
        size = min(window, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add("" if id_ is None else str(id_))
    return len(w), len(hit), sorted(found)


def mix_targets(have: dict, cap: int = 3) -> dict:
    """Source -> target, sources by code point and null last, weights 1, 2, 3, repeating."""
    order = sorted(have, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        rest = sum(have.values()) - sum(cap * have[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > cap * have[s] * (1 + 1e-12)}
        if not over:
            return {s: float(cap * have[s]) if s in capped else weight[s] * level for s in order}
        capped |= over

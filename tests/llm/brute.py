"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def decontamination(text, items: list[tuple], size: int = 10) -> tuple:
    words = PLAIN.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = PLAIN.findall((body or "").translate(LOWER))
        n = min(len(w), size)
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def quality_base(text) -> tuple:
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines}), len(repeated), failed


def fingerprint(text) -> int:
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(rows: list[tuple]) -> dict:
    """{(id, text): (fingerprint, component)} by comparing all fingerprints."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted({*prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low: dict = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            low[find(p)] = min(i, low.get(find(p), i))
    return {(i, t): (f"{p:016x}", low.get(find(p))) for (i, t), p in zip(rows, prints, strict=True)}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def spans(text, rules, by_start: bool) -> tuple:
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    found.sort(key=lambda x: (x[0], x[1]) if by_start else (x[1], x[0]))
    counts = tuple(sum(f[1] == k for f in found) for k in range(len(rules)))
    return counts, [f"{kind}:{s}:{e}" for s, _, e, kind in found]


def sentence_places(text, most: int = 20) -> list[tuple[int, int]]:
    """Character spans of sentences, those of more than ``most`` words cut where a word's hash is least."""
    found, at = [], 0
    text = text or ""
    for m in [*re.finditer(r"(?<=[.!?])[^\S\n]+|\n+", text), None]:
        stop, after = (m.start(), m.end()) if m else (len(text), len(text))
        words = [w.span() for w in re.finditer(r"\S+", text[at:stop])]
        words = [(at + a, at + b) for a, b in words]
        if len(words) <= most:
            cuts = [len(words)]
        else:
            low = [text[a:b].lower() for a, b in words]
            h = [zlib.crc32((low[k - 1] + " " + low[k] if k else " " + low[0]).encode()) for k in range(len(low))]
            cuts, last = [], 0
            for k in range(len(words)):
                around = [h[j] for j in range(k - 4, k + 5) if j != k] if 4 <= k < len(words) - 4 else [0]
                if h[k] < min(around) or k + 1 - last == most:
                    cuts.append(k + 1)
                    last = k + 1
            cuts += [len(words)] if last < len(words) else []
        start = 0
        for c in cuts:
            if c > start:
                found.append((words[start][0], words[c - 1][1]))
            start = c
        at = after
    return found


def repeated_sentences(rows: list[tuple], order: dict, cut_alike: bool) -> dict:
    """{(id, text): numbers of sentences that a later occurrence of any run covers}.  Runs: two sentences
    with 25 words, or three with 12; all up to 15 sentences, as longer ones are made of those.
    ``cut_alike``: the same words must be cut into sentences alike to be the same run."""
    places, gone = defaultdict(list), defaultdict(set)
    for i, t in {*rows}:
        words = [" ".join(t[a:b].lower().split()) for a, b in sentence_places(t)]
        size = [len(w.split()) for w in words]
        for a in range(len(words)):
            for b in range(a + 2, min(len(words), a + 15) + 1):
                n = sum(size[a:b])
                if n >= 25 or (b - a >= 3 and n >= 12):
                    places[" ".join(words[a:b]), tuple(size[a:b]) * cut_alike].append((i is None, i or 0, order[t], a, b, i, t))
    for p in places.values():
        for *_, a, b, i, t in sorted(p, key=lambda x: x[:4])[1:]:
            gone[i, t].update(range(a, b))
    return gone



def pii_spans(text, trees, limits) -> list[str]:
    """All spans by patterns, features, trees and thresholds in plain Python, every pair compared."""
    import regex

    from tamarack.llm import _boosting, pii

    text = text or ""
    base = sorted((k, m.start(), m.end(), kind) for k, (kind, p, ok) in enumerate(PII) for m in re.finditer(p, text, re.ASCII) if ok(m))
    found = []
    for k, (kind, pattern, *_) in enumerate(pii.MORE):
        for m in regex.finditer(pattern, text):
            v, near, after = m[0], text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 1]
            near = regex.sub(pii._SENTENCE, "", near)
            n = sum("0" <= c <= "9" for c in v)
            if kind == "number" and not 6 <= n <= 30:
                continue
            word = lambda p: int(bool(regex.search(p, near)))  # noqa: E731, B023
            has = lambda p, where: int(bool(regex.search(p, where)))
            x = (
                k, min(n, 40), min(len(v) - n, 40), min(len(regex.split("[^0-9]+", v)), 20),
                has(r"^\d{3}-\d{2}-\d{4}$", v), has(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$", v), has(f"^{pii._DATE}$", v),
                word(pii.CALLED), word(pii.NAMED), word(pii.PLACED), word(pii.BORN), word(pii.OTHER),
                int(near[-1:] != "" and near[-1:] in "$#/_=-." or near[-1:].isascii() and near[-1:].isalnum()),
                int(after != "" and after in "%/_$#&*" or after.isascii() and after.isalnum()),
                int(":" in v and any(c in "ABCDEFabcdef" for c in v)), min(sum(has(r"\p{Lu}", c) for c in v), 20),
                has(r"[(\[{]at[)\]}]| dot ", v), has(f"^(?:{pii._TITLES})", v), has("[.][0-9]+[^0-9]", v),
            )
            z = 0.0
            for t in trees:
                z += _boosting.value(t, x)
            if z >= limits[k] and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
                found.append((z, -m.start(), -m.end(), -(len(PII) + k), kind))
    best = [a for a in found if not any(-a[1] < -b[2] and -b[1] < -a[2] and b[:4] > a[:4] for b in found)]
    every = sorted([*base, *((-k, -s, -e, kind) for _, s, e, k, kind in best)])
    return [f"{kind}:{s}:{e}" for _, s, e, kind in every]


def one_of_each_group(rows: list[tuple], least: float = 0.8) -> set:
    """Ids that stay if texts within two bits or at a five-word Jaccard similarity of ``least`` are linked."""
    prints, sets = [], []
    for _, t in rows:
        words = SPACE.findall((t or "").translate(LOWER))
        prints.append(fingerprint(t))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = [*range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            alike = len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0
            if alike or (prints[a] ^ prints[b]).bit_count() <= 2:
                root = [root[a] if r == root[b] else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}

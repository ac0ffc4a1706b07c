"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def contamination(docs, items, size=10):
    patterns = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        for i in range(max(len(words) - size, 0) + 1 if words else 0):
            patterns[tuple(words[i : i + size])].add("" if item is None else str(item))
    lengths = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        words, hit, found = alnum(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in patterns:
                    hit |= set(range(i, i + n))
                    found |= patterns[tuple(words[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def base_counts(text):
    text = text or ""
    words = BLANK.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), failed


def targets(size_of):
    """Targets of sources by their sizes: shares by weight, excess of full ones dealt again until none is above."""
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [None] * (None in size_of)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(size_of.values()), set()
    while True:
        left = total - sum(2 * size_of[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        share = {s: 2 * size_of[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and share[s] > 2 * size_of[s] + 1e-9}
        if not above:
            return share
        full |= above


def repeats(docs, length=100):
    """docs: (key, bytes) in order; merged spans per key."""
    first, out = set(), []
    for key, data in docs:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in first:
                gone[i : i + length] = b"\1" * length
            else:
                first.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def phrases(text, known):
    words, places, labels = alnum(text), [], set()
    for phrase, label in known.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


def templates(text, sets, step, up, down):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    found, best = set(), 0.0
    for _, label, wanted, _ in sets:
        # Others that hold so many of its words that they could be taken for it.
        close = [set(o) for _, name, o, _ in sets if name != label and len(set(o) & set(wanted)) * down >= up * len(wanted)]
        for at in range(0, max(len(words) - step, 1), step):
            block = set(words[at : at + 2 * step])
            share = len(block & set(wanted))
            most = lambda group, block=block: len(block & group) * down >= up * len(group)
            clear = all(most(set(wanted) - o) if set(wanted) - o else not most(o - set(wanted)) for o in close)
            if share * down >= up * len(wanted) and clear:
                found.add(label)
                best = max(best, share / len(wanted))
    return found, best


def line_runs(docs, depth, words=50):
    """docs: (key, text) in order; lines, deleted lines, runs and kept text. Shorter runs count by their words."""
    first, out = set(), []
    for key, text in docs:
        lines, gone = (text or "").split("\n"), set()
        for i in range(len(lines)):
            for size in {1, 2, 4, depth} & set(range(1, min(depth, len(lines) - i) + 1)):
                run = tuple(lines[i : i + size])
                if size == depth or len(BLANK.findall(" ".join(run))) >= words:
                    if run in first:
                        gone |= set(range(i, i + size))
                    first.add(run)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((key, kept, len(lines), len(gone), sum(i - 1 not in gone for i in gone)))
    return out


def fingerprint(text, words=3):
    parts = [w for w in BLANK.findall((text or "").translate(LOWER))]
    grams = [" ".join(parts[i : i + words]) for i in range(max(len(parts) - words, 0) + 1)] if parts else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """prints: doc_id -> fingerprint; the smallest doc_id that each can reach."""
    head = {d: d for d in prints}

    def top(d):
        while head[d] != d:
            d = head[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                head[y] = x
    return {d: top(d) for d in ids}


def word_shingles(text, size):
    words = BLANK.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)} if words else set()


def similarities(shingles):
    """Similarity of all pairs of documents that share a shingle, smaller id first."""
    holders, shared = defaultdict(list), Counter()
    for doc in sorted(shingles):
        for s in shingles[doc]:
            holders[s].append(doc)
    for docs in holders.values():
        shared.update((a, b) for i, a in enumerate(docs) for b in docs[i + 1 :])
    return {(a, b): n / (len(shingles[a]) + len(shingles[b]) - n) for (a, b), n in shared.items()}

"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def cut_windows(docs, width):
    """(n_words, n_removed, kept) by id; docs are (id, text)."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        lost = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                lost[i : i + width] = [True] * width
        out[d] = (len(w), sum(lost), " ".join(x for x, gone in zip(w, lost) if not gone))
    return out


def cut_bytes(docs, width):
    """(n_bytes, n_removed, n_spans, kept) by id."""
    bodies = {d: (t or "").encode() for d, t in docs}
    first = {}
    for d in sorted(bodies):
        for i in range(len(bodies[d]) - width + 1):
            first.setdefault(bodies[d][i : i + width], d)
    out = {}
    for d, b in bodies.items():
        lost = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                lost[i : i + width] = b"\1" * width
        out[d] = (len(b), sum(lost), len(re.findall(b"\1+", bytes(lost))), bytes(c for c, gone in zip(b, lost) if not gone))
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(ids, linked):
    """The smallest id reachable from each id."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near(docs, percent=75):
    """(n_shingles, class) by id."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    label = classes(ids, links)
    return {d: (len(sets[d]), label[d]) for d in ids}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def mixed_copies(docs, weights=(3, 1, 2), share=1.5, cap=2.0, seed=17):
    """doc_id -> copies, for (doc_id, text, source); targets by filling: sources that overflow stop, the rest share again."""
    import hashlib
    import math
    import re

    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    names = sorted({s for _, _, s in docs if s is not None}) + ([None] if any(s is None for _, _, s in docs) else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(size[d] for d, _, own in docs if own == s) for s in names}
    target, open_ = {}, list(names)
    left = share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > cap * total[s]]
        for s in full or open_:
            target[s] = cap * total[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    copies = {}
    for d, _, s in docs:
        rate = target[s] / total[s] if total[s] else 0.0
        drawn = int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:13], 16) / 2**52
        copies[d] = math.floor(rate) + (drawn < rate - math.floor(rate))
    return copies

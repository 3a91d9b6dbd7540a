"""Plain definitions that the operators are held against; for small tables only."""

import math
import re
import zlib


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """doc_id -> smallest doc_id reachable, over all pairs."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if w]


def windows(items, width=10):
    out = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    return out


def contaminated(text, found):
    w = words(text)
    sizes = {len(x) for x in found}
    return any(tuple(w[i : i + n]) in found for n in sizes for i in range(len(w) - n + 1))


def suffix_tree(texts, depth, penalty):
    """Next-byte probabilities by plain dictionaries: p(context, byte) from the longest retained suffix."""
    counts = {}
    for t in texts:
        data = b"\n" * depth + t
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts.setdefault(data[i - d : i], {}).setdefault(data[i], 0)
                counts[data[i - d : i]][data[i]] += 1
    root = counts.get(b"", {})
    whole = sum(root.values())
    kept = {b""}

    def p(context, byte):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return (root.get(byte, 0) + 0.5) / (whole + 128)
        n = counts[context]
        return (n.get(byte, 0) + len(n) * p(context[1:], byte)) / (sum(n.values()) + len(n))

    for context in sorted(counts, key=len):
        if context:
            n = counts[context]
            total = sum(n.values())
            if sum(k * math.log2(k / total / p(context[1:], b)) for b, k in n.items()) >= penalty * len(n):
                kept.add(context)
    return p


def tree_score(p, text, depth):
    data = b"\n" * depth + text
    return sum(math.log10(p(data[i - depth : i], data[i])) for i in range(depth, len(data)))

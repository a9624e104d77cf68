"""Brute-force models of the corpus operators."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = words(lower(text))
    n = min(width, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def near_duplicates(pairs, width, percent):
    """doc_id -> (set size, smallest linked doc_id)."""
    sets = {i: shingles(t, width) for i, t in pairs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i in sorted(sets):
        for g in sets[i]:
            inverted[g].append(i)
    both = collections.Counter((a, b) for ids in inverted.values() for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def substrings(pairs, window=20):
    """doc_id -> (words, removed words, sha256 of the kept words)."""
    first, out = set(), {}
    for i, t in sorted(pairs):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in first:
                gone[p : p + window] = [True] * window
            first.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def largest_sum(sizes, counts, budget):
    """The largest sum of sizes not above budget, by the uncapped table of reachable sums."""
    reach = 1
    for size, n in zip(sizes, counts, strict=True):
        for _ in range(n):
            reach |= reach << size
    return (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


def targets(sizes, weights, cap=3):
    """Words of each source: shares by weight, none above cap x size, the excess shared again."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * unit > cap * sizes[i]}
        for i in over or free:
            out[i] = float(cap * sizes[i]) if over else weights[i] * unit
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(docs):
    """doc_id, leaf, subroot, root, proof digest, folded root and verdict of rows (doc_id, text, lang, source, n_chars), by whole trees."""
    import zlib

    net = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: sha("".join(map(net, (d[0], d[3], d[2], d[4], text))))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])

        def siblings(i):
            out = []
            for x in levels[:-1]:
                run = x[i // 8 * 8 : i // 8 * 8 + 8]
                out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
                i //= 8
            return out

        return levels[-1][0], siblings

    groups = collections.defaultdict(list)
    for d in docs:
        groups[d[2]].append((d[0] is not None, d[0] or 0, leaf(d, d[1]), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
    trees = {g: tree([x[2] for x in groups[g]]) for g in order}
    root, top = tree([trees[g][0] for g in order]) if order else (None, None)
    out = []
    for k, g in enumerate(order):
        for i, (known, _, own, d) in enumerate(groups[g]):
            path = trees[g][1](i) + top(k)
            changed = known and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[1] is not None
            h = leaf(d, re.sub("[A-Z]", lambda m: m[0].lower(), d[1])) if changed else own
            for left, right in path:
                h = sha(left + h + right)
            out.append((d[0], own, trees[g][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def clusters(vectors, k=16, rounds=3):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid digest of (vec_id, vector), comparing all pairs."""
    import math

    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((sha(f"1:{'' if i is None else i}"), v, v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        centres = [[sum(x) // len(of[n]) for x in zip(*of[n], strict=True)] if of[n] else c for n, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, n in found:
        inertia[n] += d
    return [(i, n, d, inertia[n], sum(inertia.values()), sha(",".join(map(str, centres[n])))) for i, d, n in found]


def chats(rows):
    """conv_id -> turns, digest of the turns, characters and digest of the assistant's texts, of (conv_id, turn, role, text)."""
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{role}\n{t}\n" for *_, role, t in turns)), len(loss), sha(loss))
    return out

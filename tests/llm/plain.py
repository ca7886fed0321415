"""Plain versions of operators, to hold the real ones against."""

import re
from collections import Counter


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def jaccard_components(rows, percent=75):
    """Sorted (id, set size, smallest id linked) of (id, text) rows, by comparing all pairs with anything in common."""
    sets = [shingles(text) for _, text in rows]
    holders, parent = {}, list(range(len(rows)))
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in holders[x]).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[root(j)] = root(k)
    smallest = {}
    for k, (key, _) in enumerate(rows):
        smallest[root(k)] = min(smallest.get(root(k), key), key)
    return sorted((key, len(sets[k]), smallest[root(k)]) for k, (key, _) in enumerate(rows))

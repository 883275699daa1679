"""Plain versions of the operators, for small inputs."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def lettered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(text, items, window=10):
    """Words, indices of hit words and ids of the items with an occurring window."""
    own, hit, found = lettered(text), set(), set()
    for item, body in items:
        w = lettered(body)
        k = min(window, len(w))
        if item is None or not k:
            continue
        for j in range(len(w) - k + 1):
            for i in range(len(own) - k + 1):
                if own[i : i + k] == w[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(own), hit, found


def shingle_set(text, size):
    w = spaced(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def classes(docs, size, percent=80):
    """Smallest linked id of each of ``docs`` (id -> text)."""
    sets = {i: shingle_set(t, size) for i, t in docs.items()}
    head = {i: i for i in docs}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: find(i) for i in docs}


def covered(texts, length):
    """Removed byte positions of texts that come in order."""
    seen, out = set(), []
    for text in texts:
        data, hit = (text or "").encode(), set()
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                hit.update(range(p, p + length))
            seen.add(w)
        out.append(hit)
    return out


def span_list(hit):
    out = []
    for p in sorted(hit):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]

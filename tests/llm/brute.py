"""Plain Python versions of the operators, for small inputs."""

import hashlib
from collections import Counter


def cover(n, starts, k):
    gone = [False] * n
    for a in starts:
        gone[a : a + k] = [True] * k
    return gone


def substring_dedup(rows, k):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[a : a + k]) for _, w in docs for a in range(len(w) - k + 1))
    out = []
    for i, w in docs:
        gone = cover(len(w), [a for a in range(len(w) - k + 1) if seen[tuple(w[a : a + k])] > 1], k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def suffix_dedup(rows, k):
    """rows: (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(w[a : a + k]) for _, w in docs for a in range(len(w) - k + 1))
    out = []
    for i, w in docs:
        gone = cover(len(w), [a for a in range(len(w) - k + 1) if seen[hash(w[a : a + k])] > 1], k)
        kept = bytes(x for x, g in zip(w, gone, strict=True) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(w), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality(rows, max_rate=0.5):
    """rows: (doc_id, source, text) -> the rows of the quality query, without kept."""
    import re

    out = []
    for i, _, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        gone = cover(len(words), [j for j in range(len(words) - 2) if seen[tuple(words[j : j + 3])] > 1], 3)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(gone), len(words) < 50 or 100 * sum(gone) > 50 * len(words)))
    return out


def licenses(rows):
    """rows: (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels."""
    import re

    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    out = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(j, k) for k, p in phrases.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        at = [j for j, _ in hits]
        out.append((i, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))))
    return out


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def near_classes(rows, similarity=0.8, unit="words"):
    """rows: (doc_id, text) -> {doc_id: class}; the edit similarity of words or of 5-word shingles, comparing all pairs of texts."""
    import re

    texts, first, sets = {}, {}, {}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def link(i, j):
        i, j = sorted((find(i), find(j)))
        parent[j] = i

    for i, t in sorted(rows):
        if t is None:
            continue
        if t in first:
            link(first[t], i)
            continue
        first[t] = i
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        if unit == "shingles":
            w = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
        texts[i], sets[i] = w, Counter(w)
    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = texts[i], texts[j]
            n = max(len(a), len(b))
            if min(len(a), len(b)) >= similarity * n > 0 and sum((sets[i] & sets[j]).values()) >= similarity * n and distance(a, b) <= (1 - similarity) * n + 1e-9:
                link(i, j)
    return {i: find(i) for i in parent}


def toxic_scores(rows, penalty, smooth, certainty, sizes=(3, 4, 5, 6)):
    """rows: (text, label or None) -> the score of each; strings as features, plain gradient descent to the optimum."""
    import math

    held = []
    for t, _ in rows:
        t = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in f" {t} ".lower())
        held.append({t[i : i + n] for n in sizes for i in range(len(t) - n + 1)})
    ys = [y for _, y in rows]
    total = Counter(ys)
    count = {y: Counter(g for h, label in zip(held, ys, strict=True) if label == y for g in h) for y in (0, 1)}
    names, ratio = sorted(count[0] | count[1]), {}
    for g in names:
        c0, c1, n0, n1 = count[0][g] + smooth, count[1][g] + smooth, total[0] + 2 * smooth, total[1] + 2 * smooth
        r = math.log(c1 / n1) - math.log(c0 / n0)
        ratio[g] = math.copysign(max(0.0, abs(r) - certainty * math.sqrt(1 / c1 + 1 / c0 - 1 / n1 - 1 / n0)), r)
    known = [([g for g in h if ratio.get(g)], y) for h, y in zip(held, ys, strict=True) if y is not None]
    w, b, n = dict.fromkeys(names, 0.0), 0.0, total[0] + total[1]
    step = 1 / (0.25 * (max(sum(ratio[g] ** 2 for g in h) for h, _ in known) + 1) + penalty)
    for _ in range(8000):
        errors = [1 / (1 + math.exp(-b - sum(w[g] * ratio[g] for g in h))) - y for h, y in known]
        slope = {g: penalty * w[g] for g in names}
        for e, (h, _) in zip(errors, known, strict=True):
            for g in h:
                slope[g] += e * ratio[g] / n
        for g in names:
            w[g] -= step * slope[g]
        b -= step * sum(errors) / n
    return [1 / (1 + math.exp(-b - sum(w[g] * ratio[g] for g in h if g in ratio))) for h in held]


def license_labels(text, index, least, slack):
    """(labels of the method, best score) by laying every template at every place."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = {}
    names = index.vocabulary
    for label, template, keys, places in zip(index.labels, index.texts, index.keys, index.places, strict=True):
        laid = [names[w] for w in template]
        for at in range(-len(laid), len(words)):
            score = sum(0 <= at + q < len(words) and words[at + q] == w for q, w in enumerate(laid)) / len(laid)
            if score < least or score <= found.get(label, 0):
                continue
            whole = True
            for phrase, q in zip(keys, places, strict=True):
                around = range(at - slack, at + len(laid) + slack) if q is None else range(at + q - slack, at + q + slack + 1)
                whole &= any(p >= 0 and words[p : p + len(phrase)] == [names[w] for w in phrase] for p in around)
            if whole:
                found[label] = score
    return found


def spelling(rows):
    """rows: (doc_id, text) -> sorted (word, form, root, n, n_near, form_n)."""
    import re
    import zlib

    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def ranked(docs, items, k=20):
    """docs: (doc_id, text); items: (item_id, text) -> (item_id, rank, doc_id, score), rows of equal id and score in any order."""
    import math
    import re

    cut = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    many, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, b, n in bags:
            m = 75 + (25 * n * many) // total
            s = sum(c * weight[t] * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in Counter(cut(text)).items() if t in b)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return out

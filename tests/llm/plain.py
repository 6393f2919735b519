"""Plain single-machine versions of the operators, to test against."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=3):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def lowest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    out = {}
    for i in range(n):
        out.setdefault(root(i), []).append(i)
    return out.values()


def near_duplicates(rows, num=90, den=100):
    """(doc_id, set size, component) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    by_word = {}
    for i, s in enumerate(sets):
        for x in s:
            by_word.setdefault(x, []).append(i)
    common = Counter()
    for ids in by_word.values():
        for i in range(len(ids)):
            for j in range(i):
                common[ids[j], ids[i]] += 1
    links = [p for p, c in common.items() if den * c >= num * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    component = {}
    for g in groups(len(rows), links):
        low = lowest([rows[i][0] for i in g])
        for i in g:
            component[i] = low
    return sorted(((d, len(sets[i]), component[i]) for i, (d, _) in enumerate(rows)), key=str)


def repeats(rows, length=400):
    """(doc_id, bytes, removed, spans, sha256 of the rest) of rows (doc_id, text)."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] > gone[:-1]).sum()) + int(gone[0])
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), spans, sha256(left).hexdigest()))
    return sorted(out, key=str)


def vector_links(rows, cosine=0.95):
    """(vec_id, links, component) of rows (vec_id, vector or None)."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, i in enumerate(good):
        for j in good[:a]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((i, j))
    count = Counter(i for link in links for i in link)
    component = {}
    for g in groups(len(rows), links):
        low = lowest([rows[i][0] for i in g])
        for i in g:
            component[i] = low
    return sorted(((v, count[i], component[i]) for i, (v, _) in enumerate(rows)), key=str)


def backoff_scores(rows, backoff=0.4):
    """(doc_id, words, backed off, log score) with bigrams, own words not counted."""
    docs = [words(t) for _, t in rows]
    one = Counter(w for d in docs for w in d)
    two = Counter(p for d in docs for p in zip(d, d[1:]))
    total = sum(one.values())
    out = []
    for (d, _), ws in zip(rows, docs):
        own1, own2 = Counter(ws), Counter(zip(ws, ws[1:]))
        score, off = 0.0, 0
        for i, w in enumerate(ws):
            alone = (one[w] - own1[w] + 1) / (total - len(ws) + 1)
            if i == 0:
                score += np.log(alone)
                continue
            p = (ws[i - 1], w)
            c, h = two[p] - own2[p], one[p[0]] - own1[p[0]]
            if c > 0 and h > 0:
                score += np.log(c / h)
            else:
                score += np.log(backoff) + np.log(alone)
                off += 1
        out.append((d, len(ws), off, round(float(score), 6)))
    return sorted(out, key=str)


def spelling_variants(rows, noise=31, shortest=7, least=2, ratio=10):
    """(word, form, root, n, near words, n of the form) of rows (doc_id, text)."""
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= least}
    masked, shorter, near = {}, {}, {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            masked.setdefault(w[:i] + "\0" + w[i + 1 :], set()).add(w)
            shorter.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    for w, longer in shorter.items():
        if w in n:
            near[w] |= longer
            for x in longer:
                near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def phrase_scores(rows, longest=5, least=100, top=2000, inside=100):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang)."""
    count, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    count.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in often.items():
            if 100 * longer[p] >= inside * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        for rank, (score, a, phrase, left, right) in enumerate(found[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=str)

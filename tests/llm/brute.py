"""Plain single-machine versions of the operators, for comparison on small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, percent=85):
    """{id: (n_shingles, component)} of [(id, text)] by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def dedup_lines(docs, min_sites):
    """{id: text} of [(id, text, site)] with unique ids."""
    sites, first = collections.defaultdict(set), {}
    for i, t, s in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for at, line in enumerate((t or "").split("\n")):
            sites[line].add(s)
            first.setdefault(line, (i, at))
    cut = {line for line, s in sites.items() if len(s) >= min_sites and WORD.search(line)}
    return {i: None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if x not in cut or first[x] == (i, at)) for i, t, _ in docs}


def remove_repeats(docs, length=100):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} of [(id, text)] with unique ids."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            if x in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(x)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, lines = words(text), [x for x in (text or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def histograms(text, lang, common):
    """Character classes and common words."""
    chars = collections.Counter()
    for c in "".join(words(text)):
        if re.match(r"[a-zß-öø-ÿ]", c):
            chars[0] += 1
        elif c.isupper():
            chars[1] += 1
        elif re.match(r"[0-9]", c):
            chars[2] += 1
        elif c in ".,;:!?'\"()-":
            chars[3] += 1
        elif c in "#*$%&|<>":
            chars[4] += 1
        else:
            chars[5] += 1
    listed = common[lang if lang in common else "en"].split()
    hits = collections.Counter(words(text))
    hist = [hits[w] for w in listed]
    return [chars[i] for i in range(6)], hist + [len(words(text)) - sum(hist)]


def js(p, q):
    p, q = ([x / sum(h) if sum(h) else 0.0 for x in h] for h in (p, q))
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(0.5 * part(x, (x + y) / 2) + 0.5 * part(y, (x + y) / 2) for x, y in zip(p, q))))


def quality(docs, rules):
    """{id: (counts, base_failed, kept)} of [(id, text, lang)] with the bounds of the module ``rules``."""
    common = rules.COMMON_WORDS
    hists = {i: histograms(t, g, common) for i, t, g in docs}
    ref = collections.defaultdict(lambda: [None, None])

    def add(name, kind, h):
        ref[name][kind] = h if ref[name][kind] is None else [a + b for a, b in zip(ref[name][kind], h)]

    for i, _, g in docs:
        known = g in common
        add("", 0, hists[i][0])
        if known:
            add(g, 0, hists[i][0])
            add(g, 1, hists[i][1])
        if not known or g == "en":
            add("", 1, hists[i][1])
    out = {}
    for i, t, g in docs:
        c = counts(t)
        base = c[0] < 10 or 100 * c[4] > 20 * c[0]
        d = [js(h, r) for h, r in zip(hists[i], ref[g if g in common else ""])]
        far = c[1] >= rules.MIN_CHARS and d[0] > rules.MAX_CHAR_DISTANCE or c[0] >= rules.MIN_WORDS and d[1] > rules.MAX_WORD_DISTANCE
        out[i] = (c, base, not base and not far)
    return out


def least_edits(item, text):
    """Fewest edits between the whole item and any piece of the text, by the full table."""
    t = np.array([ord(c) for c in text], dtype=np.int64)
    steps = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, dtype=np.int64)
    for i, c in enumerate(item, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
    return int(row.min())


def contaminated(docs, items, q, rate):
    """{(id, item)} within the edit budget."""
    found = set()
    for item_id, item in items:
        item = item.lower()
        k = min(math.floor(rate * len(item) + 1e-9), (len(item) - q) // q)
        for i, t in docs:
            low = (t or "").lower()
            if k >= 0 and (item in low or least_edits(item, low) <= k):
                found.add((i, item_id))
    return found


def check_packing(rows, ids_of, capacity=2048):
    """Whether the pieces hold every id of every document once, gapless in documents and in sequences. Returns the padding share.

    ``rows``: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); ``ids_of``: {doc_id: ids as bytes}.
    """
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per_doc[r[0]].append(r)
        per_sequence[r[5]].append(r)
    assert set(per_doc) == set(ids_of)
    for doc, pieces in per_doc.items():
        at, total = 0, len(ids_of[doc]) // 4
        for _, start, length, crc, tokens, _, _ in sorted(pieces, key=lambda r: r[1]):
            assert start == at and length > 0 and tokens == total
            assert crc == zlib.crc32(ids_of[doc][4 * start:4 * (start + length)])
            at += length
        assert at == total
    used = padded = 0
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= capacity
        used += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / max(1, used + padded)

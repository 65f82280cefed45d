"""Plain Python versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def jaccard_components(docs):
    """{doc_id: (n, component)} of (doc_id, text) pairs with different doc_ids, all pairs compared."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, d in enumerate(ids):
        for e in ids[:i]:
            common = len(sets[d] & sets[e])
            if common and 100 * common >= 75 * (len(sets[d]) + len(sets[e]) - common):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in ids}


def cut_passages(docs, gear, cut_bits, cut_shift, min_words, max_words=64, warm=32):
    """{doc_id: text} of (doc_id, text) in ascending order, repeated runs of chunks cut out; one byte at a time."""
    seen, out = set(), {}
    for d, text in docs:
        raw, h, hashes, chunks = (text or "").encode(), 0, [], []
        for byte in raw:
            h = ((h << 1) + int(gear[byte])) & 0xFFFFFFFF
            hashes.append(h)
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
            a, b = m.span()
            if not chunks or (a >= warm and (hashes[a - 1] >> cut_shift) & ((1 << cut_bits) - 1) == 0) or len(chunks[-1]) == max_words:
                chunks.append([])
            chunks[-1].append((a, b))
        flags = []
        for c in chunks:
            body = raw[c[0][0] : c[-1][1]]
            flags.append(body in seen)
            seen.add(body)
        borders = [c[0][0] for c in chunks] + [len(raw)]
        kept, i = raw[: borders[0]], 0
        while i < len(chunks):
            j = i
            while j < len(chunks) and flags[j] == flags[i]:
                j += 1
            if not (flags[i] and sum(map(len, chunks[i:j])) >= min_words):
                kept += raw[borders[i] : borders[j]]
            i = j
        out[d] = kept.decode()
    return out

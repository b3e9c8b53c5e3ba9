"""Plain versions of the operators for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, width):
    w = words((text or "").translate(_LOW))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(sets, percent=80):
    """Smallest reachable key of each key."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def suffix_dedup(rows, n=100):
    """rows: (doc_id, text) -> doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(raw[p : p + n])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def edit_inside(pattern, text):
    """Least edit distance of pattern to any part of text, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def line_blocks(rows):
    """rows: (doc_id, text) -> doc_id: text without runs of two or more lines that repeat, two by two, earlier ones and have a word."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone = [False] * len(lines)
        for i, pair in enumerate(zip(lines, lines[1:])):
            if pair in seen:
                gone[i] = gone[i + 1] = True
            seen.add(pair)
        kept, i = [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and gone[j] == gone[i]:
                j += 1
            if not gone[i] or not WORD.search(" ".join(lines[i:j])):
                kept += lines[i:j]
            i = j
        out[doc] = "\n".join(kept)
    return out


def without_frequent_lines(rows, most):
    """rows: (doc_id, text, host) -> each one's text without lines that more than most documents of its host have, as the same words in any case."""
    norm = lambda x: " ".join(words(x.translate(_LOW)))
    docs = {}
    for doc, text, host in rows:
        for line in (text or "").split("\n"):
            docs.setdefault((host, norm(line)), set()).add(doc)
    gone = {k for k, d in docs.items() if k[1] and len(d) > most}
    return [None if text is None else "\n".join(x for x in text.split("\n") if (host, norm(x)) not in gone) for _, text, host in rows]


def paragraph_units(text, least=8):
    """(begin, stop, words) of each line with a word, and of each sentence with the next ones of its line up to least words, in bytes."""
    out, at = set(), 0
    for line in (text or "").encode().split(b"\n"):
        found = [(at + m.start(), at + m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", line)]
        at += len(line) + 1
        ends = [k + 1 for k, x in enumerate(found) if x[2][-1:] in (b".", b"!", b"?") or k + 1 == len(found)]
        ranges = [(0, len(found))] if found else []
        for a in [0, *ends[:-1]] if found else []:
            ranges += [(a, b) for b in ends if b - a >= least][:1]
        out |= {(found[a][0], found[b - 1][1], tuple(x[2].lower() for x in found[a:b])) for a, b in ranges}
    return sorted(out)


def paragraphs(rows, percent=80, width=5):
    """rows: (doc_id, text) -> doc_id: removed byte ranges, merged; all pairs of different lines are compared."""
    every = [(i, *u) for i, t in sorted(rows, key=lambda r: r[0]) for u in paragraph_units(t)]
    lines = sorted({tuple(x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", y)) for _, t in rows for y in (t or "").encode().split(b"\n")} - {()})
    near = components({k: {w[j : j + width] for j in range(max(1, len(w) - width + 1))} for k, w in enumerate(lines)}, percent)
    comp = {w: lines[near[k]] for k, w in enumerate(lines)}
    comp = {w: comp.get(w, w) for _, _, _, w in every}
    of = {}
    for i, a, b, w in every:
        of.setdefault(comp[w], []).append((i, a, b))
    spans = {i: [] for i, _ in rows}
    for group in of.values():
        for i, a, b in group:
            if any(j < i or (j == i and y <= a) for j, _, y in group):
                spans[i].append((a, b))
    return {i: merged(x) for i, x in spans.items()}


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out

"""Plain versions of the operators, for small tables."""

import itertools
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def repeated(seqs, length, first=False):
    """Covered positions of each sequence."""
    seen = Counter()
    for s in seqs:
        for i in range(len(s) - length + 1):
            seen[s[i:i + length]] += 1
    old, out = set(), []
    for s in seqs:
        hit = set()
        for i in range(len(s) - length + 1):
            w = s[i:i + length]
            if (w in old) if first else seen[w] > 1:
                hit.update(range(i, i + length))
            old.add(w)
        out.append(hit)
    return out


def op6(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), b, hit in zip(rows, texts, repeated(texts, length)):
        spans = sum(1 for i in hit if i - 1 not in hit)
        out.append((d, len(b), len(hit), spans, sha(bytes(c for i, c in enumerate(b) if i not in hit))))
    return out


def op8(rows, length=35):
    seqs = [tuple(WORD.findall(t or "")) for _, t in rows]
    return [(d, len(s), len(hit), sha(" ".join(w for i, w in enumerate(s) if i not in hit)))
            for (d, _), s, hit in zip(rows, seqs, repeated(seqs, length))]


def shingle_counts(text, width=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1))))


def jaccard(a, b):
    lo, hi = sum((a & b).values()), sum((a | b).values())
    return lo / hi if hi else 0.0


def merged(n, links):
    """The least member of each one's group."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in links:
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def classes(texts, threshold=0.8):
    s = [shingle_counts(t) for t in texts]
    return merged(len(s), ((i, j) for i in range(len(s)) for j in range(i) if jaccard(s[i], s[j]) >= threshold))


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def quotes(rows):
    """(conv, turn, role, own text, n_quoted, n_linked, reply_to, thread, depth, position) of
    distinct messages: every unit of every earlier message is compared by its text."""
    norm = lambda x: " ".join(x.replace("\u00a0", " ").split()).lower()
    texty = lambda x: any(c.isalnum() for c in x)

    def split(text):
        for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            level, bare = 0, line
            while bare.lstrip(" \t").startswith(">"):
                level, bare = level + 1, bare.lstrip(" \t")[1:]
            bare = bare[1:] if level and bare[:1] in (" ", "\t") else bare
            said = line.lstrip(" \t>").lower().startswith("on ") and line.rstrip(" \t").lower().endswith(" wrote:")
            yield level, bare, said

    def stretches(lines):
        for key, group in itertools.groupby(lines, key=lambda x: x[::2]):
            if not key[1]:
                yield key[0], [x[1] for x in group]

    def paragraphs(part):
        out, blank = [[]], False
        for line in part:
            if blank and norm(line):
                out.append([])
            out[-1].append(line)
            blank = not norm(line)
        return out

    msgs = {m: list(split(m[3] or "")) for m in dict.fromkeys(rows)}
    units, singles = {}, {}
    for m, lines in msgs.items():
        own = [part for level, part in stretches(lines) if level == 0]
        several = [sum(own, []), *own, *(p for part in own for p in paragraphs(part))]
        units[m] = {norm(" ".join(x)) for x in several}
        singles[m] = {norm(x) for part in own for x in part}
    quoted, up = {}, {}
    for m, lines in msgs.items():
        def holder(where, text):
            have = [o for o in msgs if o[0] == m[0] and o[1] < m[1] and text in where[o]]
            return max(have, key=lambda o: o[1]) if texty(text) and have else None
        n = hits = 0
        votes = Counter()
        for level, part in stretches(lines):
            if level == 0:
                continue
            n += len(part)
            whole = holder(units, norm(" ".join(part)))
            for p in paragraphs(part):
                para = holder(units, norm(" ".join(p)))
                for line in p:
                    o = (whole or para or holder(singles, norm(line))) if texty(line) else None
                    hits += o is not None
                    if o and level == 1:
                        votes[o] += 1
        quoted[m] = n, hits
        up[m] = max(votes, key=lambda o: (votes[o], o[1])) if votes else None
    answers = {}
    for m in sorted(msgs, key=lambda m: m[1]):
        answers.setdefault(up[m], []).append(m)
    out = []

    def read(m, root, depth, place):
        lines = msgs[m]
        own = "\n".join(x for level, x, said in lines if level == 0 and not said).strip(" ") if any(x[0] for x in lines) else m[3] or ""
        out.append((*m[:3], own, *quoted[m], up[m][1] if up[m] else None, root[1], depth, place))
        for x in answers.get(m, []):
            place = read(x, root, depth + 1, place + 1)
        return place
    for m in answers.get(None, []):
        read(m, m, 0, 0)
    return out

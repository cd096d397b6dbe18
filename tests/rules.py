"""The operators' rules in plain Python, one file or pair at a time: what the Spark plans are held against."""

import re

IGNORED = ".,!?;:'\""


def jtrim(s):
    return s.strip("".join(map(chr, range(33))))


def words(s):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", s) if w]


def pieces(s):
    """Split at white space; a leading empty piece stays, trailing ones go; "" is one piece."""
    if s == "":
        return [""]
    found = re.split(r"[ \t\n\x0b\f\r]+", s)
    while found and found[-1] == "":
        found.pop()
    return found


def trimmed_count(s):
    return max(1, len(pieces(jtrim(s))))


def norm(w):
    return jtrim("".join(c for c in w.lower() if c not in IGNORED))


def longest(a, b, least=3):
    """(length, end in a, start in b) by trying all starts in order and keeping the first longest."""
    a, b = [norm(w) for w in a], [norm(w) for w in b]
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i + n, j)
    return best if best[0] >= least else (0, 0, 0)


def merge(prev, cur):
    """(branch, kept segments in absolute times); a chunk is (start, end, [(start, end, text)])."""
    rebased = [(cur[0] + s, cur[0] + e, t) for s, e, t in cur[2]]
    if not prev[2]:
        return "prev_empty", rebased
    if not cur[2]:
        return "cur_empty", []
    region = [s for s in prev[2] if s[0] >= cur[0] - prev[0]]
    if not region:
        return "no_overlap", rebased
    n, _, at = longest([w for s in region for w in words(s[2])], [w for s in cur[2] for w in words(s[2])])
    if n < 3:
        cut = prev[0] + prev[2][-1][1]
        return "timestamp", [s for s in rebased if s[0] >= cut]
    kept, before = [], 0
    for s in rebased:
        if before >= at + n:
            kept.append(s)
        before += trimmed_count(s[2])
    return "match", kept


def fold(chunks):
    out = [(chunks[0][0] + s, chunks[0][0] + e, t) for s, e, t in chunks[0][2]]
    for prev, cur in zip(chunks, chunks[1:]):
        out = [s for s in out if s[0] < prev[1]] + merge(prev, cur)[1]
    return out


def jaccard(a, b):
    x, y = pieces(a.lower()), pieces(b.lower())
    common = sum(w in y for w in x)
    union = len(x) + len(y) - common
    return common / union if union > 0 else 0.0


def legacy(chunks):
    kept, last = [], 0.0
    for start, _, segs in chunks:
        for s, e, t in segs:
            a, b = start + s, start + e
            if a < last and any(abs(a - x) < 1 and abs(b - y) < 1 and jaccard(u, t) >= 0.7 for x, y, u in kept[-10:]):
                continue
            kept.append((a, b, t))
            last = max(last, b)
    return kept

"""Plain versions of the corpus operators, one document at a time."""

import hashlib
import re
import zlib
from collections import Counter

SPACE = r"[^\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
    cards = [(m, re.sub("[^0-9]", "", m.group())) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    return out + [("phone", *m.span()) for m in phones if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def secrets(text):
    text = text or ""
    assign = re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
    out = [(m.start(), 0, m.end()) for m in assign if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items):
    """doc number to (n_words, n_hit, item ids as strings)."""
    windows = {}
    for item, text in items:
        w = re.findall(WORD, lowered(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    found = []
    for _, text in docs:
        w = re.findall(WORD, lowered(text))
        hit, items_hit = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items_hit |= windows[k]
        found.append((len(w), len(hit), sorted(str(x) for x in items_hit if x is not None)))
    return found


def dedup(docs):
    """[(n_words, n_removed, sha of what is kept)] of documents (doc_id or None, text)."""
    last = 1 << 62
    split = [(last if d is None else d, re.findall(SPACE, t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text):
    w = re.findall(WORD, (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a or b else 0.0


def near_classes(docs):
    """Smallest index of each document's class, by all pairs of five-word shingles at 0.8; texts without words match the same text only."""
    s = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same = similarity(s[i], s[j]) >= 0.8 if s[i] or s[j] else docs[i][1] is not None and docs[i][1] == docs[j][1]
            if same:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(docs))]


def mix_targets(sizes):
    """source to target from [(source, size)]."""
    own = Counter()
    for s, n in sizes:
        own[s] += n
    order = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + [None] * (None in own)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed, free = 1.5 * sum(own.values()), {}, set(order)
    while free:
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 2 * own[s]]
        if not over:
            fixed |= {s: rest * weight[s] / w for s in free}
            break
        fixed |= {s: 2.0 * own[s] for s in over}
        free -= set(over)
    return fixed


def crc(text):
    return zlib.crc32(text.encode())


def segmentations(word, pieces):
    """All ways to cut a marked word into pieces or single letters that no piece has."""
    if not word:
        yield []
        return
    for j in range(1, len(word) + 1):
        if word[:j] in pieces or j == 1:
            for rest in segmentations(word[j:], pieces):
                yield [word[:j], *rest]


def products(word, p, floor):
    for cut in segmentations(word, p):
        x = 1.0
        for piece in cut:
            x *= p.get(piece, floor)
        yield x


def unigrams(counts, pieces, rounds, all_words, floor):
    """Piece probabilities of one language by expectation maximisation, starting from all places where a piece fits; ``all_words``: those of all languages."""

    def normalised(c):
        seen = {x for x in pieces if c.get(x, 0) > 0}
        smooth = {x: c.get(x, 0) + 0.05 * (x in seen or x in fits) for x in pieces}
        total = sum(smooth.values())
        return {x: max(smooth[x] / total, floor) for x in pieces}

    fits = {x for w in all_words for x in pieces if x in "▁" + w}
    start = {}
    for w, n in counts.items():
        for x in pieces:
            start[x] = start.get(x, 0) + n * sum(("▁" + w)[i : i + len(x)] == x for i in range(len(w) + 1))
    p = normalised(start)
    for _ in range(rounds):
        expected = dict.fromkeys(pieces, 0.0)
        for w, n in counts.items():
            cuts = list(segmentations("▁" + w, set(pieces)))
            weights = list(products("▁" + w, p, floor))
            for cut, x in zip(cuts, weights):
                for piece in cut:
                    if piece in expected:
                        expected[piece] += n * x / sum(weights)
        p = normalised(expected)
    return p

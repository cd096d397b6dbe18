"""Labelled texts with spans that lie outside the base patterns of the operators."""

import random

SYLLABLES = ["ba", "ko", "ri", "tu", "ne", "sa", "lo", "mi", "gu", "pe"]


def word(rng, most=3):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, most)))


def sentence(rng, *inner):
    parts = [word(rng) for _ in range(rng.randint(3, 9))]
    parts[rng.randrange(len(parts)) : 0] = inner
    return " ".join(parts) + "."


def luhn_card(rng):
    body = [rng.randint(0, 9) for _ in range(15)]
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(body))
    return "".join(map(str, body)) + str(-total % 10)


def personal_data(seed):
    """(documents, spans): base spans in two thirds of the documents; in the others personal data without the marks of the base kinds, which are the
    spans (doc_id, start, end) returned, and numbers and sentences that are none."""
    rng = random.Random(seed)
    n = rng.randint

    def phone():
        return f"{n(200, 999)}) 555-{n(1000, 9999)}"

    base = [
        lambda: f"{word(rng)}.{word(rng)}{n(1, 99)}@{word(rng)}.{rng.choice(['com', 'org', 'co.uk'])}",
        lambda: f"{word(rng)}@{word(rng)}.com",
        lambda: f"+1 ({phone()}",
        lambda: f"+{n(1, 9)}{n(1, 9)} {n(200, 999)} 555 {n(1000, 9999)}",
        lambda: f"+1 {n(200, 999)}-555-{n(1000, 9999)}",
        lambda: f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(1, 255)}",
        lambda: luhn_card(rng),
    ]
    planted = [
        lambda: f"{word(rng)} at {word(rng)} dot com",
        lambda: f"{word(rng)}.{word(rng)} (at) {word(rng)}.org",
        lambda: f"{word(rng)}{n(1, 99)} [at] {word(rng)} [dot] com",
        lambda: f"{n(200, 999)}-555-{n(1000, 9999)}",
        lambda: f"{n(200, 999)} 555 {n(1000, 9999)}",
        lambda: f"1 ({phone()}",
    ]
    others = [
        lambda: f"{n(10**6, 10**9)}",
        lambda: f"{n(10**15, 10**16 - 1)}",
        lambda: f"20{n(10, 24)}-{n(1, 12):02d}-{n(1, 28):02d}",
        lambda: f"{n(1, 28):02d}.{n(1, 12):02d}.20{n(10, 24)}",
        lambda: f"{n(1, 99)}.{n(100, 999)}.{n(100, 999)}",
        lambda: f"{n(256, 999)}.{n(256, 999)}.{n(0, 99)}.{n(0, 99)}",
        lambda: f"{word(rng)} at {word(rng)}. {word(rng).title()}",
    ]
    docs, spans = [], set()
    for i in range(1800):
        kinds = base if i % 3 else planted if i % 6 else others
        if i % 3 and i % 5 == 0:
            kinds = others
        inner = rng.choice(kinds)()
        text = sentence(rng, inner)
        docs.append((i, text))
        if kinds is planted:
            spans.add((i, text.index(inner), text.index(inner) + len(inner)))
    return docs, spans


def secret_tokens(seed):
    """(documents, spans): random keys without a telling name, few of each length, which are the spans (doc_id, start, end) returned, among long words, names and numbers."""
    rng = random.Random(seed)
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key():
        alphabet, length = rng.choice([(every, 22), (every, 30), (every, 40), (every, 64), ("0123456789ABCDEF", 32), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), ("0123456789abcdefghijklmnopqrstuvwxyz", 25)])
        return "".join(rng.choice(alphabet) for _ in range(length))

    def long_word():
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(8, 20)))

    others = [long_word, lambda: long_word().title(), lambda: f"{long_word()}_{word(rng)}", lambda: f"{long_word()}-{rng.randint(1, 2030)}", lambda: "-".join(word(rng) for _ in range(8)), lambda: f"20{rng.randint(10, 24)}-01-02-{word(rng)}-{word(rng)}-report"]
    docs, spans = [], set()
    for i in range(1200):
        inner = key() if i % 12 == 0 else rng.choice(others)()
        text = sentence(rng, inner)
        docs.append((i, text))
        if i % 12 == 0:
            spans.add((i, text.index(inner), text.index(inner) + len(inner)))
    return docs, spans

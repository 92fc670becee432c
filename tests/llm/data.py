"""Small documents with the awkward cases: nulls, empties, repeats, copies, long texts."""

from __future__ import annotations

import random

SYLLABLES = "an be ti on wh re st en le ou é ü ñ 字 ha th er in".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, extra)"""
    rng = random.Random(seed)
    passage = words(rng, 40)
    texts: list[str | None] = [None, "", " \n\t ", "a", "one two", "12 34", "x" * 49, "x" * 50, "y" * 300]
    while len(texts) < n:
        k = rng.random()
        if k < 0.25 and len(texts) > 12:
            texts.append(texts[rng.randint(9, len(texts) - 1)])
        elif k < 0.5 and len(texts) > 12:
            old = (texts[rng.randint(9, len(texts) - 1)] or "a b").split(" ")
            old[rng.randrange(len(old))] = words(rng, 1)
            texts.append(" ".join(old))
        elif k < 0.65:
            texts.append(words(rng, rng.randint(0, 30)) + " " + passage + " " + words(rng, 10))
        else:
            texts.append(words(rng, rng.choice([1, 5, 30, 200])))
    texts.append(words(rng, 4000))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t, rng.choice(["en", "fr", None]), f"src{i % 3}", None if t is None else len(t), "z") for i, t in zip(ids, texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_extra string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"

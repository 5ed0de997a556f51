"""Small tables with every awkward case, and plain helpers to recompute results."""

import random
import re

#: doc_id, text, and columns whose names the operators use themselves
SCHEMA = "doc_id bigint, text string, score string, n_words string, ids string, `set` string, key string, hits string, component_id string"
WORDS = [a + b for a in "ka lo mi ne ru so ta vi".split() for b in "ba do fe gi ho ju".split()]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    rnd, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS).upper()
    return " ".join(words)


def awkward() -> list[tuple]:
    long = prose(1, 20_000)
    texts = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "One"),
        (6, "two words"),
        (7, prose(7, 60)),
        (8, prose(7, 60)),
        (8, prose(7, 60)),
        (9, edited(prose(7, 60), 9, 1)),
        (10, prose(10, 5)),
        (11, prose(10, 6)),
        (12, long),
        (13, edited(long, 13, 3)),
        (14, "x" * 50_000),
        (15, "é▁\x00 \n\n" * 5 + "mail a.b7@mail.example.com and 4934796579598836"),
        (None, prose(7, 60)),
        (None, None),
        (None, "nameless"),
    ]
    return [(i, t, "s", None, "x", "set", "k", "h", "c") for i, t in texts]


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(nodes, links):
    """The smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}

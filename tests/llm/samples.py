"""Texts for the tests."""

import random


def prose(seed, n, words=400):
    r = random.Random(seed)
    names = ["".join(r.choice(("ba", "ne", "ti", "ro", "sul", "mer", "on")) for _ in range(r.randint(1, 3))) for _ in range(words)]
    return " ".join(r.choice(names) for _ in range(n))

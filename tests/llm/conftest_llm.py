"""Texts for the tests of this folder."""

import random


def words(rng, n, pool=300):
    return " ".join(rng.choice(("w", "x")) + str(rng.randrange(pool)) for _ in range(n))


def texts_with_repeats(seed, n=60):
    """Random texts, copies, near copies, shared passages, periodic and odd ones."""
    rng = random.Random(seed)
    passage, line = words(rng, 60), words(rng, 9)
    out = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and out:
            text = rng.choice(out) or ""
        elif kind == 1 and out:
            parts = (rng.choice(out) or "").split(" ")
            if len(parts) > 3:
                parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif kind == 2:
            text = words(rng, rng.randrange(40)) + " " + passage + "\n" + words(rng, rng.randrange(40))
        elif kind == 3:
            text = "to " * rng.randrange(1, 200)
        elif kind == 4:
            text = words(rng, rng.randrange(60)) + " " + line + " Ünïcode ß\t " + words(rng, 20)
        else:
            text = words(rng, rng.randrange(200))
        out.append(text)
    return [*out, None, "", "   \n", "a", words(rng, 3000), passage]

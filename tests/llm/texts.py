"""Small invented corpora with copies, near copies, shared passages and odd rows."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "ra", "se", "ti", "vo") for b in ("", "n", "ra", "sti", "mel", "dor", "pi", "gu")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            t = rng.choice(out)[1] or ""
        elif out and kind < 0.45:
            w = (rng.choice(out)[1] or "").split()
            for _ in range(max(1, len(w) // 40)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
            t = " ".join(w)
        elif kind < 0.6:
            t = sentence(rng, rng.randrange(20)) + "\n" + passage + " " + sentence(rng, rng.randrange(20))
        else:
            t = sentence(rng, rng.choice([1, 3, 5, 14, 40, 120]))
        out.append((i * 3 + 1, t))
    out += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "solo"), (1004, "Solo"), (1005, sentence(rng, 4000)), (1005, "twice under one id"), (1006, out[5][1]), (1006, out[5][1])]
    rng.shuffle(out)
    return out

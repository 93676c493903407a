"""Brute-force versions of the operators on documents, for small fixtures."""

import hashlib
import random
import re


def sha(x):
    return hashlib.sha256(x).hexdigest()


def repeats(docs, items, window):
    """For each (doc_id, items) the flags of items covered by a window that also starts in a smaller doc_id."""
    seen = {}
    for d, xs in sorted(((d, items(t)) for d, t in docs if d is not None), key=lambda r: r[0]):
        for i in range(len(xs) - window + 1):
            w = tuple(xs[i : i + window])
            seen[w] = min(seen.get(w, d), d)
    for d, t in docs:
        xs = items(t)
        gone = [False] * len(xs)
        if d is not None:
            for i in range(len(xs) - window + 1):
                if seen[tuple(xs[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
        yield d, xs, gone


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def corpus(rng, n, unit=" ", size=200, vocabulary=400):
    """Texts with exact and near copies, passages at random places, nulls and blanks."""
    vocab = ["".join(rng.choice("abcdefghijéü") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [say(rng.randint(45, 120)) for _ in range(6)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.3 and texts:
            own = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
        elif kind < 0.6:
            own = say(rng.randint(0, size))
            for _ in range(rng.randint(1, 3)):
                p = rng.choice(passages)
                a = rng.randint(0, 20)
                cut = p[a : len(p) - rng.randint(0, 20)]
                at = rng.randint(0, len(own))
                own[at:at] = cut
            texts.append(rng.choice([" ", " ", "\n"]).join(own))
        elif kind < 0.65:
            texts.append(rng.choice([None, "", " \t", "a", rng.choice(vocab) * 300, " ".join([rng.choice(vocab)] * 300)]))
        else:
            texts.append(" ".join(say(rng.randint(0, size))))
    return texts


def rows(seed, n, **kind):
    rng = random.Random(seed)
    texts = corpus(rng, n, **kind)
    ids = rng.sample(range(10 * n), n)
    out = [*zip(ids, texts)]
    return out + [(None, texts[0]), (None, texts[0]), (ids[1], texts[2]), (ids[1], texts[2])]

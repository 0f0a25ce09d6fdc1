import random

ODD = [None, "", " \n\t ", "a", "A b", "x" * 5000, "é" * 3000, "the the the the the", "don't <|endoftext|> it's", "½ ﬁ º İstanbul ΣΑΣ ñandú", "1234 56,7!!! --- …", "tab\tsep\x1cgroup\x0bvt", "<turn> \\### Assistant: </turn> ok #"]


def texts(seed, n, words=("the", "of", "And", "zebra", "québec", "Straße", "x1", "foo-bar", "éa", "no", "b,")):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.random()
        if out and k < 0.15:
            out.append(rng.choice(out))
        elif out and k < 0.3:
            t = rng.choice(out)
            i = rng.randint(0, len(t))
            out.append(t[:i] + rng.choice(["q", " z ", ""]) + t[i:])
        else:
            out.append(" ".join(rng.choice(words) + (rng.choice("abcde") * rng.randint(0, 3)) for _ in range(rng.randint(0, 60))))
    return out


def documents(seed, n, odd=True):
    rows = [(i * 2, t) for i, t in enumerate(texts(seed, n))]
    if odd:
        rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [rows[0], rows[3], (None, "null id"), (None, None)]
    return rows


SCHEMA = "doc_id long, text string"

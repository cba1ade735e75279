import random

from kinfold.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], max(row[j], row[j - 1], prev + 1 if x == y else 0)
    return row[-1]


def slow_ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def slow_partial(a, b):
    if not a or not b:
        return 0.0
    def best(x, y):
        n = len(x)
        return max(slow_ratio(x, y[max(0, i) : i + n]) for i in range(1 - n, len(y)))
    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(*sorted((a, b), key=len))


def strings(rnd):
    out = []
    for _ in range(150):
        a = "".join(rnd.choice("abcd é") for _ in range(rnd.choice([0, 1, 3, 8, 30, 63, 64, 65, 70])))
        b = "".join(c for c in a if rnd.random() < 0.8) + rnd.choice(["", "ab", "dd dd"]) if rnd.random() < 0.6 else "".join(rnd.choice("abxyz ") for _ in range(rnd.randrange(40)))
        out.append((a, b))
    return out


def test_ratios_against_brute_force():
    pairs = strings(random.Random(3))
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for (x, y), r, p in zip(pairs, S.ratios(a, b), S.partial_ratios(a, b), strict=True):
        assert abs(r - slow_ratio(x, y)) < 1e-12 and abs(S.ratio(x, y) - r) < 1e-12
        assert abs(p - slow_partial(x, y)) < 1e-12 and abs(S.partial_ratio(x, y) - p) < 1e-12


def test_token_sort():
    assert S.token_sort_ratio("b a", "a  b") == 1.0 and S.token_sort_ratio("", "a") == 0.0

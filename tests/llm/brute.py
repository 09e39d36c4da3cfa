"""Plain single-machine versions of the operators, and odd rows that all of them meet."""

import math
import re
from collections import Counter
from itertools import combinations


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# The extra columns have names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, own array<long>, n long, ids string"


def words(text, fold=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if fold else text or "")


def table(spark, pairs):
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, [1], 3, "x") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    base = [f"w{i}" for i in range(60)]
    near = base.copy()
    near[30] = "other"
    return [
        (1, " ".join(base)),
        (2, "  ".join(base).upper()),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "One\ttwo"),
        (9, "lead in " + " ".join(base[5:40]) + " way out"),
        (10, "la " * 300),
        (11, "la " * 310),
        (12, " ".join(base)),
        (12, " ".join(base)),
        (13, " ".join(f"v{i}" for i in range(4000))),
        (14, "äöü ß “x” don't 's  12abc\n\n日本 <|endoftext|> end x"),
        (15, "a b c d e"),
        (16, "a b c d e f"),
    ]


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def ngram_set(text, n=5):
    w = words(text, True)
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_classes(pairs, percent=80):
    sets = {}
    for i, t in pairs:
        sets.setdefault(i, ngram_set(t))
    linked = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(sets, linked)
    return sorted((i, len(ngram_set(t)), root[i]) for i, t in pairs)


def kept_words(pairs, window=13):
    first = {}
    for i, t in pairs:
        w = words(t)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in pairs:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def backoff_scores(pairs, order=3, factor=0.4):
    texts = [words(t, True) for _, t in pairs]
    grams = lambda w, n: [tuple(w[j - n + 1 : j + 1]) for j in range(n - 1, len(w))]
    count = [Counter(g for w in texts for g in grams(w, n)) for n in range(1, order + 1)]
    total = sum(map(len, texts))
    out = []
    for w in texts:
        own, score = [Counter(grams(w, n)) for n in range(1, order + 1)], 0.0
        for j in range(len(w)):
            for n in range(order, 0, -1):
                g = tuple(w[j - n + 1 : j + 1]) if j >= n - 1 else None
                if g and (c := count[n - 1][g] - own[n - 1][g]) > 0:
                    base = count[n - 2][g[:-1]] - own[n - 2][g[:-1]] if n > 1 else total - len(w)
                    score += math.log(c / base) + (order - n) * math.log(factor)
                    break
            else:
                score += math.log(1 / (total - len(w) + 1)) + order * math.log(factor)
        out.append((len(w), score))
    return out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, x) for x in r))


VECTORS = "vec_id long, embedding array<float>, label int, node long, cell string"

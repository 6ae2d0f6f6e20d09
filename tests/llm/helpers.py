"""Small tables with nulls, blanks, ties, repeats, long texts and clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(vocabulary)) for _ in range(n))


def edited(text, k, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(k):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus():
    """Texts with groups of exact and near copies, shared passages and odd rows."""
    base = [prose(120, s) for s in range(6)]
    passage = prose(70, 99)
    texts = [*base]
    texts += [base[0]] * 9 + [base[0].upper()] * 2
    texts += [edited(base[1], k, 10 + k) for k in (1, 1, 2, 3, 5, 8, 13)]
    texts += [edited(edited(base[2], 3, 40), 3, s) for s in range(41, 49)]
    texts += [prose(30, 60 + s) + " " + passage + " " + prose(20, 80 + s) for s in range(7)]
    texts += [None, "", "   \n\t ", "one", "one", "two words", "two words here", "word " * 300, "a b a b " * 80, prose(6000, 7), prose(6000, 7) + " end", "x\x1cy\x85z", "naïve café " * 40, "ß" * 500]
    return texts


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

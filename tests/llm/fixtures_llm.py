import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    """A documents table with these texts; null columns here and there."""
    rows = [(k if ids is None else ids[k], t, "en" if k % 3 else None, f"s{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed, words=("the", "of", "and", "zu", "être", "ñandú", "thing", "onlyly", "Hahath", "er", "in", "st", "re", "on", "ed")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "", "ly", "ing", "ed", "tion", ",", ".", "\n"]) + r.choice(["", "", str(r.randrange(300))]) for _ in range(n))

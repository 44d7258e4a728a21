"""Small tables for the operators on training data."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "er", "ing", "tion", "and", "wh", "or"], "de": ["sch", "ung", "keit", "ü", "ver", "ein"]}


def sentence(rng, lang="en", words=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def prose(rng, lang="en", lines=4, words=12):
    return "\n".join(sentence(rng, lang, words) for _ in range(lines))


def odd_texts():
    """NULL, empty, blank, without letters, very long, one endless word, line feeds only."""
    return [None, "", " \t\n ", "12 34 ### 5", "word " * 60_000, "x" * 5_000, "\n\n\n", "a", "naïve café № ½ 𝐀 ﬁ b"]


def documents(spark, rows):
    full = [(i, text, lang, "src0", None if text is None else len(text)) for i, text, lang in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def rng(seed=7):
    return random.Random(seed)

"""Small inputs shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def documents(spark, texts, ids=None, lang="en", source="a"):
    """A documents table of these texts; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n_words, vocabulary=400):
    """Invented words; equal seeds give equal texts."""
    r = random.Random(seed)
    pool = ["".join(random.Random(f"w{k}").choices("abcdefghilmnoprstu", k=3 + k % 6)) for k in range(vocabulary)]
    return " ".join(r.choice(pool) for _ in range(n_words))


#: NULL, empty, blank, very long, repeated and odd texts; ids with NULLs and repeats.
ODD_TEXTS = [None, "", " \n\t ", "one", "One two\nthree", "x" * 50_000, prose(1, 30_000), prose(2, 40), prose(2, 40),
             "é ß 日本 🎉 'll don't  two  spaces\r\nend ", "twin", "twin", "nul\x00byte", "... !!! ???"]
ODD_IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11, None, None]


def odd_documents(spark):
    return documents(spark, ODD_TEXTS, ODD_IDS)


def rows(df, *columns):
    """Rows as sorted tuples; None sorts first."""
    columns = columns or df.columns
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [(x is not None, str(x)) for x in r])

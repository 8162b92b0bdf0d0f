"""Small tables with the cases that every operator has to handle."""

import zlib

import public_tokenizers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    """Documents 0, 1, ... with the given texts."""
    data = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCUMENTS)


def hard_texts():
    """Null, empty, white space, odd characters, a very long text, repeats."""
    return [None, "", " \n\t ", "a", "A b", "word " * 40_000, "é字 \U0001f600 ß", "1 2 3", "same text here", "same text here"]


def clashing(df):
    """Extra columns with names that operators use inside."""
    names = ["row", "raw", "value", "text_key", "n", "key", "score", "_id", "_key", "_n", "slot", "rank", "size", "vector", "ids", "decoded", "_row", "share"]
    have = set(df.columns)
    for name in names:
        if name not in have:
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def crc(i) -> int:
    return zlib.crc32(("" if i is None else str(i)).encode())


def rows(df, *columns):
    got = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in got.collect()), key=repr)

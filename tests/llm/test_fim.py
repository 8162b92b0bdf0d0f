import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, documents, hard_texts
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from irregts.llm import fim
from irregts.llm.common import BATCH_BYTES

TOKENS = re.compile("[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, unit="word", keep=90, spm=20):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = TOKENS.findall(text) if unit == "word" else list(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= keep:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(9)
    alphabet = list("abYZ@[`{ \n\r\t<>PSM19") + ["é", "ß", "字", " ", "\U0001f600", "é", "\x00"]
    odd = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(200)]
    return [*odd, "has <P> inside", "<M>", "<S", "<P", "é" * 5000, "a" * 5000, *hard_texts()]


@pytest.mark.parametrize("unit", ["word", "char"])
def test_equals_brute_force(spark, unit):
    given_texts = texts()
    got = fim.transform(clashing(documents(spark, given_texts)), fim.Recipe(unit=unit)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [brute(i, t, unit) for i, t in enumerate(given_texts)]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_digests_rebuild_every_text(spark):
    given_texts = texts()
    got = fim.digests(fim.transform(documents(spark, given_texts))).orderBy("doc_id").collect()
    for row, text in zip(got, given_texts):
        assert row["restored_sha256"] == sha(text or "")
        assert row["output_sha256"] == sha(brute(row["doc_id"], text)[-1])


def test_recipe_decides_shares_and_forms(spark):
    df = documents(spark, ["some words here"] * 200)
    assert {r["form"] for r in fim.transform(df, fim.Recipe(cut=0)).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(df, fim.Recipe(cut=100, spm=0)).collect()} == {"psm"}
    assert {r["form"] for r in fim.transform(df, fim.Recipe(cut=100, spm=100)).collect()} == {"spm"}
    with pytest.raises(ValueError, match="unit"):
        fim.transform(df, fim.Recipe(unit="line"))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d")] * 3 + [(7, "a b c d")] * 2, "doc_id long, text string")
    got = sorted(map(tuple, fim.transform(df, fim.Recipe(cut=100)).collect()), key=repr)
    assert got == sorted([brute(None, "a b c d", keep=100)] * 3 + [brute(7, "a b c d", keep=100)] * 2, key=repr)


def test_bytes_that_are_not_utf8(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("cast(x'61FF62C3' as string)").alias("text"))
    got = fim.digests(fim.transform(df)).collect()
    assert {r["restored_sha256"] for r in got} == {sha("a�b�")}


@given(st.text(max_size=40))
def test_index_converts_both_ways(text):
    raw = text.encode()
    index = fim.Exceptions(np.frombuffer(raw, np.uint8))
    chars = np.arange(len(text) + 1)
    ends = np.array([len(text[:k].encode()) for k in chars])
    assert index.n_chars == len(text) and len(index.chars) == sum(ord(c) > 127 for c in text)
    assert index.to_bytes(chars).tolist() == ends.tolist() and index.to_chars(ends).tolist() == chars.tolist()


def test_batches_are_cut_by_bytes(spark):
    df = documents(spark, ["long " * 200_000] * 40).coalesce(1)
    fim.bounded_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    found = [r["size"] for r in df.select("text").mapInArrow(sizes, "size long").collect()]
    assert len(found) > 3 and max(found) <= 2 * BATCH_BYTES


def test_empty_table(spark):
    assert fim.digests(fim.transform(documents(spark, ["a"]).limit(0))).count() == 0

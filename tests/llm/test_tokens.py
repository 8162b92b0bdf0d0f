import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import VOCABULARY, clashing, documents, hard_texts
from tokenizers import Tokenizer

from irregts.llm import bpe, pieces
from irregts.llm import tokenfiles as tf

LETTERS = [
    "a", "b", "the", "ing", " ", " ", " ", "\n", "\t", "'s", "'", "é", "1", ".", "\x1c", " ", "字", "\U0001f600",
    "́", "\x85", "ß", "\x01", "<|endoftext|>", "aaaa", "zzz", "　",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def odd_texts(n=400):
    rng = random.Random(1)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(n)] + hard_texts()


def expected(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_digests_equal_the_library(spark, library):
    texts = odd_texts()
    df = clashing(documents(spark, texts)).withColumnRenamed("text_key", "Raw_")
    got = bpe.digests(bpe.encode(df, VOCABULARY, decoded=True)).orderBy("doc_id").collect()
    for r, ids in zip(got, expected(library, texts), strict=True):
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_decoding_is_a_step_of_its_own(spark):
    texts = odd_texts(50)
    tokens = bpe.encode(documents(spark, texts), VOCABULARY)
    assert "text" not in tokens.columns
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(tokens, VOCABULARY).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(documents(spark, texts).limit(0), VOCABULARY).count() == 0


def test_small_slices_and_a_small_memory_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 7)
    codec, texts = bpe.BpeCodec(VOCABULARY), [t or "" for t in odd_texts()]
    codec.encoder.keep = 40
    for _ in range(2):
        for i in range(0, len(texts), 30):
            part = texts[i : i + 30]
            ids, counts = codec.encoder.texts(pa.array([t.encode() for t in part], pa.binary()))
            want = expected(library, part)
            assert counts.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]


def test_texts_that_must_stay_whole_come_first(library):
    texts = ["a\tb", "", "x   y", "<|endoftext|>"]
    ids, counts = bpe.BpeCodec(VOCABULARY).encoder.texts(pa.array([t.encode() for t in texts], pa.binary()))
    want = expected(library, texts)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_pair_index_merges_runs_from_the_left(library):
    words = [c * n for c in ("a", "=", "-", "z") for n in range(1, 20)]
    ids, counts = bpe.PairIndex(bpe.codec(VOCABULARY).vocabulary, [w.encode() for w in words]).encode()
    want = expected(library, words)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def read(spark, df, path):
    tf.write_token_files(df, VOCABULARY, path)
    return tf.read_documents(spark, path)


def test_token_files_hold_all_documents_in_order(spark, library, tmp_path, monkeypatch):
    texts = odd_texts()
    df = clashing(documents(spark, texts).repartition(7))
    path = str(tmp_path / "files")
    got = read(spark, df, path).orderBy("doc_id").collect()
    start = 0
    for i, (r, ids) in enumerate(zip(got, expected(library, texts), strict=True)):
        whole = np.array([*ids, 0], "<u4")
        assert tuple(r) == (i, start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
    for i in (0, 3, 5, 77):
        (row,) = tf.read_ids(spark, path, i).collect()
        assert row["ids"] == [*expected(library, [texts[i]])[0], 0]


def test_repeated_and_null_ids_and_an_empty_table(spark, library, tmp_path):
    data = [(None, "first"), (2, "b"), (2, "b"), (2, "a"), (1, None), (None, "first")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = read(spark, df, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 2, 2]
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    assert read(spark, df.limit(0), str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("symbols", [1 << 16, 1 << 31])
def test_grammar_round_trip_and_random_access(symbols):
    rng = np.random.default_rng(4)
    phrase = rng.integers(0, 300, 40)
    docs = [np.concatenate([phrase[: rng.integers(1, 40)] for _ in range(rng.integers(1, 30))]) for _ in range(60)]
    counts = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.int32)
    grammar = tf.re_pair(ids, counts, 50_000, symbols)
    assert len(grammar.sequence) < 0.6 * len(ids) and len(grammar.rules)
    assert np.array_equal(grammar.decode(), ids)
    for k in (0, 17, 59):
        assert np.array_equal(grammar.read(k), docs[k])
    # A rule stands for what its two symbols stand for.
    lengths = dict(enumerate(grammar.lengths(), start=50_000))
    for i, (a, b) in enumerate(grammar.rules.tolist()):
        assert lengths[50_000 + i] == lengths.get(a, 1) + lengths.get(b, 1)


def test_reading_a_document_needs_only_the_rules_it_reaches():
    """All other rules may be wrong, and so may the rules that a slice does not reach."""
    rng = np.random.default_rng(11)
    phrase = rng.integers(0, 300, 60)
    docs = [np.concatenate([phrase[: rng.integers(1, 60)] for _ in range(rng.integers(1, 40))]) for _ in range(80)]
    ids, counts = np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs])
    whole = tf.re_pair(ids, counts, 50_000, 1 << 16)
    ends = np.cumsum(whole.n_symbols)

    def reached(symbols):
        found, todo = set(), [s for s in symbols.tolist() if s >= 50_000]
        while todo:
            rule = todo.pop() - 50_000
            if rule not in found:
                found.add(rule)
                todo += [s for s in whole.rules[rule].tolist() if s >= 50_000]
        return found

    for k in (0, 5, 79):
        used = reached(whole.sequence[ends[k] - whole.n_symbols[k] : ends[k]])
        assert 0 < len(used) < len(whole.rules)
        rules = np.full_like(whole.rules, 49_999)
        rules[sorted(used)] = whole.rules[sorted(used)]
        part = tf.Grammar(50_000, rules, whole.sequence, whole.n_symbols, whole.lengths())
        assert np.array_equal(part.read(k), docs[k])
        for a, b in ((0, 1), (3, 9), (len(docs[k]) - 2, None), (0, 0), (5, 10**9), (10**9, None)):
            assert np.array_equal(part.read(k, a, b), docs[k][a:b])
    lengths = tf.Grammar(50_000, whole.rules, whole.sequence, whole.n_symbols).lengths()
    assert lengths.tolist() == [len(tf.expand(np.array([50_000 + i]), 50_000, *whole._expansions())[0]) for i in range(len(lengths))]


def test_all_rows_of_an_id_are_found(spark, library, tmp_path):
    data = [(7, "one"), (7, "two three"), (7, "one"), (None, "no id"), (None, ""), (8, "other")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "files")
    tf.write_token_files(df, VOCABULARY, path)
    for doc_id in (7, None, 8, 9):
        want = sorted([*expected(library, [t])[0], 0] for i, t in data if i == doc_id)
        assert sorted(r["ids"] for r in tf.read_ids(spark, path, doc_id).collect()) == want
        assert sorted(r["ids"] for r in tf.read_ids(spark, path, doc_id, 1, 2).collect()) == sorted(x[1:2] for x in want)


def test_counts_beside_replacements_stay_exact():
    """The counts that are carried from round to round are those of a full count."""
    rng = np.random.default_rng(12)
    ids = np.concatenate([rng.integers(0, 6, 3000), np.full(500, 3), np.tile(rng.integers(0, 6, 7), 90)]).astype(np.int32)
    counts = np.diff(np.unique(np.r_[0, rng.integers(1, len(ids), 60), len(ids)]))
    real, seen = tf._frequent_pairs, []

    def checking(keys, slots, void, hashed, least):
        assert np.array_equal(hashed, np.bincount(slots[~void], minlength=len(hashed)))
        seen.append(len(keys))
        return real(keys, slots, void, hashed, least)

    tf._frequent_pairs = checking
    try:
        grammar = tf.re_pair(ids, counts, 10, 1 << 16)
    finally:
        tf._frequent_pairs = real
    assert len(seen) > 3 and np.array_equal(grammar.decode(), ids)


def test_grammar_of_few_symbols_and_of_nothing_frequent():
    ids = np.arange(50, dtype=np.int32)
    assert len(tf.re_pair(ids, np.array([50]), 60, 1 << 16).rules) == 0
    same = np.zeros(100, np.int32)
    assert np.array_equal(tf.re_pair(same, np.array([99, 1]), 5, 5).decode(), same)


@pytest.mark.parametrize("symbols", [1 << 16, 1 << 31])
def test_grammar_of_copies_and_of_runs_goes_to_the_end(symbols):
    passage = np.random.default_rng(6).permutation(50_000)[:400]
    ids, counts = np.tile(passage, 300).astype(np.int32), np.full(300, 400)
    grammar = tf.re_pair(ids, counts, 50_000, symbols)
    assert np.array_equal(grammar.decode(), ids) and grammar.n_symbols.max() == 1
    runs = np.array([2000, 1, 37, 2, 3000])
    grammar = tf.re_pair(np.full(runs.sum(), 7, np.int32), runs, 50_000, symbols)
    assert np.array_equal(grammar.decode(), np.full(runs.sum(), 7))
    assert np.array_equal(grammar.read(2), np.full(37, 7)) and len(grammar.sequence) < 60


def test_columns_of_the_results_names_are_replaced_and_odd_bytes_defined(spark, library):
    df = documents(spark, ["a b", None, "c"]).selectExpr("*", "'x' as ids", "1 as DECODED")
    got = bpe.encode(df, VOCABULARY, decoded=True)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    assert [(r["ids"], r["decoded"]) for r in got.orderBy("doc_id").collect()] == [(expected(library, [t])[0], t) for t in ("a b", "", "c")]
    odd = spark.sql("select 1L as doc_id, cast(x'61FF62' as string) as text")
    assert bpe.encode(odd, VOCABULARY, decoded=True).first()["decoded"] == "a\ufffdb"

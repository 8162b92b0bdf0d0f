import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, crc, documents, hard_texts

import corpus_pipeline
from irregts.llm import gru, langid, quality
from irregts.llm import language_model as lm
from irregts.llm.common import id_crc32

ENGLISH = "the cat and the dog were in the house when it rained and they slept".split()
GERMAN = "der hund und die katze waren in dem haus als es regnete und sie schliefen".split()
FRENCH = "le chien et le chat étaient dans la maison quand il pleuvait et ils dormaient".split()


def prose(words, n, seed, length=30):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words, length)) for _ in range(n)]


# --- language ------------------------------------------------------------------


@pytest.fixture(scope="module")
def spoken(spark):
    texts = [*prose(ENGLISH, 60, 1), *prose(GERMAN, 60, 2), *prose(FRENCH, 60, 3)]
    langs = ["en"] * 60 + ["de"] * 60 + ["fr"] * 60
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")


def test_held_out_languages(spark, spoken):
    learned = spoken.union(spark.createDataFrame([(900, None, "en"), (901, "x", None)], spoken.schema))
    model = langid.learn(clashing(learned.filter(id_crc32() % 5 != 0)))
    assert model.languages == ["de", "en", "fr"]
    rest = clashing(spoken.filter(id_crc32() % 5 == 0)).select("lang", langid.prediction(model).alias("p"))
    assert all(r["lang"] == r["p"]["lang_pred"] and 0.5 < r["p"]["score"] <= 1 for r in rest.collect())


def test_hard_texts_have_a_language_or_none(spark, spoken):
    model = langid.learn(spoken)
    got = documents(spark, [*hard_texts(), "123 !?", "字", "²"]).select("text", langid.prediction(model).alias("p")).collect()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang_pred"] != "und") == letters and 0 <= r["p"]["score"] <= 1
    kept = langid.with_language(clashing(documents(spark, ["the cat and the dog", None, "123"])), model, 0.3)
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_more_languages_than_bits_of_a_word(spark):
    """70 languages of words of their own; the filters take two words per slot."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {f"l{i:02}": ["".join(rng.choice(letters, 9)) for _ in range(30)] for i in range(70)}
    data = [(i, " ".join(rng.choice(words[lang], 25)), lang) for i, lang in enumerate(sorted(words) * 8)]
    model = langid.learn(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.languages == sorted(words) and model.masks.shape == (langid.SLOTS, 2)
    for lang in words:
        assert model.predict(" ".join(rng.choice(words[lang], 25)).encode())[0] == lang
    few = langid.LanguageFilter.build(["a"], np.arange(9, dtype=np.uint64), np.zeros(9, np.int64))
    assert few.masks.shape == (langid.SLOTS,)


def test_bytes_that_are_not_utf8_have_a_language_or_none(spark, spoken):
    model = langid.learn(spoken)
    assert model.predict(b"\xff\xfe 12") == ("und", 0.0) and model.predict(b"the cat \xff")[0] == "en"


def test_nothing_to_learn_from(spark, spoken):
    model = langid.learn(spoken.limit(0))
    assert documents(spark, ["text"]).select(langid.prediction(model).alias("p")).first()["p"]["lang_pred"] == "und"


def test_filter_returns_all_owners_and_counts_are_corrected():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 40, 60_000).astype(np.uint64)
    owner = np.arange(60_000) % 2
    shared = keys[:100]
    both = langid.LanguageFilter.build(["a", "b"], np.concatenate([keys, shared]), np.concatenate([owner, 1 - owner[:100]]))
    found = np.bitwise_and.reduce([both.masks[s] for s in langid.slots(keys)])
    assert ((found >> owner.astype(np.uint64)) & np.uint64(1)).all()
    assert (found[:100] == 3).all()
    strange = rng.integers(1 << 50, 1 << 52, 200_000).astype(np.uint64)
    hits = np.bitwise_and.reduce([both.masks[s] for s in langid.slots(strange)]) & np.uint64(1)
    assert hits.mean() == pytest.approx(both.fill[0] ** langid.HASHES, rel=0.2)


# --- quality -------------------------------------------------------------------


def test_quality_learns_features_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) != (x[:, 2] > 0.5))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert {(1, 2), (2, 1)} & set(model.pairs)
    accuracy = ((model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean()
    assert accuracy > 0.95
    # The score is nothing but table entries.
    at = model.bins(x[:5])
    total = model.base + sum(t[at[:, j]] for j, t in enumerate(model.tables))
    total = total + sum(t[at[:, i], at[:, j]] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert model.score(x[:5]) == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_documents(spark):
    good, bad = prose(ENGLISH, 120, 5, 40), [" !! ".join(w.upper() for w in t.split()) for t in prose(ENGLISH, 120, 6, 40)]
    df = documents(spark, [*good, *bad, *hard_texts()])
    known = [(i, int(i < 120), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0), (9999, 1, 0)]
    labels = clashing(spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    got = quality.score_documents(clashing(df), labels, id_crc32() % 3 == 1).collect()
    assert len(got) == 250
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (crc(r["doc_id"]) % 3 == 1)
        if r["doc_id"] < 240:
            assert r["predicted"] == int(r["doc_id"] < 120)
    model = quality.learn(df, labels)
    kept = quality.with_quality(clashing(df).filter("doc_id < 240"), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(120))
    empty = quality.score_documents(df.limit(0), labels.limit(0), id_crc32() % 3 == 1)
    assert empty.count() == 0


def test_a_hot_id_is_thinned_like_other_rows(spark, monkeypatch):
    """An id with a third of all documents and many labels does not fill the driver."""
    drawn = []
    monkeypatch.setattr(quality, "fit", lambda x, y: drawn.append(len(x)))
    texts = [(5 if i % 3 == 0 else i, f"text number {i}") for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(5, 1)] * 500 + [(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    quality.learn(df, labels, sample=300)
    assert 150 < drawn[0] < 450


def test_features_of_the_empty_text_are_finite():
    for raw in (b"", b" ", b"\n\n", "é".encode()):
        values = quality.features(raw)
        assert len(values) == len(quality.FEATURES) and all(map(math.isfinite, values))


# --- language model --------------------------------------------------------------


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    network = gru.Network.start(gru.Shape(40, 5), rng.random(45) * 10)
    network.parameters = {k: v.astype(float) for k, v in network.parameters.items()}
    symbols, resets, weight = rng.integers(0, 45, (6, 4)), rng.random((6, 4)) < 0.2, rng.random((6, 4)) < 0.8
    state = rng.random((4, gru.HIDDEN))

    def loss():
        return network.gradient(state, symbols, resets, weight)[2]

    grads = network.gradient(state, symbols, resets, weight)[0]
    for name, values in network.parameters.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in values.shape)
            at = (symbols[0, 0], *at[1:]) if name == "table" else at
            was = values[at]
            values[at] = was + 1e-5
            up = loss()
            values[at] = was - 1e-5
            down = loss()
            values[at] = was
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_probabilities_of_all_symbols_add_up_to_one():
    network = gru.Network.start(gru.Shape(40, 5), np.arange(45.0))
    state = np.random.default_rng(0).random((1, gru.HIDDEN)).astype(np.float32)
    logs = network.log_probability(np.repeat(state, 45, axis=0), np.arange(45))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_scores_carry_state_over_whole_sequences():
    rng = np.random.default_rng(2)
    network = gru.Network.start(gru.Shape(40, 5), np.ones(45))
    lengths = np.array([3, 0, 500, 1, 77])
    symbols = rng.integers(0, 45, lengths.sum())
    got, at = network.score(symbols, lengths), 0
    for n, score in zip(lengths, got):
        state, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for s in symbols[at : at + n]:
            total += float(network.log_probability(state, np.array([s]))[0])
            state = network.step(state, np.array([s]))[0]
        assert score == pytest.approx(total, rel=1e-4, abs=1e-6)
        at += n


def test_counts_and_scores_of_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN_WORDS", 1030)  # most words then come from the join
    rng = np.random.default_rng(3)
    names = [f"name{i}" for i in range(3000)]
    texts = [" ".join([*rng.choice(ENGLISH, 20), *rng.choice(names, 10)]) for _ in range(300)] + hard_texts()
    df = documents(spark, texts)
    got = lm.score_documents(clashing(df), id_crc32() % 5 == 1).orderBy("doc_id").collect()
    tokens = [lm.words_of((t or "").encode()) for t in texts]
    counts: Counter = Counter()
    for i, t in enumerate(tokens):
        if crc(i) % 5 != 1:
            counts.update(t)
    total, distinct = sum(counts.values()), len(counts)
    for i, (r, t) in enumerate(zip(got, tokens, strict=True)):
        assert (r["doc_id"], r["held_out"], r["n_tokens"]) == (i, crc(i) % 5 == 1, len(t))
        assert r["n_known"] == sum(counts[w] > 0 for w in t) and r["train_tokens"] == total
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for r in got[:300] if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Several replicas, rounds and a row that occurs very often; 1 partition and 37."""
    monkeypatch.setattr(lm, "REPLICA_SYMBOLS", 4000)
    monkeypatch.setattr(lm, "HOT_ROWS", 100)
    monkeypatch.setattr(lm, "SAMPLE_SYMBOLS", 3000)
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(ENGLISH, rng.integers(5, 90))) for _ in range(400)]
    data = [(i, t) for i, t in enumerate(texts)] + [(10_000, "a text that is there very often")] * 300
    df = spark.createDataFrame(data, "doc_id long, text string")
    one, many = (
        {(r["doc_id"], r["n_tokens"]): (r["base_score"], r["score"]) for r in lm.score_documents(df.repartition(n), id_crc32() % 5 == 1).collect()}
        for n in (1, 37)
    )
    assert set(one) == set(many) and len(one) == 401
    for name, (base, score) in one.items():
        assert many[name][0] == pytest.approx(base, rel=1e-9)
        assert many[name][1] == pytest.approx(score, rel=1e-5 if name[0] < 10_000 else 1e-2) or name[0] < 10_000 and many[name][1] == pytest.approx(score, rel=1e-3)


def test_the_last_lane_is_filled_up_and_nothing_is_dropped(monkeypatch):
    seen = []

    class Recorder(gru.Network):
        def gradient(self, state, symbols, resets, weight):
            seen.extend(symbols[weight].tolist())
            return {k: np.zeros_like(v) for k, v in self.parameters.items()}, state, 0.0

    start = gru.Network.start(gru.Shape(10, 0), np.ones(10))
    symbols = np.arange(1000) % 10
    gru.train_stream(Recorder(start.shape, start.parameters), symbols, symbols == 0, 1, 0.01, lanes=7)
    assert sorted(seen) == sorted(symbols.tolist())


def test_model_of_an_empty_corpus(spark):
    df = documents(spark, ["a b", None])
    nothing = lm.score_documents(df, id_crc32() % 5 >= 0).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in nothing] == [(3, 0, 0), (1, 0, 0)]
    assert lm.score_documents(df.limit(0), id_crc32() % 5 == 1).count() == 0


# --- pipeline --------------------------------------------------------------------


def test_stages_keep_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()]
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert len(left) <= before and left, name
        if name == "quality":
            assert len(left & set(bad)) <= 1
        before = len(left)
    assert corpus_pipeline.run(spark, sf).count() == before


def test_stages_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_replicas_read_whole_texts_from_their_starts(monkeypatch):
    """Every symbol of every text is trained on once, after the state of what is before it."""
    monkeypatch.setattr(lm, "LANES", 3)
    lengths = [1, 5, 40, 700, 32, 64, 2, 33, 90, 1]
    texts = [np.full(n, i) for i, n in enumerate(lengths)]
    read = []

    class Recorder(gru.Network):
        def gradient(self, state, symbols, resets, weight):
            state = state.copy()
            for t in range(len(symbols)):
                state[resets[t]] = 0
                for k in np.flatnonzero(weight[t]):
                    read.append((int(symbols[t, k]), int(state[k, 0])))
                    state[k, 0] += 1
            return {k: np.zeros_like(v) for k, v in self.parameters.items()}, state, 0.0

    start = gru.Network.start(gru.Shape(10, 0), np.ones(10))
    lanes = lm.Lanes(Recorder(start.shape, start.parameters))
    for text in texts:
        lanes.feed(text)
    lanes.finish()
    assert sorted(read) == [(i, at) for i, n in enumerate(lengths) for at in range(n)] and lanes.seen == sum(lengths)


def peak_mb(act):
    """Memory that ``act`` takes anew, at most, when it has been done before."""
    act()
    tracemalloc.start()
    try:
        act()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_windows_are_worked_on_in_memory_that_is_there():
    """Fresh pages for the arrays of each window took a third of the time of training."""
    rng = np.random.default_rng(4)
    network = gru.Network.start(gru.Shape(1024, 30), rng.random(1054) * 10)
    symbols, resets = rng.integers(0, 1054, (gru.WINDOW, lm.LANES)), rng.random((gru.WINDOW, lm.LANES)) < 0.01
    state, weight = np.zeros((lm.LANES, gru.HIDDEN), np.float32), np.ones(symbols.shape, bool)
    assert peak_mb(lambda: network.gradient(state, symbols, resets, weight)) < 2.5


def test_scoring_holds_what_fits_the_cache():
    rng = np.random.default_rng(5)
    network = gru.Network.start(gru.Shape(1024, 30), rng.random(1054) * 10)
    lengths = rng.integers(0, 60, 6000)
    symbols = rng.integers(0, 1054, lengths.sum()).astype("<u2")
    assert peak_mb(lambda: network.score(symbols, lengths)) < 4
    some = rng.permutation(6000)[:40]
    ends = np.cumsum(lengths)
    alone = [network.score(symbols[ends[i] - lengths[i] : ends[i]], lengths[i : i + 1])[0] for i in some]
    assert network.score(symbols, lengths)[some] == pytest.approx(alone, rel=1e-4, abs=1e-6)


def test_a_word_takes_no_python_object():
    """Counting and reading keep the words of a batch in one array; a list of them takes 30 MB here."""
    raw = " ".join(prose(ENGLISH, 100, 8, 4000)).encode()
    batch = pa.record_batch({"doc_id": [1], "held_out": [False], "raw": pa.array([raw], pa.binary())})
    counts = Counter(lm.words_of(raw))
    words = [lm.END, *sorted(set(counts) - {lm.END})]
    classes = np.zeros(lm.CLASSES, np.int64)
    known = lm.Lexicon(counts.total(), len(counts), words, np.array([counts[w] for w in words]), classes, classes)
    assert peak_mb(lambda: list(lm._count(iter([batch.select(["raw"])])))) < 20
    assert peak_mb(lambda: list(lm._read(iter([batch]), known))) < 30


def test_words_of_a_batch_are_those_of_its_texts(monkeypatch):
    """Texts that meet inside a word, odd white space, bytes that are not UTF-8, slices, small groups."""
    odd = [b"", b"a", b"b", b"", b"c ", b"d\x0be\x0cF", b"\x1cG \x85\xa0\xff Zz\x00zz zz\x00ZZ x", b" \t\r\n", b"the x y the zz\x00zz", b"x", b""]
    raws = odd + [(t or "").encode() for t in [*hard_texts(), *prose(ENGLISH, 50, 9)]]
    counts = Counter(w for r in raws for w in lm.words_of(r))
    words = [lm.END, *(w.encode() for w in ENGLISH[:5]), b"x", b"zebra"]
    words = list(dict.fromkeys(words))
    monkeypatch.setattr(lm, "MODEL_WORDS", 4)
    tokens, distinct = np.arange(lm.CLASSES) + 5, np.arange(lm.CLASSES) + 2
    known = lm.Lexicon(counts.total(), len(counts), words, np.array([counts[w] for w in words]), tokens, distinct)
    whole = pa.record_batch({"doc_id": range(len(raws)), "held_out": [False] * len(raws), "raw": pa.array(raws, pa.binary())})
    for least, held, cut in ((1, 3, 1), (1 << 20, 200_000, 7), (40, 5, 3)):
        monkeypatch.setattr(lm, "READ_BYTES", least)
        monkeypatch.setattr(lm, "HELD_WORDS", held)
        batches = [whole.slice(a, cut) for a in range(0, len(raws), cut)]
        got = Counter()
        for b in lm._count(b.select(["raw"]) for b in batches):
            for token, n in zip(b["token"].to_pylist(), b["n"].to_pylist()):
                got[token] += n
        assert got == counts
        read = [r for b in lm._read(iter(batches), known) for r in b.to_pylist()]
        for r, raw in zip(read, raws, strict=True):
            said = lm.words_of(raw)
            rare = Counter(w for w in said if w not in words)
            assert [(x["token"], x["n"]) for x in r["rare"]] == list(rare.items())  # in order of appearance
            place = {w: i for i, w in enumerate(words)}
            symbols = [place[w] if place.get(w, 4) < 4 else 4 + int(lm.CLASS_OF_BYTE[w[-1]]) for w in said]
            assert np.frombuffer(r["symbols"], "<u2").tolist() == symbols and r["n_tokens"] == len(said)
            assert r["n_known"] == sum(w in place and counts[w] > 0 for w in said)
            assert r["logs"] == pytest.approx(sum(math.log10(counts[w] + 0.5) for w in said if w in place))
            share = {c: math.log10(tokens[c] + 0.5 * (distinct[c] + 1)) for c in range(lm.CLASSES)}
            beside = sum((math.log10(counts[w] + 0.5) if w in place else 0) - share[s - 4] for w, s in zip(said, symbols) if s >= 4)
            assert r["beside"] == pytest.approx(beside)

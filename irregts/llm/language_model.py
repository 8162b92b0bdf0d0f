"""LM scoring: counts over the corpus and a gated recurrent network.

Counts of all words of the learning documents come from one aggregation that grows with the
corpus. The ``MODEL_WORDS`` most frequent ones are symbols of the network; a rarer word is the
symbol of its class (its last byte decides), and its probability in the class is that of its
count there. A second pass turns every text into symbols once, in a written table that training and
scoring read.

The network is started on about ``SAMPLE_SYMBOLS`` symbols of whole distinct texts, drawn by the
hash of a row, in one task (truncated backpropagation). Then replicas of it are trained on the whole
text of each learning document, window by window, the state carried from a text's start to its end.
A replica is given about ``REPLICA_SYMBOLS`` symbols or more; a row's hash says which replica reads it, so how
the input is split into files or partitions does not matter, and the number of replicas grows
with the corpus. There are ``ROUNDS`` rounds, each on its share of the rows; after each the
replicas' weights are averaged by the symbols that they saw. Rows that occur more than ``HOT_ROWS``
times alike are dealt out over all replicas.

A document is scored whole: its state is carried from window to window. The counts of at
most ``KNOWN_WORDS`` most frequent words travel with the tasks (a fixed bound); rarer words of
a document meet the count table in a join. Scores of one corpus in other partitions agree to about
one part in a thousand: sums of 32-bit numbers depend on their order, and so do the shares of hot rows.

Nulls and empty texts are the end token alone. A null doc_id counts as the empty string where
documents are divided. Repeated rows are scored row by row. With nothing to learn from, only
the end token has a probability of its own. Other columns are ignored.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.llm.common import LOWER, bounded_batches, utf8
from irregts.llm.gru import NAMES, WINDOW, Adam, Network, Shape, train_stream
from irregts.llm.pieces import grouped
from irregts.operators.layout import small_side
from irregts.operators.vectors import sum_vectors, vector_row
from irregts.session import materialise

MODEL_WORDS, KNOWN_WORDS = 1024, 1 << 18
#: Expected symbols of the start, its epochs and rate.
SAMPLE_SYMBOLS, EPOCHS, RATE = 1 << 20, 4, 0.01
#: Rounds of averaging; symbols of a replica in all rounds, more where there would be more than
#: ``REPLICAS``; equal rows above which they are dealt out.
ROUNDS, REPLICA_SYMBOLS, REPLICAS, HOT_ROWS = 2, 1 << 21, 1 << 17, 1000
#: Texts that a replica reads side by side, and the rate of a step in which all of them fill a window.
LANES, LANE_RATE = 256, 0.002
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 200_000
#: Windows that the lanes of a replica are cut into at a time.
AHEAD = 16
#: Bytes of text that are turned into symbols at once, and of symbols (2 bytes) that are scored at
#: once: the more texts advance together, the less is spent on the last steps of the longest.
READ_BYTES, SCORED_BYTES = 3 << 20, 16 << 20
#: The end of a text; no word holds a space.
END = b" "
#: White space, and of each byte whether it belongs to a word.
SPACES = b" \t\n\r\x0b\x0c"
IN_WORD = bytes(b not in SPACES for b in range(256))

# Classes of rarer words by their last byte: a to z, full stop, comma, non-ASCII, others.
CLASSES = 30
CLASS_OF_BYTE = np.full(256, 29, np.int64)
CLASS_OF_BYTE[97:123] = np.arange(26)
CLASS_OF_BYTE[[ord("."), ord(",")]] = 26, 27
CLASS_OF_BYTE[128:] = 28


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words of a text, then the end."""
    return [*raw.translate(LOWER).split(), END]


def _ends(values: pa.Array) -> np.ndarray:
    """Where the first of some byte strings starts in their buffer and where each ends."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def _words(raws: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts one after the other, without ends, and how many each
    text has."""
    ends = _ends(raws)
    data = memoryview(raws.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes().translate(LOWER)
    ends -= ends[0]
    inside = np.frombuffer(data.translate(IN_WORD), bool)
    begins, ending = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ending[:-1] &= ~inside[1:]
    # No word goes over the end of a text.
    edges = ends[(ends > 0) & (ends < len(data))]
    begins[edges], ending[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(begins)
    offsets = np.append(0, np.cumsum(np.flatnonzero(ending) + 1 - starts)).astype(np.int32)
    kept = pa.py_buffer(data.translate(None, SPACES))
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), kept])
    return words, np.diff(np.searchsorted(starts, ends))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    ends = 0

    def summed() -> pa.Table:
        found = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")])
        return found.select(["token", "n_sum"]).rename_columns(["token", "n"])

    for batch in grouped(batches, least=READ_BYTES):
        words, _ = _words(batch.column("raw").cast(pa.binary()))
        ends += len(batch)
        seen = words.value_counts()
        held.append(pa.table({"token": seen.field("values"), "n": seen.field("counts")}))
        if sum(map(len, held)) >= HELD_WORDS:
            held = [summed()]
            if len(held[0]) >= HELD_WORDS:
                yield from held[0].to_batches()
                held = []
    if ends:
        held.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())}))
        yield from summed().to_batches()


@dataclass
class Lexicon:
    """Corpus totals, the most frequent words with their counts, and per class of rarer words
    (those that are no symbol) the number of tokens and of distinct words."""

    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_distinct: np.ndarray

    @property
    def shape(self) -> Shape:
        return Shape(min(MODEL_WORDS, len(self.words)), CLASSES)

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.shape.words], self.class_tokens]).astype(float)


def count_words(texts: DataFrame) -> DataFrame:
    """token, n over all ``texts`` (column raw), written once."""
    counted = texts.select("raw").mapInArrow(_count, "token binary, n long")
    return materialise(counted.groupBy("token").agg(F.sum("n").alias("n")), "word_counts")


def _most_frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Words in descending order of counts: all whose count reaches a level that at most
    ``KNOWN_WORDS`` words reach. Levels are steps of 1/16 of a doubling, so that a small
    histogram gives the level and no task ranks the words of the others."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect()
    least, total = 1 << 30, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["v"]
        if total > KNOWN_WORDS:
            break
        least = row["level"]
    found = counts.filter(level >= least).toArrow()
    words, n = found["token"].to_pylist(), found["n"].to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order]


def lexicon(counts: DataFrame) -> Lexicon:
    last = F.hex(F.substring("token", -1, 1)).alias("last")
    by_byte = counts.groupBy(last).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    words, n = _most_frequent(counts)
    # The end token is always a symbol.
    place = words.index(END) if END in words else len(words)
    order = [place, *(i for i in range(len(words)) if i != place)]
    words, n = [*words, END], np.append(n, 0)
    words, n = [words[i] for i in order], n[order]
    class_tokens, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_byte:
        if r["last"]:
            c = CLASS_OF_BYTE[int(r["last"], 16)]
            class_tokens[c] += r["n"]
            class_distinct[c] += r["v"]
    for w, k in zip(words[:MODEL_WORDS], n[:MODEL_WORDS].tolist()):
        if k:
            class_tokens[CLASS_OF_BYTE[w[-1]]] -= k
            class_distinct[CLASS_OF_BYTE[w[-1]]] -= 1
    tokens, distinct = sum(r["n"] for r in by_byte), sum(r["v"] for r in by_byte)
    return Lexicon(tokens, distinct, words, n, class_tokens, class_distinct)


def _read(batches: Iterator[pa.RecordBatch], known: Lexicon) -> Iterator[pa.RecordBatch]:
    """Per document its symbols, what the lexicon says of it, and its words that are not there."""
    words, lookup = known.shape.words, pa.array(known.words, pa.binary())
    log_count = np.log10(known.counts + 0.5)
    in_class = np.log10(known.class_tokens + 0.5 * (known.class_distinct + 1))
    last = np.frombuffer(bytes(w[-1] for w in known.words), np.uint8)
    symbol = np.where(np.arange(len(last)) < words, np.arange(len(last)), words + CLASS_OF_BYTE[last])
    counted = known.counts > 0

    def last_of(tokens: pa.Array) -> np.ndarray:
        return np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[_ends(tokens)[1:] - 1]

    for batch in grouped(batches, least=READ_BYTES):
        tokens, n_words = _words(batch.column("raw").cast(pa.binary()))
        owner = np.repeat(np.arange(len(n_words)), n_words)
        at = pc.index_in(tokens, value_set=lookup).fill_null(-1).to_numpy()
        unknown = np.flatnonzero(at < 0)
        strange = tokens.take(pa.array(unknown))
        symbols, logs = symbol[at], log_count[at]
        symbols[unknown], logs[unknown] = words + CLASS_OF_BYTE[last_of(strange)], 0.0
        seen = counted[at]
        seen[unknown] = False
        rarer = np.flatnonzero(symbols >= words)
        beside = np.bincount(owner[rarer], logs[rarer] - in_class[symbols[rarer] - words], len(n_words))
        # The end, first in the lexicon, is the last token of every text.
        known_tokens = np.bincount(owner[seen], minlength=len(n_words)) + int(counted[0])
        logs = np.bincount(owner, logs, len(n_words)) + log_count[0]
        # Words that are not in the lexicon, per text in the order in which they come.
        strange = strange.dictionary_encode()
        different = max(1, len(strange.dictionary))
        pairs, first, times = np.unique(owner[unknown] * different + strange.indices.to_numpy(), return_index=True, return_counts=True)
        order = np.argsort(first)
        whose, which = np.divmod(pairs[order], different)
        rare = pa.StructArray.from_arrays([strange.dictionary.take(pa.array(which)), pa.array(times[order])], names=["token", "n"])
        rare_ends = np.append(0, np.cumsum(np.bincount(whose, minlength=len(n_words))))
        ends = np.cumsum(n_words + 1)
        data = np.zeros(len(tokens) + len(n_words), "<u2")
        data[np.arange(len(tokens)) + owner] = symbols
        ends_of_bytes = pa.py_buffer(np.append(0, 2 * ends).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(n_words + 1),
                pa.array(known_tokens),
                pa.array(logs),
                pa.array(beside.astype(float)),
                pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare),
                pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, ends_of_bytes, pa.py_buffer(data)]),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "beside", "rare", "symbols"],
        )


def _symbols(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2").astype(np.int64)


def _weights(network: Network) -> np.ndarray:
    return np.concatenate([network.parameters[k].ravel() for k in NAMES]).astype(np.float64)


def _restored(network: Network, flat: np.ndarray) -> Network:
    parameters, at = {}, 0
    for k in NAMES:
        old = network.parameters[k]
        parameters[k] = np.ascontiguousarray(flat[at : at + old.size], np.float32).reshape(old.shape)
        at += old.size
    return Network(network.shape, parameters)


def _start(batches: Iterator[pa.RecordBatch], known: Lexicon) -> Iterator[pa.RecordBatch]:
    streams, starts = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for batch in batches:
        for raw in batch.column("symbols").to_pylist():
            streams.append(_symbols(raw))
            starts.append(np.arange(len(streams[-1])) == 0)
    network = Network.start(known.shape, known.symbol_counts())
    train_stream(network, np.concatenate(streams), np.concatenate(starts), EPOCHS, RATE)
    yield vector_row(_weights(network))


class Lanes:
    """Texts side by side, each whole in one lane, read from start to end in windows."""

    def __init__(self, network: Network) -> None:
        self.network, self.adam, self.seen = network, Adam(network, LANE_RATE), 0
        self.state = np.zeros((LANES, network.parameters["recurrent"].shape[0]), np.float32)
        #: Per lane its texts and how much of the first has been read.
        self.texts: list[list[np.ndarray]] = [[] for _ in range(LANES)]
        self.read = [0] * LANES
        self.held = [(0, lane) for lane in range(LANES)]  # a heap

    def feed(self, symbols: np.ndarray) -> None:
        """Put a text at the end of the shortest lane; train while all lanes fill some windows."""
        n, lane = self.held[0]
        self.texts[lane].append(symbols)
        heapq.heapreplace(self.held, (n + len(symbols), lane))
        while self.held[0][0] >= AHEAD * WINDOW:
            self.run()

    def run(self) -> None:
        """The next windows of all lanes; a lane that ends drops out. The rate of a step goes with
        its symbols."""
        steps = AHEAD * WINDOW
        grid, resets, sizes = np.zeros((steps, LANES), np.int64), np.zeros((steps, LANES), bool), np.zeros(LANES, np.int64)
        for lane, texts in enumerate(self.texts):
            at, done = 0, self.read[lane]
            while texts and at < steps:
                text = texts[0][done : done + steps - at]
                grid[at : at + len(text), lane] = text
                resets[at, lane] = not done
                at, done = at + len(text), done + len(text)
                if done == len(texts[0]):
                    texts.pop(0)
                    done = 0
            self.read[lane] = done
            sizes[lane] = at
        for at in range(0, int(sizes.max()), WINDOW):
            lanes = np.flatnonzero(sizes > at)
            window = slice(at, at + WINDOW)
            weight = np.arange(at, at + WINDOW)[:, None] < sizes[None, lanes]
            grads, self.state[lanes], _ = self.network.gradient(
                self.state[lanes], grid[window][:, lanes], resets[window][:, lanes], weight
            )
            seen = int(weight.sum())
            self.adam.rate = LANE_RATE * seen / (LANES * WINDOW)
            self.adam.apply(grads)
            self.seen += seen
        self.held = [(sum(map(len, texts)) - self.read[lane], lane) for lane, texts in enumerate(self.texts)]
        heapq.heapify(self.held)

    def finish(self) -> None:
        while any(self.texts):
            self.run()


def _replicas(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    """Train one network per replica, whose rows are neighbours; give out its weights times the
    symbols that it saw, and their number."""
    lanes, replica = None, None
    for batch in batches:
        for now, raw in zip(batch.column("replica").to_pylist(), batch.column("symbols").to_pylist()):
            if now != replica:
                if lanes is not None:
                    yield _given(lanes)
                lanes, replica = Lanes(copy.deepcopy(network)), now
            lanes.feed(_symbols(raw))
    if lanes is not None:
        yield _given(lanes)


def _given(lanes: Lanes) -> pa.RecordBatch:
    lanes.finish()
    return vector_row(np.append(_weights(lanes.network) * lanes.seen, lanes.seen))


def train(learned: DataFrame, known: Lexicon) -> Network:
    """Start on a bounded sample, then average replicas trained on all rows of the written table
    ``learned`` (row, key, symbols). ``key`` is a hash of the row that does not depend on its place."""
    network = Network.start(known.shape, known.symbol_counts())
    draw = F.pmod(F.xxhash64("key", F.lit(0)), F.lit(1 << 30)) / float(1 << 30)
    sample = learned.filter(draw < min(1.0, SAMPLE_SYMBOLS / max(known.tokens, 1)))
    sample = sample.dropDuplicates(["key"]).coalesce(1).sortWithinPartitions("key").select("symbols")
    started = sample.mapInArrow(lambda it: _start(it, known), "values binary").collect()  # of one task
    if started:
        network = _restored(network, np.frombuffer(bytes(started[0]["values"]), "float64"))

    replicas = min(REPLICAS, max(1, -(-known.tokens // REPLICA_SYMBOLS)))
    copies = learned.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = small_side(copies.filter(F.col("n") > HOT_ROWS).select("key", F.lit(True).alias("hot")))
    spread = F.when(F.col("hot"), F.col("row")).otherwise(F.lit(0))
    dealt = learned.join(hot, "key", "left").withColumn("place", F.xxhash64("key", spread, F.lit(1)))
    dealt = dealt.withColumns(
        {"replica": F.pmod("place", F.lit(replicas)), "round": F.pmod(F.xxhash64("place", F.lit(2)), F.lit(ROUNDS))}
    )
    for turn in range(ROUNDS):
        rows = dealt.filter(F.col("round") == turn).repartitionById(replicas, F.col("replica").cast("int"))
        rows = rows.sortWithinPartitions("replica", "place", "key").select("replica", "symbols")
        made = materialise(rows.mapInArrow(lambda it, n=network: _replicas(it, n), "values binary"), "replicas")
        total = sum_vectors(made, "float64")
        if total is not None and total[-1] > 0:
            network = _restored(network, total[:-1] / total[-1])
    return network


def _score(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    """Log10 probability of each document's symbols."""
    for batch in grouped(batches, "symbols", SCORED_BYTES):
        data = b"".join(batch.column("symbols").to_pylist())
        lengths = batch.column("n_tokens").to_numpy()
        score = network.score(np.frombuffer(data, "<u2"), lengths) / np.log(10)
        columns = [batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "beside")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(score)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "beside", "net"]
        )


def score_documents(documents: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. Learns from the documents that are not held out."""
    bounded_batches(documents.sparkSession)
    texts = documents.select("doc_id", held_out.alias("held_out"), utf8().alias("raw"))
    counts = count_words(texts.filter(~F.col("held_out")))
    known = lexicon(counts)

    id_type = documents.schema["doc_id"].dataType.simpleString()
    small = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, beside double"
    read = texts.mapInArrow(lambda it: _read(it, known), f"{small}, rare array<struct<token:binary,n:long>>, symbols binary")
    read = read.withColumns({"row": F.monotonically_increasing_id(), "key": F.xxhash64("doc_id", "symbols", "rare")})
    read = materialise(read, "symbols")
    network = train(read.filter(~F.col("held_out")).select("row", "key", "symbols"), known)

    scored = read.select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "beside", "symbols")
    scored = scored.mapInArrow(lambda it: _score(it, network), f"row long, {small}, net double")
    asked = read.select("row", F.explode("rare").alias("at")).select("row", "at.token", F.col("at.n").alias("times"))
    met = asked.join(counts, "token", "left")
    more = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_logs"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    whole = float(np.log10(known.tokens + 0.5 * (known.distinct + 1)))
    more_logs = F.coalesce("more_logs", F.lit(0.0))
    return materialise(scored, "scored").join(materialise(more, "rarer"), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("net") + F.col("beside") + more_logs).alias("score"),
    )

"""Hidden Markov language model: Baum-Welch over the whole corpus, scored by the scaled forward recursion.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case, then one end. The hidden states emit
symbols: the OWN most frequent words and the end have one each, any other word has that of its class (its last four
bytes, hashed to CLASSES). A class gives its words in proportion to count + 1, and one more unit to all unseen words, so
p(text) = p_HMM(symbols) * product over class words of (c + 1) / Z(class), a distribution over token sequences.

Counts cover all training tokens and stay distributed: they are combined per step and task, summed by word, and written as a
table. The driver and the tasks get the KNOWN most frequent words, the class sums and the model, all of fixed size. A
rarer word meets its count in a join by word; no word left there has more than the 1/KNOWN-th part of all tokens.

An iteration of Baum-Welch is one pass over the encoded training texts. Each task gives its expected counts per symbol
and state; Spark sums them by symbol. For training, a text longer than SEGMENT tokens counts as consecutive segments, so
that memory doesn't grow with the longest text. A segment that isn't the first begins in the stationary distribution of
the states and adds nothing to the start counts; the one transition at each cut isn't counted. README has the effect in
figures. Scores are exact over the whole text.

Defined cases: null text counts as empty (one token, the end); a null id folds like an empty one; repeated rows are
counted and scored as rows of their own; without training rows N = V = 0 and the start model, even over all symbols, is
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

STATES = 8
ITERATIONS = 6
OWN, CLASSES, KNOWN = 8192, 4096, 65536
SYMBOLS = OWN + CLASSES + 1
END = SYMBOLS - 1
SEGMENT = 512
CELLS = 200_000
#: Bytes of text that are split and encoded at once; a single longer text is a step of its own, its words in parts.
STEP = 2 << 20
SMOOTH = 100.0
#: Times that the forward recursion has the symbols of at once.
BLOCK = 4096
#: Times from one scaling to the next. Emissions are over 1e-24 for up to 1e13 tokens, so that 8 factors stay far from the least double.
EVERY = 8
#: Bytes of symbols that are worked on at once; a single longer text is a step of its own.
PIECE = 2 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts_of(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """A text in parts of about size bytes, cut before white space, so that its words are never all held at once."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def word_class(word: bytes) -> int:
    return OWN + crc32(word[-4:]) % CLASSES


def word_steps(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]]]:
    """Row ranges of about STEP bytes and their words: distinct ones, and for all of them their place there and their row
    in the range. A longer text is a range of its own and gives its words in parts."""
    column = batch.column(batch.schema.get_field_index(text))
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_pylist()
    for a, b in common.steps(sizes, STEP):
        texts = [column.slice(a, b - a)]
        if sizes[a] > STEP:
            texts = (pa.array([p], pa.large_binary()).view(pa.large_string()) for p in parts_of(column[a].as_buffer().to_pybytes()))
        yield a, b, map(_words, texts)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    words = found.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty words
    if not pc.all(some).as_py():
        words, row = words.filter(some), row[some.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    return coded.dictionary.view(pa.large_binary()), coded.indices.to_numpy(), row


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word binary, n long) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, parts in word_steps(batch, text):
                for words, code, _ in parts:
                    sums = pa.array(np.bincount(code, minlength=len(words)))
                    for i in range(0, len(words), 50_000):
                        yield pa.RecordBatch.from_arrays([words.slice(i, 50_000).cast(pa.binary()), sums.slice(i, 50_000)], names=["word", "n"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows: fixed size, whatever the corpus."""

    total: int
    distinct: int
    ends: int
    known: dict[bytes, int]  # the most frequent words and their places; the first OWN have a symbol each
    counts: np.ndarray  # of the known words, by place
    class_weight: np.ndarray  # Z of each class
    symbol_count: np.ndarray
    log_class: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.log_class = np.log10(self.class_weight)


def frequent(counts: DataFrame, most: int) -> Column:
    """Condition for the most frequent words, at most so many; ties of one count are broken by a hash of the word.

    Three histograms find it, so only their bins and the words themselves ever come to the driver: of counts by three
    leading digits (900 bins for each power of ten), of the counts in the bin that is too much, and of the hashes of the
    words of the count that is too much.
    """

    def cut(bins: DataFrame, reached: int) -> tuple[int | None, int]:
        """The greatest key that is too much (None: none is), and the words above it."""
        for key, words in sorted(((r["key"], r["words"]) for r in bins.groupBy("key").agg(F.count("*").alias("words")).collect()), reverse=True):
            if reached + words > most:
                return key, reached
            reached += words
        return None, reached

    n = F.col("n")
    unit = F.pow(F.lit(10.0), F.greatest(F.length(n.cast("string")) - 3, F.lit(0))).cast("long")
    low = (F.floor(n / unit) * unit).cast("long")
    bin_, reached = cut(counts.select(low.alias("key")), 0)
    if bin_ is None:
        return F.lit(True)
    exact, reached = cut(counts.where(low == bin_).select(n.alias("key")), reached)
    if exact is None:
        return low > bin_
    place = F.shiftrightunsigned(F.xxhash64("word"), 52)
    top, _ = cut(counts.where(n == exact).select(place.alias("key")), reached)
    return (n > exact) | ((n == exact) & (place > (top if top is not None else -1)))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    top = sorted(((bytes(r["word"]), r["n"]) for r in counts.where(frequent(counts, KNOWN)).collect()), key=lambda x: (-x[1], x[0]))
    own = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in top[:OWN]], "word binary")
    class_ = F.crc32(F.substring("word", -4, 4)) % CLASSES
    weight, symbols = np.ones(CLASSES), np.zeros(SYMBOLS)
    for r in counts.join(F.broadcast(own), "word", "left_anti").groupBy(class_.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        weight[r["k"]] = r["n"] + r["v"] + 1
        symbols[OWN + r["k"]] = r["n"]
    symbols[: len(top[:OWN])] = [n for _, n in top[:OWN]]
    symbols[END] = ends
    return Vocabulary((sums[0] or 0) + ends, sums[1] + (ends > 0), ends, {w: i for i, (w, _) in enumerate(top)}, np.array([n for _, n in top], dtype=np.int64), weight, symbols)


_ENCODED = "row long, n_tokens long, known_top long, log_top double, log_own double, symbols binary, rest array<struct<word:binary,n:long>>"


def encode(docs: DataFrame, words: Vocabulary, text: str, kept: list[str]) -> DataFrame:
    """Each row's symbols and sums over its known words; rest has its rarer words. docs: row, kept columns, text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        known, others = pa.array(list(v.known), pa.large_binary()), len(v.known)
        end = others + CLASSES  # codes: known words, classes, the end
        symbol = np.array([*[i if i < OWN else word_class(w) for w, i in v.known.items()], *range(OWN, SYMBOLS)], dtype="<u2")
        is_known = np.concatenate([np.ones(others, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64), [int(v.ends > 0)]])
        log_top = np.concatenate([np.log10(v.counts + 1.0), np.zeros(CLASSES), [log10(v.ends + 1)]])
        in_class = (symbol >= OWN) & (symbol < END)
        log_own = np.zeros(len(symbol))
        log_own[in_class] = log_top[in_class] - v.log_class[symbol[in_class].astype(np.int64) - OWN]
        for batch in batches:
            names = batch.schema.names
            own = [batch.column(names.index(c)) for c in ("row", *kept)]
            for a, b, parts in word_steps(batch, text):
                coded, rows, rest, rest_rows, times = [], [], [], [], []
                for words, code, row in parts:
                    place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().copy()
                    rare = place < 0
                    place[rare] = [others + crc32(x) % CLASSES for x in pc.binary_slice(words.filter(pa.array(rare)), -4).to_pylist()]
                    coded.append(place[code])
                    rows.append(row)
                    at = np.flatnonzero(rare[code])
                    pairs, n = np.unique(row[at] * len(words) + code[at], return_counts=True)
                    rest.append(words.take(pa.array(pairs % max(len(words), 1))))
                    rest_rows.append(pairs // max(len(words), 1))
                    times.append(n)
                rows = np.concatenate(rows)
                lengths = np.bincount(rows, minlength=b - a) + 1
                last = np.cumsum(lengths)
                at = last - lengths
                every = np.full(last[-1], end, dtype=np.int32)
                every[np.arange(len(rows)) + rows] = np.concatenate(coded)
                symbols = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.append(0, last * 2)), pa.py_buffer(symbol[every])])
                sums = [np.add.reduceat(x[every], at) for x in (is_known, log_top, log_own)]
                ends = np.append(0, np.cumsum(np.bincount(np.concatenate(rest_rows), minlength=b - a)))
                rare_words = pa.StructArray.from_arrays([pa.concat_arrays(rest).cast(pa.binary()), pa.array(np.concatenate(times))], names=["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in own], pa.array(lengths), *[pa.array(x) for x in sums], symbols.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare_words)],
                    names=["row", *kept, "n_tokens", "known_top", "log_top", "log_own", "symbols", "rest"],
                )
        pa.default_memory_pool().release_unused()

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    head, tail = _ENCODED.split(", ", 1)
    return docs.mapInArrow(run, ", ".join([head, *[f"`{c}` {types[c]}" for c in kept], tail]))


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (symbols, K)


def start_model(words: Vocabulary, states: int = STATES, seed: int = 7) -> Model:
    """Unigram emissions, each state's shaken by noise of its own; states tend to stay."""
    noise = np.random.default_rng(seed).gamma(2.0, 0.5, (SYMBOLS, states)) + 0.1
    emit = prior(words)[:, None] * noise
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def prior(words: Vocabulary) -> np.ndarray:
    return (words.symbol_count + 0.5) / (words.symbol_count.sum() + 0.5 * SYMBOLS)


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences of like length together, longest first, in groups of about CELLS cells."""
    order = np.argsort(lengths, kind="stable")[::-1]
    group = (np.cumsum(lengths[order]) - 1) // CELLS
    yield from np.split(order, np.flatnonzero(np.diff(group)) + 1)


def _matrix(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Time-major matrix of symbols, the sequences longest first; cells after an end hold END."""
    width = int(lengths.max())
    places = np.arange(width)[:, None]
    inside = places < lengths
    return np.where(inside, flat[np.where(inside, begins + places, 0)], END)


def _live(lengths: np.ndarray) -> np.ndarray:
    """For each time, how many sequences (longest first) still run."""
    return np.searchsorted(-lengths, -np.arange(int(lengths.max())), side="left")


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each column of a time-major matrix, longest first: the exact scaled recursion."""
    flat = np.ascontiguousarray(symbols.T).ravel()
    return forward_of(model, flat, np.arange(len(lengths)) * symbols.shape[0], lengths)


def _by_time(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The symbols of sequences in a flat array, longest first, time after time, and how many each time has."""
    live = _live(lengths).tolist()
    out, at = np.empty(int(lengths.sum()), dtype=np.intp), 0
    for t, n in enumerate(live):
        out[at : at + n] = flat[begins[:n] + t]
        at += n
    return out, live


def forward_of(model: Model, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for sequences that lie in a flat array, longest first, a block of times after another."""
    total, ones = np.zeros(len(lengths)), np.ones(len(model.start))
    a, e = np.empty((2, len(lengths), len(ones))), np.empty((len(lengths), len(ones)))
    for at in range(0, int(lengths.max()), BLOCK):
        left = lengths[lengths > at] - at
        symbols, live = _by_time(flat, begins[: len(left)] + at, np.minimum(left, BLOCK))
        live.append(int((left > BLOCK).sum()))
        done = 0
        for t in range(len(live) - 1):
            n, m = live[t], live[t + 1]
            now = a[t % 2, :n]
            if at + t:
                np.matmul(a[(t + 1) % 2, :n], model.move, out=now)
            else:
                now[:] = model.start
            now *= np.take(model.emit, symbols[done : done + n], axis=0, out=e[:n], mode="clip")
            done += n
            if (at + t) % EVERY == EVERY - 1:
                scale = now @ ones
                total[:n] += np.log(scale)
                now /= scale[:, None]
            if m < n:
                total[m:n] += np.log(now[m:] @ ones)
        a[1] = a[(len(live) - 2) % 2]  # what the next block begins with
    return total


def stationary(move: np.ndarray) -> np.ndarray:
    """The distribution of states that a move leaves as it is."""
    out = np.full(len(move), 1 / len(move))
    for _ in range(200):
        out = out @ move
    return out / out.sum()


class _Room:
    """Arrays that one group after another uses: memory of their size is new each time, and to touch it costs more than the sums."""

    def __init__(self) -> None:
        self._held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, columns: int) -> np.ndarray:
        if len(self._held.get(name, ())) < rows * columns:
            self._held[name] = np.empty(rows * columns)
        return self._held[name][: rows * columns].reshape(rows, columns)


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray, first: np.ndarray | None = None) -> None:
    """Forward and backward over a time-major matrix, longest first, added to the expected counts. first: which columns begin a text."""
    flat = np.ascontiguousarray(symbols.T).ravel()
    expected_counts_of(model, flat, np.arange(len(lengths)) * symbols.shape[0], lengths, emit, move, start, first)


def expected_counts_of(model: Model, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray, first: np.ndarray | None = None, room: _Room | None = None) -> None:
    """The same for sequences that lie in a flat array. Cells lie time after time, without padding; every EVERY times all
    states are scaled, and a sequence's last sum scales its backward values, so gamma is alpha * beta."""
    symbols, live = _by_time(flat, begins, lengths)
    room = _Room() if room is None else room
    k, cells, n0, ones = len(model.start), len(symbols), len(lengths), np.ones(len(model.start))
    at = np.cumsum([0, *live]).tolist()
    live.append(0)
    e = np.take(model.emit, symbols, axis=0, out=room("e", cells, k), mode="clip")
    alpha, beta, right = room("alpha", cells, k), room("beta", cells, k), room("right", cells, k)
    begin = model.start if first is None else np.where(first[:, None], model.start, stationary(model.move))
    back, scale = np.ascontiguousarray(model.move.T), {}
    for t in range(len(live) - 1):
        b, n, m = at[t], live[t], live[t + 1]
        a = alpha[b : b + n]
        if t:
            np.matmul(alpha[at[t - 1] : at[t - 1] + n], model.move, out=a)
            a *= e[b : b + n]
        else:
            np.multiply(begin, e[:n], out=a)
        if t % EVERY == EVERY - 1:
            scale[t] = (a @ ones)[:, None]
            a /= scale[t]
        if m < n:  # these columns end
            beta[b + m : b + n] = 1 / (a[m:] @ ones)[:, None]
            right[b + m : b + n] = 0
    for t in range(len(live) - 2, 0, -1):
        b, c, n = at[t], at[t - 1], live[t]
        r = np.multiply(e[b : b + n], beta[b : b + n], out=right[c : c + n])
        if t in scale:
            r /= scale[t]
        np.matmul(r, back, out=beta[c : c + n])
    move += model.move * (alpha.T @ right)
    gamma = np.multiply(alpha, beta, out=alpha)
    start += gamma[:n0].sum(axis=0) if first is None else gamma[:n0][first].sum(axis=0)
    for j in range(k):
        emit[:, j] += np.bincount(symbols, gamma[:, j], SYMBOLS)


def _parsed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column(batch.schema.get_field_index("symbols")).to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<u2").astype(np.int32), np.array([len(x) // 2 for x in raw], dtype=np.int64)


def _pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    column = batch.column(batch.schema.get_field_index("symbols"))
    for a, b in common.steps(pc.binary_length(column).to_pylist(), PIECE):
        yield batch.slice(a, b - a)


def train(encoded: DataFrame, words: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the symbols of all rows of the frame."""
    model = start_model(words, states)
    if not words.ends:
        return model
    base = prior(words)
    columns = ", ".join(f"k{j} double" for j in range(states))
    for _ in range(iterations):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            emit, move, start, room = np.zeros((SYMBOLS, states)), np.zeros((states, states)), np.zeros(states), _Room()
            for whole in batches:
                for batch in _pieces_of(whole):
                    flat, lengths = _parsed(batch)
                    begins = np.cumsum(lengths) - lengths
                    parts = -(-lengths // SEGMENT)
                    which = np.repeat(np.arange(len(lengths)), parts)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                    begin, length = begins[which] + nth * SEGMENT, np.minimum(SEGMENT, lengths[which] - nth * SEGMENT)
                    for g in _groups(length):
                        expected_counts_of(shared.value, flat, begin[g], length[g], emit, move, start, nth[g] == 0, room)
            every = np.concatenate([emit, move, start[None]])
            used = np.flatnonzero(every.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(every[used, j]) for j in range(states)]], names=["cell", *[f"k{j}" for j in range(states)]])

        sums = encoded.select("symbols").mapInArrow(run, f"cell long, {columns}").groupBy("cell").agg(*[F.sum(f"k{j}").alias(f"k{j}") for j in range(states)])
        every = np.zeros((SYMBOLS + states + 1, states))
        for r in sums.collect():  # a row per symbol and state at most
            every[r["cell"]] = r[1:]
        emit, move, start = every[:SYMBOLS] + SMOOTH * base[:, None], every[SYMBOLS:-1] + 1.0, every[-1] + 1.0
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def likelihoods(encoded: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """kept columns and log_model, the log10 likelihood of the row's symbols."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces_of(whole):
                flat, lengths = _parsed(batch)
                begins, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
                order = np.argsort(lengths, kind="stable")[::-1]
                out[order] = forward_of(shared.value, flat, begins[order], lengths[order])
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(out / np.log(10))], names=[*kept, "log_model"])

    types = {f.name: f.dataType.simpleString() for f in encoded.schema}
    return encoded.select(*kept, "symbols").mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], "log_model double"]))


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that aren't held out, score all: (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    training = rows.where("not held_out")
    counts = common.saved(count_words(training, "text"), "word-counts")
    words = vocabulary(counts, training.count())
    encoded = common.saved(encode(rows, words, "text", ["id", "held_out"]), "encoded")
    model = train(encoded.where("not held_out"), words)
    rare = encoded.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n").join(counts.select("word", F.col("n").alias("c")), "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("known_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_rare"))
    kept = ["row", "id", "held_out", "n_tokens", "known_top", "log_top", "log_own"]
    out = likelihoods(encoded, model, kept).join(rare, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", (F.col("known_top") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("log_top") + log_rare - F.col("n_tokens") * F.lit(log10(words.total + words.distinct + 1))).alias("base_score"),
        (F.col("log_model") + F.col("log_own") + log_rare).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_hmm_scoring: base and model score of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, common.crc_fold("doc_id", 7) == 2)

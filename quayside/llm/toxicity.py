"""Toxicity of texts whose words may be disguised.

A noisy channel turns letters into look-alikes, puts separators between them, spaces words out and repeats
letters. Every token with a look-alike, a letter twice in a row or a separator becomes a lattice: every character may be itself, a letter it looks like,
a word boundary or nothing. Viterbi decoding finds the reading that a character language model, counted over
all documents, finds most likely. The restored words are scored with stems learned from labelled documents.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.blocks import blocks, fold_of, handed_back, mix, record_batch, with_rows, word_hashes

#: Letters that a character can stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
KEPT, SWAPPED, DROPPED, BROKEN = (math.log(p) for p in (0.6, 0.3, 0.3, 0.03))
SYMBOLS = 32
WORDS = re.compile(r"[^\W\d_]+")
_LOOKS = "".join(map(re.escape, LOOKS_LIKE))
_CURRENCY = frozenset("$@€£+")
#: A character that looks like a letter, or a letter twice in a row.
_DISGUISE = re.compile(rf"[{_LOOKS}]|([^\W\d_])\1")
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]")
_TWICE = re.compile(r"([^\W\d_])\1")
#: Punctuation that neither looks like a letter nor is kept at the end of a word.
_AROUND = re.escape("".join(sorted(set(string.punctuation) - {*LOOKS_LIKE, *_CURRENCY, "_"})))
#: One run of letters, and such punctuation around it.
_PLAIN = re.compile(rf"[{_AROUND}]*([^\W\d_]+)[{_AROUND}]*")
#: Three single characters in a row.
_SPACED = re.compile(r"(?<!\S)\S\s+\S\s+\S(?!\S)")
#: Tokens after which a worker forgets those it has not met since as many before.
MOST_TOKENS = 150_000
#: Stems that a task counts before it sends them.
MOST_COUNTS = 100_000
#: Rows handed on at a time.
ROWS_OUT = 1000


@dataclass(frozen=True)
class Settings:
    """``sample``: about so many labelled documents, chosen by hash, are learned from; it bounds the model.
    ``least``: a stem counts from so many toxic documents on. ``sure``: and from this likelihood ratio on, G².
    ``stems``: the most stems kept, the surest ones.
    """

    sample: int = 20_000
    least: int = 5
    sure: float = 30.0
    stems: int = 20_000


def _symbols() -> np.ndarray:
    """Bytes of lower-cased text as 32 symbols: letters, 5 classes of other bytes, 0 for a word boundary."""
    table = np.zeros(256, np.uint32)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[128:] = 27 + np.arange(128) % 5
    return table


_SYMBOL = _symbols()


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after three others, from all documents: one row for each context.

    Tasks send their counts of four symbols in a row, 2**20 at most, whatever the size of the input.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                if len(block.data) > 3:
                    s = _SYMBOL[block.data]
                    codes = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
                    sums += np.bincount(codes, minlength=SYMBOLS**4)
        code = np.flatnonzero(sums)
        yield record_batch({"code": code, "n": sums[code]}, pa.schema([("code", pa.int64()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    four = np.zeros(SYMBOLS**4)
    four[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return log_probabilities(four.reshape((SYMBOLS,) * 4))


def log_probabilities(four: np.ndarray, weight: float = 2.0) -> np.ndarray:
    """Every order leans on the one below with ``weight`` counts."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in (1, 2, 3, 4):
        counts = four.sum(axis=tuple(range(4 - order)))
        p = (counts + weight * p) / (counts.sum(-1, keepdims=True) + weight)
    return np.log(p).reshape(SYMBOLS**3, SYMBOLS).astype(np.float32)


def _symbol(letter: str) -> int:
    return int(_SYMBOL[letter.encode()[-1]])


def _readings(text: str, at: int) -> list[tuple[str, float]]:
    """What the character may stand for, with the channel's log probability; a boundary is a blank."""
    c = text[at]
    if c.isalpha():
        repeated = at and text[at - 1] == c
        return [(c, KEPT if repeated else 0.0), *([("", DROPPED)] if repeated else [])]
    options = [(letter, SWAPPED) for letter in LOOKS_LIKE.get(c, "")]
    if not c.isdigit():
        options.append(("", DROPPED))
    return [*options, (" ", BROKEN)]


@lru_cache(maxsize=8192)
def _options(c: str, repeated: bool, letter: bool) -> tuple[tuple[str, float, int], ...]:
    """``_readings`` of a character with their symbols, -1 for none; those that are letters alone if it has to be one."""
    readings = _readings(c + c if repeated else c, int(repeated))
    return tuple((r, cost, _symbol(r) if r else -1) for r, cost in readings if not letter or c not in LOOKS_LIKE or r.strip())


def decode(text: str, logs: np.ndarray, letters_from: int | None = None) -> str:
    """The most likely reading of a lower-cased text, by Viterbi over the last three symbols.

    What looks like a letter is one from ``letters_from`` on; without it, it may be none anywhere.
    Equally likely readings: the first in the order of the text of the reading.
    """
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    rows = memoryview(logs)
    for at, c in enumerate(text):
        following: dict[int, tuple[float, tuple]] = {}
        options = _options(c, at > 0 and text[at - 1] == c, letters_from is not None and at >= letters_from)
        for state, (score, path) in best.items():
            for reading, cost, symbol in options:
                if symbol < 0 or (symbol == 0 and state % SYMBOLS == 0):
                    to, total, way = state, score + cost, path
                else:
                    to = (state * SYMBOLS + symbol) % SYMBOLS**3
                    total, way = score + cost + rows[state, symbol], (path, reading)
                if to not in following or total > following[to][0]:
                    following[to] = (total, way)
        best = following
    state, (_, path) = max(best.items(), key=lambda x: (x[1][0] + rows[x[0], 0], -x[0]))
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def cores(token: str) -> list[str]:
    """The token without punctuation around it: at its end also without other symbols that look like letters, and without a
    run of currency signs after a word. Every end is looked at character by character, so long tokens cost their length."""
    start, end = 0, len(token)
    while start < end and not (_is_word(token[start]) or token[start] in LOOKS_LIKE):
        start += 1
    longest = end
    while longest > start and not (_is_word(token[longest - 1]) or token[longest - 1] in LOOKS_LIKE):
        longest -= 1
    while end > start and not (_is_word(token[end - 1]) or token[end - 1] in _CURRENCY):
        end -= 1
    before = end
    while before > start and token[before - 1] in _CURRENCY:
        before -= 1
    bare = before if end - before > 1 and before > start and _is_word(token[before - 1]) else end
    return [token[start:longest], token[start:end], token[start:bare]]


def is_traced(text: str) -> bool:
    """Whether the text may be disguised: a look-alike, a letter twice in a row, or letters beside anything else."""
    return bool(_DISGUISE.search(text)) or bool(_LETTER.search(text) and _OTHER.search(text))


def head(stem: str) -> str:
    """What a word, with its end marked, has in common with all its stems."""
    return stem[:3]


def heads_of(word: str) -> set[str]:
    """The heads of all readings of a word of letters, in which every repeated letter may stand or not."""
    found = {""}
    for letter, run in groupby(word + "$"):
        most = min(3, sum(1 for _ in run))
        found = {x if len(x) == 3 else head(x + n * letter) for x in found for n in range(1, most + 1)}
        if all(len(x) == 3 for x in found):
            break
    return found


class Reader:
    """The words of texts after restoring disguised ones; what a token's words become is remembered.

    ``known``: the stems that count. A word of letters none of whose readings can have one of them is not
    restored and means nothing. Without it every word counts.
    """

    def __init__(self, logs: np.ndarray, meaning: Callable[[str], Iterable], known: Iterable[str] | None = None) -> None:
        self._logs, self._meaning = logs, meaning
        self._heads = None if known is None else frozenset(map(head, known))
        # a reading of a word of letters begins as the word does
        self._firsts = frozenset(x[0] for x in self._heads or ())
        # what was met lately, and before that
        self._known: dict[str, tuple] = {}
        self._older: dict[str, tuple] = {}

    def words_of(self, token: str) -> list[str]:
        words = WORDS.findall(token)
        *longer, core = (token,) if token.isalpha() else cores(token)
        # symbols at the end are read as none, and as letters
        for text in dict.fromkeys([core, *longer]):
            if is_traced(text):
                words += [w for w in WORDS.findall(decode(text, self._logs, len(core))) if w not in words]
        return words

    def _met_first(self, token: str) -> tuple:
        plain = _PLAIN.fullmatch(token)
        if plain:
            word = plain[1]
            if self._heads is not None and word[0] not in self._firsts and word.isalpha():
                return ()
            if not _TWICE.search(word):
                # the word is its only reading
                return () if self._heads is not None and head(word + "$") not in self._heads else tuple(self._meaning(word))
            if self._heads is not None and word.isalpha() and self._heads.isdisjoint(heads_of(word)):
                return ()
        return tuple(x for word in self.words_of(token) for x in self._meaning(word))

    def _of_token(self, token: str) -> tuple:
        found = self._known.get(token)
        if found is not None:
            return found
        found = self._older.get(token)
        if found is None:
            found = self._met_first(token)
        if len(self._known) >= MOST_TOKENS:
            self._older, self._known = self._known, {}
        if len(token) < 100:
            self._known[token] = found
        return found

    def read(self, text: str) -> tuple[int, list]:
        """The number of tokens, and what all words mean, one by one; letters spaced out are also read together."""
        text = text.lower()
        tokens = text.split()
        meanings = list(map(self._known.get, tokens))
        if None in meanings:
            meanings = [self._of_token(token) if own is None else own for token, own in zip(tokens, meanings, strict=True)]
        found = [x for own in meanings if own for x in own]
        if _SPACED.search(text):
            for run in re.finditer("1{3,}", "".join(["1" if len(t) == 1 else "0" for t in tokens])):
                for word in WORDS.findall(decode(" ".join(tokens[run.start() : run.end()]), self._logs)):
                    found += self._meaning(word)
        return len(tokens), found


def stems(word: str) -> list[str]:
    """The word as a whole and its beginnings of 3 to 8 letters."""
    return [word + "$", *(word[:n] for n in range(3, min(8, len(word)) + 1))]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    curve: tuple[float, ...]

    def evidence(self, word: str) -> tuple[tuple[str, float], ...]:
        """The word's strongest stem with its weight, if it has one."""
        known = [(self.weights[s], s) for s in stems(word) if s in self.weights]
        return ((max(known)[1], max(known)[0]),) if known else ()

    def score(self, points: tuple[float, ...]) -> float:
        x = sum(a * b for a, b in zip(self.curve, points, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def points(size: int, found: list[tuple[str, float]]) -> tuple[float, ...]:
    """What the curve sees of a text: the weights of its different stems, the weight per hundred words, and 1."""
    different = math.fsum(dict(found).values())
    return different, 100 * math.fsum(w for _, w in found) / (size + 10), 1.0


def _read_rows(frame: DataFrame, sent, schema: str, make: Callable) -> DataFrame:
    """``make(reader's words, rows)`` over batches of (text, *others): a generator of record batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from handed_back(make(sent.value, with_rows(batches)))

    return frame.mapInArrow(run, schema)


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two minima over the hashes of five words in a row, by which near copies meet; of all words of a short text."""
    out = np.zeros((2, len(column)), np.int64)
    for block in blocks(column):
        words, sizes = word_hashes(block)
        for i, (end, size) in enumerate(zip(np.cumsum(sizes), sizes, strict=True)):
            own = words[end - size : end]
            if size:
                n = min(5, size)
                runs = mix(sum(mix(own[k : size - n + 1 + k] + np.uint64(k)) for k in range(n)))
                out[:, block.first + i] = [int(mix(runs ^ np.uint64(seed)).min() >> np.uint64(1)) for seed in (0x1234567, 0x89ABCDE)]
    return out[0], out[1]


def learn(docs: DataFrame, labels: DataFrame, labelled: Column, logs: np.ndarray, settings: Settings = Settings()) -> Model:
    """Stems that tell toxic documents, with log odds as weights, and a logistic curve from their sums to a score.

    Of the rows of ``labels`` for which ``labelled`` holds, a sample of bounded size is joined to the documents;
    a document with several labels counts as toxic if one says so. Near copies count once: they would make all
    their words look telling. No toxic documents give a model whose score is the share of toxic ones.
    """
    own = labels.where(labelled & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = own.count()
    if total > settings.sample:
        own = own.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < int(2**62 * settings.sample / total))
    # no more rows than the sample
    sample = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "doc_id", F.col("toxic").cast("int").alias("toxic"))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(logs)

    def sketch(logs, batches):
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b = _sketches(batch.column(0))
            yield record_batch({"doc_id": batch.column(1), "toxic": batch.column(2), "a": a, "b": b}, schema)

    drawn = _read_rows(sample, sent, "doc_id long, toxic int, a long, b long", sketch).toPandas().sort_values("doc_id")
    single = drawn[~drawn.duplicated(["toxic", "a"]) & ~drawn.duplicated(["toxic", "b"])]
    ids, toxic = set(single["doc_id"]), int((single["toxic"] > 0).sum())
    clean = len(single) - toxic
    share = (toxic + 0.5) / (len(single) + 1)
    prior = Model({}, (0.0, 0.0, math.log(share / (1 - share))))
    if not toxic:
        return prior

    def counts(wanted: int, only) -> Callable:
        def make(logs, batches):
            reader = Reader(logs, stems, only)
            sums: Counter = Counter()

            def counted() -> pa.RecordBatch:
                return record_batch({"stem": list(sums), "n": list(sums.values())}, pa.schema([("stem", pa.string()), ("n", pa.int64())]))

            for batch in batches:
                for text, doc_id, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if doc_id in ids and (label > 0) == bool(wanted):
                        found = set(reader.read(text or "")[1])
                        sums.update(found if only is None else found & only)
                        if len(sums) > MOST_COUNTS:
                            yield counted()
                            sums.clear()
            if sums:
                yield counted()

        return make

    def counted(wanted: int, only=None) -> DataFrame:
        return _read_rows(sample, sent, "stem string, n long", counts(wanted, only)).groupBy("stem").agg(F.sum("n").alias("n"))

    common = counted(1).where(F.col("n") >= settings.least).orderBy(F.desc("n"), "stem").limit(4 * settings.stems)
    in_toxic = {r.stem: r.n for r in common.collect()}
    if not in_toxic:
        return prior
    in_clean = {r.stem: r.n for r in counted(0, set(in_toxic)).collect()}
    rated = []
    for stem, n in in_toxic.items():
        m = in_clean.get(stem, 0)
        odds = math.log((n + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (clean + 1))
        ratio = 2 * (n * math.log(n / ((n + m) * toxic / len(single))) + (m * math.log(m / ((n + m) * clean / len(single))) if m else 0))
        if odds > 1 and ratio >= settings.sure:
            rated.append((ratio, stem, min(odds, 8.0)))
    weights = {stem: odds for _, stem, odds in sorted(rated, reverse=True)[: settings.stems]}
    model = Model(weights, ())

    def seen(logs, batches):
        reader = Reader(logs, model.evidence, model.weights)
        schema = pa.schema([("toxic", pa.int32()), *((f"p{i}", pa.float64()) for i in range(3))])
        for batch in batches:
            p = [points(*reader.read(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array([x[i] for x in p], pa.float64()) for i in range(3))], schema=schema)

    fit = _read_rows(sample, sent, "toxic int, p0 double, p1 double, p2 double", seen).toPandas()
    return Model(weights, curve(fit[[f"p{i}" for i in range(3)]].to_numpy(float), fit["toxic"].to_numpy() > 0))


def curve(a: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, ...]:
    """Logistic coefficients, by Newton steps with a small ridge on scaled columns."""
    scale = np.maximum(1.0, np.abs(a).max(axis=0, initial=1.0))
    a = a / scale
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) / len(a) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a / len(a) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return tuple(float(x) for x in w / scale)


def predict(docs: DataFrame, logs: np.ndarray, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and the columns in ``keep`` for every row; null and empty texts have the score of no words.

    ``keep`` may name any column but doc_id, score and predicted, the text too.
    """
    if clash := {"doc_id", "score", "predicted"} & set(keep):
        raise ValueError(f"rename {sorted(clash)} first")
    sent = docs.sparkSession.sparkContext.broadcast((logs, model))
    # the text goes to the tasks once, kept or not
    others = [c for c in keep if c != "text"]
    columns = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"keep_{c}") for c in others))
    kept = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] if keep else []
    place = [0 if c == "text" else 2 + others.index(c) for c in keep]

    def make(own, batches):
        reader = Reader(own[0], own[1].evidence, own[1].weights)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                scores = pa.array([own[1].score(points(*reader.read(t.as_py() or ""))) for t in part.column(0)], pa.float64())
                predicted = pc.cast(pc.greater_equal(scores, 0.5), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(1), scores, predicted, *(part.column(i) for i in place)], names=["doc_id", "score", "predicted", *keep])

    return _read_rows(columns, sent, ", ".join(["doc_id long", "score double", "predicted int", *kept]), make)


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, Model]:
    """Both models; labels count where crc32(doc_id as text) mod 5 is not 0."""
    logs = letter_model(docs)
    return logs, learn(docs, labels, F.coalesce(fold_of("doc_id", 5) != 0, F.lit(False)), logs, settings)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    found = predict(docs, *fitted(docs, labels, settings))
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")

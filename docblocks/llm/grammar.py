"""Op 6: toxicity by a weighted finite-state pattern grammar.

Words become symbols; small machines for targets, copulas, epithets, objects, further insults, negation,
reported speech and quotation are composed into one machine that reads a clause forwards and one that reads it
backwards (a bimachine), so that a match is weighed by what stands on both sides of it. Every
state of a machine has a frame weight for insults, one for threats, and a factor; composition takes
the greatest frame weight and multiplies the factors.

* An insult matches in a frame only: a target near it on either side, a copula before it, a
  determiner or preposition right before it, or another insult near it. A word by itself weighs nothing.
* A threat matches with an object: a pronoun after it that can be one, or before it one that can
  only be one (verb-final clauses). A subject is no object.
* Negation within reach, a verb of saying (before, or shortly after) and quotation marks lower the weight.
* Insults of a text without a frame count for less, and only if the text has two or more insults.

Words are labels of arcs: fixed lists, and stems that labelled training rows teach, word beginnings
that are far more frequent in toxic texts than in others (by a G statistic). They are counted on the
executors over a bounded sample, MAX_TOXIC and MAX_CLEAN rows, the first by a hash of the id, and at
most MAX_STEMS of them reach the driver. Two numbers calibrate the score on the same sample. Scoring
covers every row and whole texts.

Results for odd inputs: null and empty texts match nothing and get the least score; without labelled
rows, the fixed words alone decide; ties and repeated rows score alike; of rows that share an id, the
sample takes one; an empty table gives no rows; further columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, U64, chunks, mix, prefix_sums, span_hashes
from .pulearn import first_ids
from .tables import clear, shared_folder, stored, unused

MAX_TOXIC = 3000
MAX_CLEAN = 9000
MAX_STEMS = 20_000
#: Lengths in bytes of the word beginnings that can be stems.
STEMS = tuple(range(3, 13))
LEAST_G = 16.0
LEAST_PRECISION = 0.6

# Fixed word lists, lower case.
INSULTS = "idiot idiots moron morons stupid trash scum loser losers clown pathetic worthless disgusting dumb imbecile idiota idiotas imbécil estúpido estúpida basura escoria idiote imbécile débile crétin crétine ordure idiotin dumm trottel abschaum versager".split()
THREATS = "kill hurt destroy murder hang shoot beat töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
SUBJECTS = "he she they i we your his their these those people er du tu il elle ils elles él ella ellos ellas usted ustedes vosotros".split()
OBJECTS = "him them dich dir euch ihn ihm ihnen te toi leur lui os le les".split()
PERSONS = "you her sie ihr vous nous".split()
COPULAS = "is are was were am be been being 're 's bist ist sind seid war waren est es sont était suis êtes eres soy son era fue".split()
LINKS = "a an the of such what with to in and or by for ein eine einen der die das den dem von mit so und un une le la les de du des quel quelle et una el los las del qué tan y con".split()
NEGATIONS = "not never no none without isn't aren't wasn't don't nicht nie kein keine keinen pas jamais sans aucun nunca ningún sin".split()
REPORTS = "said says told wrote claimed called quoted reported sagte schrieb behauptete dit écrit affirme appelé dijo escribió afirma llamó".split()

OTHER, INSULT, THREAT, SUBJECT, OBJECT, PERSON, COPULA, LINK, NEGATION, REPORT, QUOTE = range(11)
TARGETS = (SUBJECT, OBJECT, PERSON)
#: Weight of an insult without a frame in a text that has others.
UNFRAMED = 0.5


class Machine:
    """Deterministic machine with weighted states: ``step[state]`` maps symbols to states (others lead to
    ``default[state]``), ``out[state]`` is (frame weight of an insult, of a threat, factor) for a match read in that state."""

    def __init__(self, step: list[dict[int, int]], default: list[int], out: list[tuple[float, float, float]]):
        self.step, self.default, self.out = step, default, out

    def arc(self, state: int, symbol: int) -> int:
        return self.step[state].get(symbol, self.default[state])


def near(symbols: tuple[int, ...], reach: int, insult: float = 0.0, threat: float = 0.0, factor: float = 1.0) -> Machine:
    """What one of the symbols does to a match that is at most ``reach`` words further on."""
    steps = [dict.fromkeys(symbols, reach) for _ in range(reach + 1)]
    return Machine(steps, [0, *range(reach)], [(0.0, 0.0, 1.0), *[(insult, threat, factor)] * reach])


def since(symbol: int, factor: float) -> Machine:
    """What a symbol does to all matches after it in the clause."""
    return Machine([{symbol: 1}, {}], [0, 1], [(0.0, 0.0, 1.0), (0.0, 0.0, factor)])


def between(symbol: int, factor: float) -> Machine:
    """What a pair of symbols does to the matches inside."""
    return Machine([{symbol: 1}, {symbol: 0}], [0, 1], [(0.0, 0.0, 1.0), (0.0, 0.0, factor)])


class Composed:
    """Machines that read the same symbols: a state has one of each. States are found as they are reached."""

    def __init__(self, *machines: Machine):
        self.machines = machines
        self.index = {(0,) * len(machines): 0}
        self.states = [(0,) * len(machines)]
        self.out = [self._weigh(self.states[0])]
        self.arcs: dict[tuple[int, int], int] = {}

    def _weigh(self, state: tuple[int, ...]) -> tuple[float, float, float]:
        insult, threat, factor = 0.0, 0.0, 1.0
        for m, s in zip(self.machines, state, strict=True):
            a, b, f = m.out[s]
            insult, threat, factor = max(insult, a), max(threat, b), factor * f
        return insult, threat, factor

    def arc(self, state: int, symbol: int) -> int:
        to = self.arcs.get((state, symbol))
        if to is None:
            reached = tuple(m.arc(s, symbol) for m, s in zip(self.machines, self.states[state], strict=True))
            to = self.index.setdefault(reached, len(self.states))
            if to == len(self.states):
                self.states.append(reached)
                self.out.append(self._weigh(reached))
            self.arcs[state, symbol] = to
        return to

    def read(self, symbols: list[int]) -> list[tuple[float, float, float]]:
        """The weights of the state before each symbol."""
        state, out = 0, []
        for s in symbols:
            out.append(self.out[state])
            state = self.arc(state, s)
        return out


FORWARD = Composed(
    near(TARGETS, 4, insult=1.3),
    near((COPULA,), 3, insult=1.0),
    near((LINK,), 1, insult=0.7),
    near((INSULT,), 3, insult=0.7),
    near((OBJECT,), 4, threat=1.3),
    near((NEGATION,), 3, factor=0.35),
    since(REPORT, 0.5),
    between(QUOTE, 0.6),
)
BACKWARD = Composed(
    near(TARGETS, 3, insult=1.3),
    near((INSULT,), 3, insult=0.7),
    near((OBJECT, PERSON), 3, threat=1.3),
    near((NEGATION,), 2, factor=0.5),
    near((REPORT,), 4, factor=0.5),
)


def clause_weights(symbols: list[int], weights: list[float]) -> tuple[float, int, float]:
    """(weight of the framed matches, number of insults, weight of the insults without a frame) of a clause."""
    total, insults, bare = 0.0, 0, 0.0
    ahead = FORWARD.read(symbols)
    behind = BACKWARD.read(symbols[::-1])[::-1]
    for s, w, (i, t, f), (j, u, g) in zip(symbols, weights, ahead, behind, strict=True):
        if s == INSULT:
            frame = max(i, j)
            insults += 1
            total += w * frame * f * g
            bare += 0.0 if frame else w * f * g
        elif s == THREAT:
            total += w * max(t, u) * f * g
    return total, insults, bare


def _word_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[ord("a") : ord("z") + 1] = True
    table[0x80:] = True
    table[ord("'")] = True
    return table


IN_WORD = _word_table()
ENDS_CLAUSE = np.zeros(256, dtype=bool)
ENDS_CLAUSE[list(b".!?;\n")] = True


class LetterWords:
    """Runs of letters of lower-cased texts, with their rows and byte places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        solid = IN_WORD[self.data]
        after = np.append(self.data[1:], 0)
        mark = np.flatnonzero((self.data == 0xE2) & ((after == 0x80) | (after == 0x81)))  # U+2000 to U+207F
        low = np.flatnonzero(self.data == 0xC2)  # U+0080 to U+00BF
        for at, width in ((mark, 3), (low, 2)):
            for k in range(width):
                solid[np.minimum(at + k, len(solid) - 1)] = False
        third = self.data[np.minimum(mark + 2, len(data) - 1)]
        second = self.data[np.minimum(low + 1, len(data) - 1)]
        quotes = [np.flatnonzero(self.data == 0x22), mark[(third >= 0x9C) & (third <= 0x9F) & (after[mark] == 0x80)], low[(second == 0xAB) | (second == 0xBB)]]
        self.quotes = np.sort(np.concatenate(quotes))
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[:-1] += solid
        edge[1:] -= solid
        opens, closes = edge == 1, edge == -1
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        joined = cuts[solid[cuts] & solid[cuts - 1]] if len(cuts) else cuts
        opens[joined] = True
        closes[joined] = True
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.sums = prefix_sums(self.data)

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(words at least so long, hashes of their first bytes); length 0: whole words."""
        if not length:
            return np.arange(len(self.starts)), span_hashes(self.sums, self.starts, self.ends)
        at = np.flatnonzero(self.ends - self.starts >= length)
        return at, span_hashes(self.sums, self.starts[at], self.starts[at] + length)


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(prefix_sums(data), ends - np.array([len(w) for w in raw]), ends)


@dataclass
class Lexicon:
    """Whole words with their symbol and stems by length, all as sorted hashes; ``scale`` and ``shift`` calibrate."""

    stems: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    scale: float = 3.0
    shift: float = -3.5

    def __post_init__(self) -> None:
        pairs: dict[str, int] = {}
        # a word of two lists has the symbol of the later one
        for symbol, words in ((LINK, LINKS), (SUBJECT, SUBJECTS), (OBJECT, OBJECTS), (PERSON, PERSONS), (COPULA, COPULAS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS), (INSULT, INSULTS)):
            pairs |= dict.fromkeys(words, symbol)
        hashes = _hash_words(list(pairs))
        order = np.argsort(hashes)
        self.words = hashes[order]
        self.symbols = np.array(list(pairs.values()), dtype=np.int8)[order]

    def matched(self, words: LetterWords) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, weight) of every word."""
        symbol = np.zeros(len(words.starts), dtype=np.int8)
        weight = np.zeros(len(words.starts))
        for length, (stems, weights) in self.stems.items():
            at, hashes = words.prefixes(length)
            place = np.minimum(np.searchsorted(stems, hashes), len(stems) - 1)
            hit = stems[place] == hashes
            weight[at[hit]] = np.maximum(weight[at[hit]], weights[place[hit]])
            symbol[at[hit]] = INSULT
        _, hashes = words.prefixes(0)
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[place] == hashes
        named = hit & ((symbol == OTHER) | (self.symbols[place] == INSULT))
        symbol[named] = self.symbols[place[named]]
        weight[named] = np.maximum(weight[named], 1.0)
        return symbol, weight


def raw_scores(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Weight of the matched clauses of each text."""
    words = LetterWords(data, offsets)
    symbol, weight = lexicon.matched(words)
    rows = len(offsets) - 1
    total, insults, bare = np.zeros(rows), np.zeros(rows, dtype=np.int64), np.zeros(rows)
    at = np.searchsorted(words.starts, words.quotes)
    symbol, weight = np.insert(symbol, at, QUOTE), np.insert(weight, at, 0.0)
    place = np.insert(words.starts, at, words.quotes)
    row = np.searchsorted(offsets, place, side="right") - 1
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(hits):
        return total
    clause = np.searchsorted(np.flatnonzero(ENDS_CLAUSE[words.data]), place) + (row << 40)
    for first in np.unique(np.searchsorted(clause, clause[hits], side="left")).tolist():
        last = int(np.searchsorted(clause, clause[first], side="right"))
        got, n, loose = clause_weights(symbol[first:last].tolist(), weight[first:last].tolist())
        r = row[first]
        total[r] += got
        insults[r] += n
        bare[r] += loose
    return total + np.where(insults > 1, UNFRAMED * bare, 0.0)


_COUNTS = "size int, stem long, toxic long, clean long"


def _stem_counts(rows: DataFrame) -> DataFrame:
    """(size, stem, toxic, clean): in how many texts of (text, y) of either label each word beginning occurs, before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in chunks(batch.column(0)):
                words, label = LetterWords(data, offsets), y[first:end]
                for k in STEMS:
                    at, hashes = words.prefixes(k)
                    once = np.unique(hashes ^ mix(words.row[at].astype(U64)), return_index=True)[1]
                    values, which = np.unique(hashes[once], return_inverse=True)
                    bad = np.bincount(which, weights=label[words.row[at[once]]], minlength=len(values)).astype(np.int64)
                    every = np.bincount(which, minlength=len(values))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, dtype=np.int32)), pa.array(values.view(np.int64)), pa.array(bad), pa.array(every - bad)], ["size", "stem", "toxic", "clean"])

    return rows.mapInArrow(run, _COUNTS)


def mine_stems(rows: DataFrame, n_toxic: int, n_clean: int, most: int = MAX_STEMS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Word beginnings that labelled texts (text, y) show to be toxic: by length, sorted hashes and weights from 0 to 1."""
    if not n_toxic or not n_clean:
        return {}
    a, b = F.col("toxic"), F.col("clean")
    rate = (a + b) / (n_toxic + n_clean)
    part = lambda n, total: F.when(n > 0, n * F.log(n / (rate * total))).otherwise(0.0)
    lift = (a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1))
    counts = _stem_counts(rows).groupBy("size", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counts.where((2 * (part(a, n_toxic) + part(b, n_clean)) >= LEAST_G) & (a / (a + b) >= LEAST_PRECISION) & (lift > 8))
    found: dict[int, list[tuple[int, float]]] = {}
    for size, stem, value in good.select("size", "stem", lift.alias("lift")).orderBy(F.desc("lift"), "size", "stem").limit(most).collect():
        found.setdefault(size, []).append((stem, value))
    out = {}
    for size, pairs in found.items():
        stems = np.array([p[0] for p in pairs], dtype=np.int64).view(U64)
        order = np.argsort(stems)
        out[size] = stems[order], np.clip(np.log(np.array([p[1] for p in pairs])) / np.log(2000), 0.1, 1.0)[order] ** 1.5
    return out


def calibrate(lexicon: Lexicon, raw: np.ndarray, toxic: np.ndarray) -> Lexicon:
    """Scale and shift by a regularised logistic fit of the raw scores."""
    if not toxic.any() or toxic.all():
        return lexicon
    x, y = np.log1p(raw), toxic.astype(float)
    w, b = 3.0, -3.0
    for _ in range(200):  # Newton with a ridge towards the start
        p = 1 / (1 + np.exp(-(w * x + b)))
        s = p * (1 - p) + 1e-6
        gw, gb = ((p - y) * x).sum() + 0.5 * (w - 3), (p - y).sum() + 0.5 * (b + 3)
        h = np.array([[(s * x * x).sum() + 0.5, (s * x).sum()], [(s * x).sum(), s.sum() + 0.5]])
        dw, db = np.linalg.solve(h, [gw, gb])
        w, b = w - dw, b - db
        if abs(dw) + abs(db) < 1e-8:
            break
    lexicon.scale, lexicon.shift = float(max(w, 0.5)), float(b)
    return lexicon


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """Fit on bounded samples of the labelled rows; ``labels`` holds the ids and labels that may be learnt from.

    The texts of the sample are stored in the shared folder; stems and one number a row reach the driver.
    """
    toxic = first_ids(labels.where(F.col(label_col) == 1), id_col, max_toxic).withColumn("y", F.lit(True))
    clean = first_ids(labels.where(F.col(label_col) == 0), id_col, max_clean).withColumn("y", F.lit(False))
    wanted = F.broadcast(toxic.unionByName(clean).groupBy("__id").agg(F.max("y").alias("y")))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(wanted, F.col("__doc") == F.col("__id"))
    rows = rows.groupBy("__id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = stored(rows, folder, "sample", "zstd")
    n = rows.agg(F.count_if("y"), F.count_if(~F.col("y"))).first()
    lexicon = Lexicon(mine_stems(rows, int(n[0]), int(n[1])))
    scored = _raw(rows, "text", lexicon).select("raw", "y").collect()  # MAX_TOXIC + MAX_CLEAN numbers at most
    clear(spark, [folder])
    return calibrate(lexicon, np.array([r[0] for r in scored], dtype=float), np.array([r[1] for r in scored], dtype=bool))


def _raw(docs: DataFrame, text_col: str, lexicon: Lexicon, name: str = "raw") -> DataFrame:
    """All columns of ``docs``, then the weight of the matched clauses."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {name} double"
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(where)):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw_scores(data, at, lexicon))], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then score (with underscores behind where that name is taken)."""
    name = unused("score", docs.columns)
    raw = F.col(name)
    return _raw(docs, text_col, lexicon, name).withColumn(name, 1 / (1 + F.exp(-(F.lit(lexicon.scale) * F.log1p(raw) + F.lit(lexicon.shift)))))

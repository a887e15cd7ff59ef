"""Toxicity by a weighted finite-state clause grammar.

A text becomes a string of word classes, clause by clause. One transducer
reads a clause from right to left and rewrites every match that a target
follows; the others read the result from left to right, and their composition
is one machine whose arcs carry marks and a weight (the product of the parts'):

* insult: a word of the lexicon, with more weight where a target follows,
* target: an insult that a target precedes weighs more,
* threat: a violent verb counts with a target on either side of it,
* negation: a negator shortly before takes most of the weight away,
* reported speech: what follows a verb of saying or stands in quotes weighs less.

A match's value is its word's weight times its arc's. A clause's values go into
one sum per reading (plain, directed, threat, negated, reported), and a logistic
model over these sums gives the score. The insult lexicon, with whole words and
word beginnings, and the logistic model are learned from labelled rows; nothing
but the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import folded, unfolded
from pointweave.session import cut

#: labelled rows that are learned from, at most; a repeatable choice by hash
TRAINING_ROWS = 20_000
#: a term needs so many toxic documents, and this lower bound of its log-odds ratio
MIN_TOXIC, MIN_LOG_ODDS = 5, 1.5
PREFIXES = (4, 5, 6, 7, 8)

# Word classes that the grammar reads, in the corpus's languages, with their inflections.
TARGETS = frozenset(
    "you your yours yourself yourselves u ur he she they them him her his their people you're you've you'll you'd they're he's she's "
    "du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos t'es tú ti usted ustedes vosotros vuestro vuestra".split()
)
NEGATORS = frozenset(
    "not no never nobody nothing none neither cannot nicht kein keine keinen keiner nie niemals niemand ne pas jamais aucun aucune nunca jamás tampoco nadie".split()
)
SAYING = frozenset(
    "said says say saying told tells claimed claims reported reports wrote writes quoted quotes alleged called calls shouted yelled "
    "sagte sagt sagten behauptet behauptete schrieb schreibt nannte rief dit disait disent écrit déclara traité dijo dice decía afirmó escribió llamó".split()
)
THREATS = frozenset(
    "kill kills killing killed hurt hurts hurting destroy destroys destroying destroyed beat beats beating punch punches punching shoot shoots shooting "
    "stab stabs stabbing burn burns burning murder murders murdering attack attacks attacking strangle strangles strangling choke chokes choking smash smashes smashing "
    "töten töte tötet schlagen schlage schlägt verprügeln verprügle verletzen verletze verletzt erwürgen erwürge umbringen "
    "tuer tuerai tuera tuez frapper frappe frapperai étrangler détruire détruirai matar mato mata mataré matará golpear golpeo golpearé destruir destruiré".split()
)
QUOTES = frozenset('"«»“”„')

#: reach of a negator and of a target in words, and the weights of the arcs
NEGATION_REACH, TARGET_REACH, THREAT_REACH = 3, 6, 12
DIRECTED, NEGATED, SAID, QUOTED = 1.5, 0.2, 0.4, 0.5
#: weight of a threat's verb where the lexicon gives no larger one
THREAT_WEIGHT = 2.0

WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
PIECES = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"«»“”„]|[.!?;:\n]+")
READINGS = ("plain", "directed", "threat", "negated", "reported")
FEATURES = (*READINGS, "clauses", "density")

# symbols of the grammar; the last two are made by ``target_ahead``
OTHER, INSULT, TARGET, NEGATOR, SAY, THREAT, QUOTE, INSULT_AHEAD, THREAT_AHEAD = range(9)
SYMBOLS = range(9)
INSULTS, THREATENING = (INSULT, INSULT_AHEAD), (THREAT, THREAT_AHEAD)
MATCHES = (*INSULTS, *THREATENING)
NO_MARKS: frozenset = frozenset()


def lowered(text: str) -> str:
    """Lower case, with one form of apostrophe."""
    return text.lower().replace("’", "'")


@dataclass(frozen=True)
class Transducer:
    """Deterministic over SYMBOLS; arcs: (state, symbol) -> (state, marks, weight of the match just read)."""

    arcs: dict = field(hash=False)
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, NO_MARKS, 1.0))


def _within(mark: str, weight: float, opener: int, reach: int, matches: tuple[int, ...]) -> Transducer:
    """Marks and weighs ``matches`` that follow ``opener`` by at most ``reach`` symbols; state: symbols left."""
    arcs = {}
    for left in range(reach + 1):
        for s in SYMBOLS:
            after = reach if s == opener else max(0, left - 1)
            arcs[left, s] = (after, frozenset({mark}), weight) if left and s in matches else (after, NO_MARKS, 1.0)
    return Transducer(arcs)


def _after(mark: str, weight: float, opener: int, closes: bool) -> Transducer:
    """Marks and weighs all matches after ``opener``; a second opener closes where ``closes``."""
    arcs = {(0, opener): (1, NO_MARKS, 1.0), (1, opener): (0 if closes else 1, NO_MARKS, 1.0)}
    return Transducer(arcs | {(1, s): (1, frozenset({mark}), weight) for s in MATCHES})


def target_ahead() -> list[list[tuple[int, int]]]:
    """Read from right to left: (next state, rewritten symbol) by state and symbol; state: words since the last target, or the largest."""
    far = THREAT_REACH + 1
    table = []
    for since in range(far + 1):
        row = []
        for s in SYMBOLS:
            made = INSULT_AHEAD if s == INSULT and since <= TARGET_REACH else THREAT_AHEAD if s == THREAT and since <= THREAT_REACH else s
            row.append((1 if s == TARGET else min(far, since + 1), made))
        table.append(row)
    return table


def grammar() -> Transducer:
    """The composition of the transducers that read from left to right."""
    insult = Transducer({(0, INSULT): (0, NO_MARKS, 1.0), (0, INSULT_AHEAD): (0, frozenset({"directed"}), DIRECTED)})
    target = _within("directed", DIRECTED, TARGET, TARGET_REACH, (INSULT,))
    threat = _within("threat", DIRECTED, TARGET, THREAT_REACH, (THREAT,))
    ahead = Transducer({(0, THREAT_AHEAD): (0, frozenset({"threat"}), DIRECTED)})
    negation = _within("negated", NEGATED, NEGATOR, NEGATION_REACH, MATCHES)
    saying, quotes = _after("reported", SAID, SAY, False), _after("reported", QUOTED, QUOTE, True)
    return reduce(compose, (insult, target, threat, ahead, negation, saying, quotes))


def compose(left: Transducer, right: Transducer) -> Transducer:
    """Product machine over the states that can be reached: marks are united, weights multiplied."""
    start = (left.start, right.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        at = todo.pop()
        for s in SYMBOLS:
            (a, marks, weight), (b, more, factor) = left.step(at[0], s), right.step(at[1], s)
            arcs[at, s] = ((a, b), marks | more, weight * factor)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(arcs, start)


def reading_of(marks: frozenset) -> str:
    """The sum that a match goes to: a negated or reported one is no threat and not directed."""
    return next((r for r in ("negated", "reported", "threat", "directed") if r in marks), "plain")


class Scorer:
    """Feature sums of a text under a lexicon of term -> weight (a term that ends with * is a word's beginning)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.ahead = target_ahead()
        machine = grammar()
        # the machine as plain lists of (next state, reading, weight, is a threat) by state and symbol
        states = {machine.start: 0}
        for (state, _), (after, *_) in machine.arcs.items():
            states.setdefault(state, len(states))
            states.setdefault(after, len(states))
        self.table = [[(0, "plain", 1.0, False)] * len(SYMBOLS) for _ in states]
        for (state, symbol), (after, marks, weight) in machine.arcs.items():
            self.table[states[state]][symbol] = (states[after], reading_of(marks), weight, "threat" in marks)
        self.words: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        if found is None:
            weight = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in PREFIXES if n < len(word))])
            kind = (
                THREAT if word in THREATS else INSULT if weight > 0 else TARGET if word in TARGETS
                else NEGATOR if word in NEGATORS or word.endswith("n't") else SAY if word in SAYING else OTHER
            )
            if len(self.words) > 500_000:  # only a memory of lookups
                self.words.clear()
            found = self.words[word] = (kind, weight)
        return found

    def matches(self, clause: list[str]) -> Iterator[tuple[str, str, float]]:
        """(word, reading, value) of a clause's matches. A violent verb without a target is worth what the lexicon says."""
        read = [(QUOTE, 0.0) if piece in QUOTES else self.symbol(piece) for piece in clause]
        symbols, since = [], len(self.ahead) - 1
        for kind, _ in reversed(read):
            since, made = self.ahead[since][kind]
            symbols.append(made)
        state = 0
        for piece, (kind, weight), made in zip(clause, read, reversed(symbols)):
            state, reading, factor, threat = self.table[state][made]
            if kind == INSULT:
                yield piece, reading, weight * factor
            elif kind == THREAT and (threat or weight > 0):
                yield piece, reading, (max(weight, THREAT_WEIGHT) if threat else weight) * factor

    def features(self, text: str) -> tuple[float, ...]:
        lower = lowered(text)
        own = set(WORDS.findall(lower))
        hits = {w for w in own if self.symbol(w)[0] in MATCHES}
        if not hits:
            return (0.0,) * len(FEATURES)
        sums, said, clauses, words, clause = dict.fromkeys(READINGS, 0.0), {}, 0, 0, []
        for piece in [*PIECES.findall(lower), "."]:
            if piece[0] not in ".!?;:\n":
                clause.append(piece)
                words += piece not in QUOTES
                continue
            if not hits.isdisjoint(clause):
                matched = False
                for word, reading, value in self.matches(clause):
                    # repeating one word adds less and less
                    said[word] = said.get(word, 0) + 1
                    sums[reading] += value / said[word]
                    matched = True
                clauses += matched
            clause = []
        return (*(math.log1p(sums[r]) for r in READINGS), math.log1p(clauses), math.log1p(1000.0 * sum(sums.values()) / max(words, 20)))


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: tuple[float, ...]
    bias: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ np.asarray(self.weights) + self.bias, -30, 30)))


def held_out(id_col: str | Column) -> Column:
    """True for the fifth of ids that nothing is learned from."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(text: str) -> set[str]:
    own = set(WORDS.findall(lowered(text)))
    return own | {w[:n] + "*" for w in own for n in PREFIXES if n < len(w)}


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out fold; a written table."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col).agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64(id_col), id_col).limit(rows)
    )
    # at most ``rows`` ids, so sending them to every executor is bounded
    joined = documents.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col)
    joined = joined.groupBy(id_col).agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))  # repeated rows count once
    return cut(joined.select("_text", F.col("_toxic").cast("int").alias("_toxic")), "toxic-training")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms of toxic rows whose log-odds ratio is surely above MIN_LOG_ODDS, with that lower bound as weight.

    Nothing but these two conditions cuts a term; the number of terms is bounded by the training rows.
    """
    def all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t for text in batch.column(0).to_pylist() for t in terms_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    sizes = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.where("_toxic = 1").select("_text").mapInArrow(all_terms, "term string").groupBy("term").count()
    candidates = {r.term: r["count"] for r in counted.where(f"count >= {MIN_TOXIC}").collect()}

    def known_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for t in terms_of(text) & candidates.keys():
                    counts[t] = counts.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    among_clean = rows.where("_toxic = 0").select("_text").mapInArrow(known_terms, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    clean_counts = {r.term: r.n for r in among_clean.collect()}
    found = {}
    for term, t in candidates.items():
        n = clean_counts.get(term, 0)
        parts = (t + 0.5, toxic - t + 0.5, n + 0.5, clean - n + 0.5)
        odds = math.log(parts[0]) - math.log(parts[1]) - math.log(parts[2]) + math.log(parts[3])
        low = odds - 1.64 * math.sqrt(sum(1 / p for p in parts))
        if low >= MIN_LOG_ODDS:
            found[term] = low
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method for a ridge-penalised logistic model; the bias is not penalised."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + penalty * w
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _feature_batches(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            rows = [scorer.features(t) for t in batch.column(0).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), batch.column(1)], names=[*FEATURES, "_toxic"])

    return run


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """Learns lexicon and weights. Without labelled rows of both kinds every text gets the share of toxic rows (or 0)."""
    sample = training_rows(documents, labels, id_col, text_col, rows)
    lexicon = learn_lexicon(sample)
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", _toxic int"
    # at most ``rows`` short feature vectors come to the driver
    got = np.array([tuple(r) for r in sample.select("_text", "_toxic").mapInArrow(_feature_batches(lexicon), schema).collect()], dtype=float)
    if not len(got) or len(set(got[:, -1])) < 2:
        share = float(got[:, -1].mean()) if len(got) else 0.0
        return Model(lexicon, (0.0,) * len(FEATURES), math.log((share + 1e-9) / (1 - share + 1e-9)))
    # equal vectors in any order give the same sums up to rounding; sorting makes reruns agree to the last bit
    got = got[np.lexsort(got.T)]
    weights, bias = logistic(got[:, :-1], got[:, -1])
    return Model(lexicon, tuple(map(float, weights)), bias)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``toxic_clauses``.

    Null and empty texts match nothing and get the score of a text without
    matches. Texts are read whole. Columns of ``df`` with these names give way;
    repeated rows are scored alike, an empty table gives no rows.
    """
    made = ("score", "predicted", "toxic_clauses")
    kept = [c for c in df.columns if c not in made]
    source = folded(df, F.coalesce(text_col, F.lit("")).alias("text"), columns=kept)
    schema = source.select("row").schema.add("score", "double").add("predicted", "integer").add("toxic_clauses", "integer")
    clauses = FEATURES.index("clauses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(p, pa.float64()),
                    pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                    pa.array(np.rint(np.expm1(x[:, clauses])).astype(np.int32), pa.int32()),
                ],
                names=["row", *made],
            )

    return source.mapInArrow(run, schema).select(*unfolded(kept), *made)

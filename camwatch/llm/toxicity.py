"""Toxicity: a weighted finite-state pattern grammar over the clauses of a text.

A lexical transducer maps words to symbols: insult (with a weight), threat, target,
negation, report, quote, other. Three small transducers are composed over these
symbols: reported speech and negation soften what follows them, and the clause
acceptor adds up insults and threats and raises those that meet a target. Only
matched clauses are scored; a word alone says nothing about the text around it. The
insults' weights and the scale of the clause scores are learned from labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that the grammar knows before it learns. Fixed values.
INSULTS = "idiot idiots moron morons stupid scum loser trash worthless pathetic disgusting clown imbecile dumb fool vermin filth".split()
THREATS = "kill hurt beat destroy shoot stab attack punish".split()
TARGETS = "you your yours yourself he him she her they them these those people everyone".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nobody neither without".split()
REPORTS = "said says claimed claims wrote writes reported reports quoted allegedly called".split()
SEED_WEIGHT = 2.0

#: Symbols of the grammar.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITYNRO"

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """States from 0; ``arcs[state, symbol]`` is (next state, output symbol, weight). A symbol without an arc passes unchanged."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The transducer that feeds ``first``'s output into ``second``; weights add."""
    names, queue, arcs = {(0, 0): 0}, [(0, 0)], {}
    for a, b in queue:
        for s in symbols:
            na, out, w = first.step(a, s)
            nb, out2, w2 = second.step(b, out)
            if (na, nb) not in names:
                names[na, nb] = len(names)
                queue.append((na, nb))
            arcs[names[a, b], s] = (names[na, nb], out2, w + w2)
    return Transducer(arcs)


#: Softened insults and threats are written in lower case from here on.
_ALL = "ITYNROit"


def reported_speech() -> Transducer:
    """After a reporting word, insults and threats up to the clause's end are someone else's."""
    return Transducer({(0, REPORT): (1, OTHER, 0.0), (1, INSULT): (1, "i", 0.0), (1, THREAT): (1, "t", 0.0), (1, REPORT): (1, OTHER, 0.0)})


def negation(reach: int = 3) -> Transducer:
    """A negation softens insults and threats among the next ``reach`` words."""
    arcs = {}
    for left in range(reach + 1):
        after = max(left - 1, 0)
        for s in _ALL:
            out = s.lower() if left and s in "IT" else s
            arcs[left, s] = (after, out, 0.0)
        arcs[left, NEGATION] = (reach, OTHER, 0.0)
    return Transducer(arcs)


def clause_scorer() -> Transducer:
    """State 1: a target was seen; 2: an insult; 3: both. A target and an insult or threat in a clause raise each other."""
    arcs = {}
    for state, target, hit in ((0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)):
        arcs[state, TARGET] = (3 if hit else 1, OTHER, 0.5 if hit and not target else 0.0)
        for s, w, aimed in ((INSULT, 1.0, 0.5), (THREAT, 0.3, 1.2), ("i", 0.25, 0.0), ("t", 0.05, 0.0)):
            arcs[state, s] = (3 if target else 2, OTHER, w + (aimed if target and not hit else 0.0))
    return Transducer(arcs)


def grammar() -> Transducer:
    return compose(compose(reported_speech(), negation(), "ITYNRO"), clause_scorer(), "ITYNRO")


@dataclass
class Model:
    """stems: beginnings of words (or ``word$`` for a whole word) and their weights; scale: intercept and slope of the clause scores."""

    stems: dict[str, float] = field(default_factory=dict)
    intercept: float = -3.0
    slope: float = 3.0


class Scorer:
    """Scores texts; the lexical part is an automaton over the stems, so that texts without any are passed over quickly."""

    def __init__(self, model: Model):
        self.model, self.machine = model, grammar()
        self.fixed = {w: (s, 1.0) for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.found = ahocorasick.Automaton()
        for stem in {*model.stems, *(f"{w}$" for w in (*INSULTS, *THREATS))}:
            self.found.add_word(stem.rstrip("$"), len(stem.rstrip("$")))
        self.found.make_automaton()
        self.lengths = sorted({len(s) for s in model.stems if s[-1] != "$"}, reverse=True)

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's symbol and weight: the longest stem counts, the whole word before all."""
        stems = self.model.stems
        if (w := stems.get(f"{word}$")) is not None:
            return INSULT, w
        for n in self.lengths:
            if n <= len(word) and (w := stems.get(word[:n])) is not None:
                return INSULT, w
        return self.fixed.get(word, (OTHER, 0.0))

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of the clauses in which a stem begins a word."""
        done = -1
        for last, n in self.found.iter(text):
            first = last - n + 1
            if first < done or (first and text[first - 1].isalpha()):
                continue
            lo = max(text.rfind(c, 0, first) for c in ".!?;:\n") + 1
            m = _CLAUSE_END.search(text, last + 1)
            done = m.end() if m else len(text)
            yield lo, m.start() if m else len(text)

    def clause(self, text: str) -> float:
        state, total = 0, 0.0
        for m in _WORD.finditer(text):
            symbol, strength = self.symbol(m.group())
            state, _, w = self.machine.step(state, symbol)
            total += w * (strength if symbol == INSULT else 1.0)
        return total

    def evidence(self, text: str) -> float:
        """Sum of the matched clauses' scores, on a scale that grows slowly."""
        text = text.lower()
        return math.log1p(sum(self.clause(text[lo:hi]) for lo, hi in self.clauses(text)))

    def score(self, text: str) -> float:
        x = self.model.intercept + self.model.slope * self.evidence(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def stems_of(word: Column, shortest: int = 4, longest: int = 7) -> Column:
    """The whole word (with ``$``) and its beginnings of 4 to 7 letters."""
    return F.concat(F.array(F.concat(word, F.lit("$"))), F.filter(F.array(*[F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in range(shortest, longest + 1)]), lambda x: x.isNotNull()))


def learn_stems(texts: DataFrame, least_docs: int = 4, evidence: float = 20.0) -> dict[str, float]:
    """Stems whose share of toxic texts is beyond chance; ``texts`` has text and toxic (0/1) and is a bounded sample.

    The counts are of documents. A stem is kept if the log likelihood ratio against
    the overall share is at least ``evidence`` and it leans to the toxic side;
    of stems that stand for the same texts the most specific one stays.
    """
    base = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = base["n"], base["t"] or 0
    if not t or t == n:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    counts = (
        texts.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(words, lambda w: stems_of(w))))).alias("stem"))
        .groupBy("stem").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
        .filter((F.col("a") >= least_docs) & (F.col("a") / F.col("n") >= max(0.5, min(0.9, 3 * t / n))))
    )
    ratio = F.col("a") * F.log(F.col("a") / (F.col("n") * F.lit(t / n))) + F.when(F.col("n") > F.col("a"), (F.col("n") - F.col("a")) * F.log((F.col("n") - F.col("a")) / (F.col("n") * F.lit(1 - t / n)))).otherwise(0.0)
    rows = counts.withColumn("ratio", ratio).filter(F.col("ratio") >= evidence).collect()
    held = {r["stem"]: r["a"] for r in rows}
    weights = {r["stem"]: math.log((r["a"] + 0.5) / (t + 1)) - math.log((r["n"] - r["a"] + 0.5) / (n - t + 1)) for r in rows}
    longer: dict[str, int] = {}  # of each beginning, the most texts of a longer stem
    for s, a in held.items():
        for k in range(4, len(s)):
            longer[s[:k]] = max(longer.get(s[:k], 0), a)
    return {s: weights[s] / 4 for s, a in held.items() if longer.get(s, 0) < 0.95 * a}


def one_of_each(texts: list[str]) -> list[int]:
    """Positions of texts of which no near copy stands before them.

    Copies of one text would make its every word look like evidence. Texts count as
    near copies if two minimum hashes of their five-word shingles agree in one of
    four bands.
    """
    seen: set[tuple[int, int, int]] = set()
    keep = []
    for i, text in enumerate(texts):
        words = text.lower().split()
        hashes = np.array([zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))], np.uint64)
        low = [int(((hashes * np.uint64((0x9E3779B97F4A7C15 >> k) | 1)) >> np.uint64(7)).min()) for k in range(8)]
        bands = {(k, low[k], low[k + 1]) for k in range(0, 8, 2)}
        if not bands & seen:
            keep.append(i)
        seen |= bands
    return keep


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", sample_rows: int = 6000) -> Model:
    """Learn from at most ``sample_rows`` labelled rows, those with the smallest hashes of their keys.

    Rows with a null label or text are left out, as are near copies. Without rows of both labels the
    seeds and a fixed scale serve.
    """
    rows = (
        labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), F.xxhash64(F.col(key_col).cast("string")).alias("h"))
        .filter("text is not null and toxic in (0, 1)")
        .orderBy("h").limit(sample_rows).select("text", "toxic")
    )
    held = rows.collect()  # bounded by sample_rows
    held = [held[i] for i in one_of_each([r["text"] for r in held])]
    spark = labelled.sparkSession
    sample = spark.createDataFrame([(r["text"], r["toxic"]) for r in held], "text string, toxic int").repartition(8) if held else rows
    learned = learn_stems(sample) if held else {}
    model = Model({f"{w}$": SEED_WEIGHT for w in INSULTS} | learned)
    y = np.array([r["toxic"] for r in held], float)
    if not len(y) or y.min() == y.max():
        return model
    scorer = Scorer(model)
    x = np.array([scorer.evidence(r["text"]) for r in held])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels count alike
    design, b = np.stack([np.ones_like(x), x], 1), np.array([-2.0, 1.0])
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(design @ b, -60, 60)))
        grad = design.T @ (weight * (p - y)) + 0.5 * b
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        b = b - np.linalg.solve(hess, grad)
    # the scale is held to one on which a text without any match is not toxic
    model.intercept, model.slope = float(min(b[0], -2.0)), float(max(b[1], 1.0))
    return model


def score_texts(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``score`` (0 to 1; a column of that name is replaced).

    Only the text counts. Null and empty texts get the score of a text without any
    match; texts of any length are scored whole. Rows that repeat get equal scores;
    an empty table gives none.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = documents.drop("score")
    at = kept.columns.index(text_col)
    shared = documents.sparkSession.sparkContext.broadcast((model.stems, model.intercept, model.slope))  # stems of a bounded sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            scores = [scorer.score(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(work, StructType([*kept.schema.fields, StructField("score", DoubleType())]))


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(documents: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> Model:
    """Fit on the labelled rows of ``documents`` that aren't held out.

    The labels' ids are sampled first, by the same hash, so that only the sample's
    documents are looked for; twice as many ids as rows, as some have no document.
    """
    ids = (
        labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(2 * sample_rows)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # 2 * sample_rows at most
    return fit(rows, sample_rows=sample_rows)

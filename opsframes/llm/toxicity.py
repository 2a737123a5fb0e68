"""Toxicity by a weighted finite-state pattern grammar.

Words are labelled: *insult* (words and stems with weights learned from
labelled documents), *harm* (verbs of harm: written stems, and words learned
from what follows an opener in toxic documents), and closed classes of
function words: *target*, *opener*, *negation*, *report*, *quote*. Five
transducers read the labels of a clause, word by word. Each has states and
arcs, and an arc maps the value of its word, v, to factor * v + addend:

* insult and threat: an insult has its weight; a verb of harm counts if an
  opener ("will", "going", "vais", ...) came up to three words before;
* target: an insult or threat near a person word is raised, and a person word
  that follows an insult adds to it;
* negation: what follows within three words is lowered;
* reported speech: what follows a verb of saying, or stands in quotes, is lowered.

Affine maps compose, so the product of the five machines is again such a
transducer; it is built once, and each clause is one run through its table.
Features of a document are sums over its clauses' scores, never counts of
words; a logistic regression over them, fitted on the same labelled documents,
gives the probability. Lexicon and regression are fitted on a sample of about
``SAMPLE`` labelled rows (all, if there are fewer), picked by a hash of the id;
the lexicon holds at most ``LEXICON`` entries.

Edge cases: null and empty texts get the score of a text without any match.
Rows of ``labels`` with null id or toxic, and labels of unknown documents, are
not used; of contradicting labels for one document the largest counts. With
no usable toxic or no usable clean label nothing is learned, and only the
written threat patterns score. Repeated rows get equal scores. An empty table
gives an empty one; columns of other names, clashing ones too, are left alone.
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
from pyspark.sql import types as T

from opsframes.llm._common import in_slices, only, utf8

LEXICON = 20_000
SAMPLE = 20_000
STEMS = range(3, 8)
LEAST_DOCS = 4
LEAST_WEIGHT = 1.2

# Closed classes of function words (English, German, French, Spanish) and stems of verbs of harm.
TARGETS = frozenset("you your yours youre u ya they them their he him she her his people person everyone "
                    "tu te vous toi ton votre du dich dir ihr euch dein usted ustedes tú ti vosotros".split())
OPENERS = frozenset("will shall gonna going should must want wanna ill we'll i'll they'll deserve deserves ought werde werden wirst soll sollst "
                    "will vais allons va vas devrais dois voy vamos vas debes deberías".split())
NEGATIONS = frozenset("not no never nobody isn't aren't wasn't don't doesn't didn't won't can't cannot without nicht kein keine keinen nie "
                      "niemals pas jamais aucun aucune sans nunca ningún ninguna jamás sin".split())
REPORTS = frozenset("said says say called calls wrote claims claimed reported quoted quote alleged sagte sagt schrieb "
                    "dit disait écrit dijo dice escribió".split())
HARM_STEMS = frozenset("kill murder slaughter strangl chok suffocat drown stab hang lynch shoot burn beat punch smash crush hurt "
                       "destroy attack poison butcher behead execut tortur rape töte töten ermord erschlag erschieß erwürg verbrenn schlagen "
                       "prügel abstech vergift tuer assassin égorg étrangl noyer brûler frapper tabass empoisonn matar matarte asesin "
                       "estrangul ahog apuñal golpear quemar ahorcar degollar".split())
HARM_LENGTHS = sorted({len(x) for x in HARM_STEMS}, reverse=True)

_CLAUSE = re.compile(r"[.!?;:\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"«»“”„]")
FEATURES = 5
NEAR = 3

LABELS = OTHER, INSULT, HARM, TARGET, OPENER, NEGATION, REPORT, QUOTE = range(8)
SCORED = (INSULT, HARM, TARGET)


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][label]`` is (next state, factor, addend); a run starts in state 0."""

    arcs: tuple[tuple[tuple[int, float, float], ...], ...]

    def then(self, other: Transducer) -> Transducer:
        """The machine that does what this one does and then what ``other`` does, over the states reached."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = []
            for label in LABELS:
                (a2, f, g), (b2, h, k) = self.arcs[a][label], other.arcs[b][label]
                if (a2, b2) not in number:
                    number[a2, b2] = len(todo)
                    todo.append((a2, b2))
                row.append((number[a2, b2], f * h, h * g + k))
            arcs.append(tuple(row))
        return Transducer(tuple(arcs))

    def run(self, labels: list[int], values: list[float]) -> list[float]:
        """The value of each word of a clause."""
        state, out = 0, []
        for label, v in zip(labels, values):
            state, factor, addend = self.arcs[state][label]
            out.append(factor * v + addend)
        return out


def within(reach: int, trigger: int, labels: tuple[int, ...], factor: float = 1.0, addend: float = 0.0) -> Transducer:
    """For ``reach`` words after a trigger, words of these labels are mapped; the state is how many words are left."""
    def arc(state: int, label: int) -> tuple[int, float, float]:
        hit = state > 0 and label in labels
        return (reach if label == trigger else max(0, state - 1)), factor if hit else 1.0, addend if hit else 0.0
    return Transducer(tuple(tuple(arc(s, label) for label in LABELS) for s in range(reach + 1)))


def insult_and_threat() -> Transducer:
    """Insults pass with their weight, verbs of harm after an opener with theirs and one; all else is 0."""
    def arc(state: int, label: int) -> tuple[int, float, float]:
        counts = label == INSULT or label == HARM and state > 0
        # a harm verb keeps the reach alive: "will kill and burn"
        left = NEAR if label == OPENER or counts and label == HARM else max(0, state - 1)
        return left, float(counts), float(counts and label == HARM)
    return Transducer(tuple(tuple(arc(s, label) for label in LABELS) for s in range(NEAR + 1)))


def reported_speech(factor: float = 0.5) -> Transducer:
    """State 1: after a verb of saying, to the clause's end; state 2: in quotes."""
    move = ({REPORT: 1, QUOTE: 2}, {QUOTE: 2}, {QUOTE: 0})
    return Transducer(tuple(tuple((move[s].get(label, s), factor if s and label in SCORED else 1.0, 0.0) for label in LABELS) for s in range(3)))


def grammar_parts() -> list[Transducer]:
    """The machines in the order that they are composed."""
    return [insult_and_threat(),
            within(NEAR + 1, TARGET, (INSULT, HARM), factor=1.25), within(2, INSULT, (TARGET,), addend=0.5),
            within(NEAR, NEGATION, SCORED, factor=0.3), reported_speech()]


CLAUSES = reduce(Transducer.then, grammar_parts())


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


@dataclass
class Grammar:
    """Learned entries (``word`` or ``stem*`` of insults, words of harm), and the regression over clause sums."""

    entries: dict[str, float] = field(default_factory=dict)
    harm: dict[str, float] = field(default_factory=dict)
    centre: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    weights: list[float] = field(default_factory=lambda: [0.5, 0.5, 0.5, 0.0, 2.0])
    bias: float = -2.0

    def label(self, word: str) -> tuple[int, float]:
        """Label and weight of a lower-case word or quotation mark; function words stay what they are."""
        for label, words in ((TARGET, TARGETS), (OPENER, OPENERS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return label, 0.0
        if (own := self.entries.get(word)) is not None:
            return INSULT, own
        if (own := self.harm.get(word)) is not None:
            return HARM, own
        if any(word[:n] in HARM_STEMS for n in HARM_LENGTHS if n <= len(word)):
            return HARM, 0.0
        for n in reversed(STEMS):
            if n <= len(word) and (stem := self.entries.get(word[:n] + "*")) is not None:
                return INSULT, stem
        return (OTHER if word[0].isalpha() else QUOTE), 0.0

    def score(self, text: str | None, memo: dict | None = None) -> float:
        x = self.features(text or "", {} if memo is None else memo)
        z = self.bias + sum(w * (v - c) / s for w, v, c, s in zip(self.weights, x, self.centre, self.scale))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def clause(self, words: list[str], memo: dict | None = None) -> tuple[float, float]:
        """(score, the part of it that verbs of harm bring) of a clause's words and quotation marks, from one run."""
        memo = {} if memo is None else memo
        state, score, threat, arcs = 0, 0.0, 0.0, CLAUSES.arcs
        for w in words:
            label, weight = memo.get(w) or memo.setdefault(w, self.label(w))
            state, factor, addend = arcs[state][label]
            if value := factor * weight + addend:
                score += value
                if label == HARM:
                    threat += value
        return score, threat

    def features(self, text: str, memo: dict) -> list[float]:
        """Sums over the clauses of a text; ``memo`` keeps the labels of words already read."""
        text = text.lower()
        read = _WORD.findall(text)
        hot = set()
        for w in set(read):
            label, weight = memo.get(w) or memo.setdefault(w, self.label(w))
            if label == INSULT or label == HARM:
                hot.add(w)
        if not hot:
            return [0.0] * FEATURES
        total = best = threats = 0.0
        matched = 0
        for clause in _CLAUSE.split(text):
            words = _TOKEN.findall(clause)
            if hot.isdisjoint(words):  # such a clause has no value to score
                continue
            score, threat = self.clause(words, memo)
            total, best, threats = total + score, max(best, score), threats + threat
            matched += score >= LEAST_WEIGHT
        return [math.log1p(total), math.log1p(best), math.log1p(matched), math.log1p(100 * total / len(read)), math.log1p(threats)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and stems of each labelled text, and its words shortly after an opener (with a leading blank),
    as counts per batch and label."""
    for batch in in_slices(batches, "text"):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist()):
            read = _WORD.findall((text or b"").decode().lower())
            found = set(read)
            opened = {" " + w for i, x in enumerate(read) if x in OPENERS for w in read[i + 1:i + 1 + NEAR]}
            found |= {w[:n] + "*" for w in found for n in STEMS if n <= len(w)} | opened
            for w in found:
                counts.setdefault(w, [0, 0])[toxic] += 1
        if counts:
            both = np.array(list(counts.values()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                             names=["entry", "clean", "toxic"])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON) -> Grammar:
    """Learn the grammar from the labelled rows that are not held out."""
    told = (only(labels, id=id_col, toxic=label_col).where("id is not null and toxic in (0, 1)")
            .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")))
    part = min(1 << 20, -(-sample * (1 << 20) // max(1, told.count())))
    # about `sample` short rows, so texts need no shuffle to meet their labels
    told = F.broadcast(told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part))
    rows = only(docs, id=id_col, text=text_col).join(told, "id")
    counts = rows.select("text", "toxic").mapInArrow(_words, "entry string, clean long, toxic long")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    grammar = Grammar()
    if not seen.get(0) or not seen.get(1):
        return grammar
    odds = F.log((F.col("toxic") + 0.5) / (seen[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (seen[0] + 1.0))
    listed = (counts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .where(F.col("toxic") >= LEAST_DOCS).withColumn("weight", odds).where(F.col("weight") >= LEAST_WEIGHT)
              .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "entry").limit(lexicon).collect())
    grammar.entries = {r["entry"]: r["weight"] for r in listed if r["entry"][0] != " "}
    grammar.harm = {r["entry"][1:]: r["weight"] for r in listed if r["entry"][0] == " "}
    blank = Grammar(entries=grammar.entries, harm=grammar.harm)

    def features(batches):
        memo: dict = {}
        for batch in in_slices(batches, "text"):
            x = [blank.features((t or b"").decode(), memo) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    fitted = rows.select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").collect()  # about `sample` short rows
    y = np.array([r["toxic"] for r in fitted], dtype=float)
    if 0 < y.sum() < len(y):
        x = np.array([r["x"] for r in fitted])
        centre, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        weights, bias = _fit((x - centre) / scale, y)
        grammar.centre, grammar.scale, grammar.weights, grammar.bias = centre.tolist(), scale.tolist(), weights.tolist(), bias
    return grammar


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the probability that a text is toxic. No shuffle."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        memo: dict = {}
        for batch in in_slices(batches, text_col):
            scores = []
            for text in utf8(batch.column(at)):
                if len(memo) > 500_000:
                    memo.clear()
                scores.append(grammar.score((text or b"").decode(), memo))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, held_out, score, predicted."""
    grammar = train(docs, labels, id_col, text_col)
    scored = score(only(docs, id=id_col, text=text_col), grammar)
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents scored ``threshold`` or more; columns as they are.

    Null and empty texts have no match and stay unless the labels say that even such are toxic; copies and
    repeated rows go or stay together, whatever their ids; an empty table gives an empty one."""
    names = docs.columns
    grammar = train(docs, labels, id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kept = score(packed, grammar).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])

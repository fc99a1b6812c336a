"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target (who is addressed), negation, report (said, quotation marks), break (end of
a clause). Four small transducers read them - one tracks a target, one a negation that is still in force, one reported
speech, one what hostile symbols came before - and their composition is one table: state x symbol -> state, weight. A
clause's score is the weight it collects, so "you are no idiot" and 'he said "idiot"' weigh less than "you idiot", and
an insult alone something in between. A target counts on either side: what was hostile before it is held until the clause
ends and gets its weight when a target follows ("I will kill you", "idiot, you"). A document's clause scores are summed
with diminishing returns and a logistic curve turns the sum into the score.

Insults differ by language and time, so that lexicon is learned: whole words and word beginnings that distinct
toxic documents share and others lack. The closed classes (targets, negations, reporting verbs, threats) are fixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.llm.common import held_out, id_and_text, pieces
from packsight.llm.quality import labelled_sample
from packsight.session import ship

HELD_OUT = (4, 2)
THRESHOLD = 0.3
#: Bound of the labelled sample.
SAMPLE = 12_000
#: Lengths of learned word beginnings.
STEMS = (4, 5, 6, 7)
#: An entry needs this many distinct toxic documents, this share of them at least, and this precision.
LEAST_DOCS, LEAST_SHARE, PRECISION = 5, 0.006, 0.9
#: Documents at which an entry has half of its weight.
DOUBT = 4

# Closed word classes in English, French, German and Spanish.
TARGETS = frozenset("you your yours he she they him her them this these yourself yourselves himself herself themselves tu te toi vous votre il elle ils du dich dir ihr euch er sie tú vosotros usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never nor without isn't aren't don't ne pas jamais sans nicht kein keine keinen nie ohne nunca jamás sin tampoco".split())
REPORTS = frozenset("said says claimed called wrote reported quoted alleged dit disait appelé écrit sagte sagt nannte schrieb dijo decía llamó escribió".split())
THREATS = frozenset("kill killing murder destroy hurt tuer détruire töten vernichten matar destruir".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK = range(8)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»]|[.!?;:\n]")
#: Words that a negation reaches.
REACH = 3
#: Factor of what is hostile in a clause with a target.
TARGETED = 1.6


@dataclass(frozen=True)
class Transducer:
    """step: (state, symbol) -> (state, factor); the factor scales the weight of a hostile symbol."""

    states: int
    step: dict[tuple[int, int], tuple[int, float]]


def _target() -> Transducer:
    """0: no target in this clause yet, 1: there is one."""
    step = {}
    for s, x in product(range(2), range(8)):
        step[s, x] = (0 if x == BREAK else 1 if x == TARGET else s), (TARGETED if s else 1.0)
    return Transducer(2, step)


def _negation() -> Transducer:
    """The number of words that a negation still reaches."""
    step = {}
    for s, x in product(range(REACH + 1), range(8)):
        step[s, x] = (0 if x == BREAK else REACH if x == NEGATION else max(0, s - 1)), (0.6 if s else 1.0)
    return Transducer(REACH + 1, step)


def _report() -> Transducer:
    """0: plain, 1: after a reporting verb, 2: inside quotation marks."""
    step = {}
    for s, x in product(range(3), range(8)):
        to = {BREAK: 0 if s != 2 else 2, QUOTE: 0 if s == 2 else 2, REPORT: max(s, 1)}.get(x, s)
        step[s, x] = to, (1.0, 0.7, 0.6)[s]
    return Transducer(3, step)


def _hostile() -> Transducer:
    """0: nothing hostile in this clause, 1: an insult, 2: a threat; what follows weighs more."""
    step = {}
    for s, x in product(range(3), range(8)):
        step[s, x] = {BREAK: 0, INSULT: max(s, 1), THREAT: 2}.get(x, s), (1.0, 1.2, 1.4)[s]
    return Transducer(3, step)


def compose(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The product of transducers that read the same symbols: next[state, symbol] and factor[state, symbol]."""
    shape = [p.states for p in parts]
    states = list(product(*map(range, shape)))
    number = {s: i for i, s in enumerate(states)}
    to = np.zeros((len(states), 8), dtype=np.int32)
    factor = np.ones((len(states), 8))
    for s, x in product(states, range(8)):
        got = [p.step[q, x] for p, q in zip(parts, s, strict=True)]
        to[number[s], x] = number[tuple(g[0] for g in got)]
        factor[number[s], x] = np.prod([g[1] for g in got])
    return to, factor


NEXT, FACTOR = (x.tolist() for x in compose([_target(), _negation(), _report(), _hostile()]))
CLOSED = {w: k for k, words in ((THREAT, THREATS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in words}
#: A threat word without a target is mostly literal; insults are learned with weights of their own.
THREAT_WEIGHT = 0.25


@dataclass
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 4.0
    middle: float = 0.5

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that have one."""
        lower = (text or "").lower()
        tokens = TOKEN.findall(lower)
        weight = {w: x for w in set(tokens) if (x := self.insult(w))}
        if not weight and THREATS.isdisjoint(tokens):
            return []
        state, total, held, out = 0, 0.0, 0.0, []
        for t in tokens:
            if t in weight:
                symbol, w = INSULT, weight[t]
            elif len(t) == 1 and not t.isalpha():
                symbol, w = (QUOTE if t in "\"“”«»" else BREAK), 0.0
            else:
                symbol = CLOSED.get(t, OTHER)
                w = THREAT_WEIGHT if symbol == THREAT else 0.0
            w *= FACTOR[state][symbol]
            if state < len(NEXT) // 2:  # no target yet
                if symbol == TARGET:
                    total, held = total + held, 0.0
                elif symbol == INSULT:
                    held += (TARGETED - 1) * w
                elif symbol == THREAT:
                    held, w = held + TARGETED * w, 0.0
            total += w
            state = NEXT[state][symbol]
            if symbol == BREAK:
                if total:
                    out.append(total)
                total = held = 0.0
        return out + [total] if total else out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-self.slope * (raw_score(self, text) - self.middle))))


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text.lower()))


def _kind(text: str) -> int:
    """The smallest hash of a text's 3-word runs: near copies mostly share it, so a group of them counts as one."""
    words = text.split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def learn_lexicon(toxic: list[str], clean: list[str]) -> Grammar:
    """Entries whose documents are toxic. The weight is the precision, less the fewer documents stand for it."""
    distinct = {_kind(t): t for t in sorted(toxic)}
    seen: dict[str, int] = {}
    for text in distinct.values():
        for item in _items(_words(text)):
            seen[item] = seen.get(item, 0) + 1
    least = max(LEAST_DOCS, LEAST_SHARE * len(distinct))
    candidates = {k for k, n in seen.items() if n >= least}
    against: dict[str, int] = dict.fromkeys(candidates, 0)
    for text in clean:
        for item in _items(_words(text)) & candidates:
            against[item] += 1
    words, stems = {}, {}
    for item in sorted(candidates):
        precision = seen[item] / (seen[item] + against[item])
        if precision >= PRECISION:
            (stems if item.endswith("*") else words)[item.rstrip("*")] = float(precision * seen[item] / (seen[item] + DOUBT))
    return Grammar(words, stems)


def _items(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def raw_score(grammar: Grammar, text: str | None) -> float:
    """The clauses' scores, the largest in full, the next by half, a third and so on."""
    return sum(s / (1 + i) for i, s in enumerate(sorted(grammar.clauses(text), reverse=True)))


def calibrate(toxic: list[str], clean: list[str]) -> Grammar:
    """The lexicon of all samples, and a curve that crosses the threshold where documents separate with fewest errors.

    The curve is found on documents that the lexicon did not see: each half is scored with the other half's.
    """
    halves = [([t for t in side if _kind(t) % 2 == k] for side in (toxic, clean)) for k in (0, 1)]
    (t0, c0), (t1, c1) = (tuple(h) for h in halves)
    a, b = [], []
    for (t, c), (other_t, other_c) in (((t0, c0), (t1, c1)), ((t1, c1), (t0, c0))):
        half = learn_lexicon(other_t, other_c)
        a += [raw_score(half, x) for x in t]
        b += [raw_score(half, x) for x in c]
    a, b = np.sort(a), np.sort(b)
    cuts = np.unique(np.concatenate((a, b, [0.25])))
    cuts = cuts[cuts > 0]
    wrong = np.searchsorted(a, cuts, side="left") + (len(b) - np.searchsorted(b, cuts, side="left"))
    best = float(cuts[int(np.argmin(wrong))])
    below = max([x for x in np.concatenate((a, b)) if x < best], default=0.0)
    edge = max(below + (best - below) / 2, 0.05)
    slope = 4.0 / edge
    grammar = learn_lexicon(toxic, clean)
    return Grammar(grammar.words, grammar.stems, slope, edge - np.log(THRESHOLD / (1 - THRESHOLD)) / slope)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Lexicon and curve from the whole texts of at most about ``sample`` labelled documents that are not held out."""
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", HELD_OUT, sample).select("label", "text").where("text IS NOT NULL").toArrow()
    pairs = sorted(zip(rows.column("label").to_pylist(), rows.column("text").to_pylist(), strict=True))
    toxic, clean = ([t for y, t in pairs if y == k] for k in (1, 0))
    if not toxic or not clean:
        return Grammar({}, {})
    return calibrate(toxic, clean)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Grammar | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null and blank texts have no clause and the score of a clean text. Without labels of both classes the lexicon is
    empty and only threats score. Repeated rows and null ids pass through; labels, lang, source and ids are no inputs
    of a score.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model or learn(docs, labels))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = [held.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

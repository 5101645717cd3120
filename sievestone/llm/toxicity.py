"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the same words of a clause: insult, threat, target, negation and reported speech. An arc maps a
word class to a next state and to three numbers: what it adds to the clause's weight, a damping of what other arcs add
at the same word, and a scaling of the weight so far. So an arc is an affine map of the weight, arcs at one word
multiply, and the composition of the five, built once from their tables, is one machine over the same alphabet whose
state is the tuple of theirs.

* insult: the first hostile word of a clause is a mention, every further one piles on.
* target: a hostile word is aimed by a person word before it (directly, after one word, or after a copula and at most
  two words more) or after it (at most one word between); commas don't part them.
* threat: a speaker, a verb of violence and a person as its object, in either order of verb and object; or such a verb
  at the start of a clause with a person as its object. An article after the verb makes a thing the object.
* negation: damps what follows in the clause, up to a comma or a word of contrast.
* reported speech: damps what follows in the clause and scales down what stood before it, up to a word of contrast.

A clause matches from weight MATCH on. A lone hostile word is a mention, no match. Matches, mentions beyond a document's
first, and a mention that is its only one are separate statistics of a document, and its score is a logistic function of
these, fitted on labelled rows: what a lone mention is worth, the labels must tell.

The words of the classes are short fixed lists and what labelled rows teach: words and word beginnings that occur
almost only in toxic rows, more often than chance explains (false discovery rate `wrong`). A beginning of 5 to 10
letters is learned only if several words share it and none of them makes up most of its rows. A learned mark that mostly
stands right before a person word is a verb of violence, else hostile. At most `each` labelled rows of either class
outside the held fold are learned from (a documented bound), in the order of a hash of their ids.

Edge cases: null and empty texts match nothing and get the score of no match. Labels other than 0 and 1 and null ids
are not learned from; without labels of both classes the fixed lists stand alone, with fixed calibration. Repeated rows
are scored alike; ties between marks do not matter, as all that pass are taken. Very long texts are read whole; the word
cache is bounded in bytes. Scoring keeps all rows; kept() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import WORD_SPLIT, Known, cut, map_arrow, texts
from .learning import class_sizes, labelled, sample_of

#: Words of each class that are known without learning, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless disgusting pathetic clown dumb fool imbecile vermin filth jerk coward "
    "idiotin dummkopf abschaum versager widerlich wertlos imbécile débile ordure minable crétin idiota imbécil estúpido estúpida basura patético"
)
THREATS = "kill hurt destroy murder attack beat crush stab shoot burn töten umbringen schlagen vernichten tuer frapper écraser brûler matar golpear destruir quemar"
TARGETS = "you your yours u yourself yourselves him her them they he she these those people dich euch dir ihn sie du ihr te toi vous lui leur tu eux ti te os usted ustedes ellos él"
SELVES = "i we i'll we'll i'm we're gonna ich wir je nous j'vais yo nosotros vamos voy"
NEGATIONS = "not never no isn't aren't wasn't weren't don't doesn't didn't won't can't without hardly nicht kein keine keinen niemals pas jamais aucun nunca jamás sin"
REPORTS = "say said says saying wrote writes write reported quoted claimed called alleged according sagte sagt schrieb behauptete dit disait écrit affirme dijo dice escribió afirmó"
ARTICLES = "the a an this that der die das den dem ein eine einen le la les un une des el los las una unos"
COPULAS = "are is am was were be being been re bist seid ist sind war es êtes sont est étais eres son está"
CONTRASTS = "but however yet aber sondern jedoch doch mais pourtant pero sino"

OTHER, INSULT, THREAT, TARGET, SELF, NEGATION, REPORT, ARTICLE, COPULA, CONTRAST, COMMA = range(11)
SYMBOLS = COMMA + 1
AFTER_COMMA, AFTER_END = 16, 32  # flags of a word that a comma or a clause's end follows
HOT = frozenset(c + f for c in (INSULT, THREAT) for f in (0, AFTER_COMMA, AFTER_END))
CACHE_WORDS = 300_000
MATCH = 0.5
MENTION, PILED, AIMED, THREATENED, URGED = 0.3, 0.3, 0.9, 1.3, 1.1  # what the outputs add to a clause
DENIED, TOLD = 0.15, 0.3  # what negation and reported speech leave of it

#: One transducer each: state -> {class: (next state, added)}; "*" stands for every class that is not listed.
INSULT_FST = {"none": {INSULT: ("some", MENTION), "*": ("none", 0)}, "some": {INSULT: ("some", PILED), "*": ("some", 0)}}
TARGET_FST = {
    "none": {TARGET: ("person", 0), INSULT: ("insult", 0), "*": ("none", 0)},
    "person": {INSULT: ("done", AIMED), TARGET: ("person", 0), COPULA: ("is", 0), OTHER: ("person+1", 0), ARTICLE: ("person+1", 0), COMMA: ("person", 0), "*": ("none", 0)},
    "person+1": {INSULT: ("done", AIMED), TARGET: ("person", 0), COPULA: ("is", 0), COMMA: ("person+1", 0), "*": ("none", 0)},
    "is": {INSULT: ("done", AIMED), TARGET: ("person", 0), OTHER: ("is+1", 0), CONTRAST: ("none", 0), "*": ("is", 0)},
    "is+1": {INSULT: ("done", AIMED), TARGET: ("person", 0), OTHER: ("is+2", 0), CONTRAST: ("none", 0), "*": ("is+1", 0)},
    "is+2": {INSULT: ("done", AIMED), TARGET: ("person", 0), OTHER: ("none", 0), CONTRAST: ("none", 0), "*": ("is+2", 0)},
    "insult": {TARGET: ("done", AIMED), INSULT: ("insult", 0), COMMA: ("insult", 0), OTHER: ("insult+1", 0), "*": ("none", 0)},
    "insult+1": {TARGET: ("done", AIMED), INSULT: ("insult", 0), COMMA: ("insult+1", 0), "*": ("none", 0)},
    "done": {"*": ("done", 0)},
}
THREAT_FST = {
    "start": {THREAT: ("urge", 0), SELF: ("self", 0), "*": ("none", 0)},
    "none": {SELF: ("self", 0), "*": ("none", 0)},
    "self": {THREAT: ("verb", 0), TARGET: ("object", 0), OTHER: ("self+1", 0), NEGATION: ("self", 0), SELF: ("self", 0), "*": ("none", 0)},
    "self+1": {THREAT: ("verb", 0), TARGET: ("object", 0), OTHER: ("self+2", 0), NEGATION: ("self+1", 0), SELF: ("self", 0), "*": ("none", 0)},
    "self+2": {THREAT: ("verb", 0), TARGET: ("object", 0), SELF: ("self", 0), "*": ("none", 0)},
    "object": {THREAT: ("none", THREATENED), OTHER: ("object+1", 0), TARGET: ("object", 0), SELF: ("self", 0), "*": ("none", 0)},
    "object+1": {THREAT: ("none", THREATENED), SELF: ("self", 0), "*": ("none", 0)},
    "verb": {TARGET: ("none", THREATENED), OTHER: ("verb+1", 0), THREAT: ("verb", 0), SELF: ("self", 0), "*": ("none", 0)},
    "verb+1": {TARGET: ("none", THREATENED), SELF: ("self", 0), "*": ("none", 0)},
    "urge": {TARGET: ("none", URGED), OTHER: ("urge+1", 0), SELF: ("self", 0), "*": ("none", 0)},
    "urge+1": {TARGET: ("none", URGED), SELF: ("self", 0), "*": ("none", 0)},
}
NEGATION_FST = {"plain": {NEGATION: ("denied", 0), "*": ("plain", 0)}, "denied": {COMMA: ("plain", 0), CONTRAST: ("plain", 0), "*": ("denied", 0)}}
REPORT_FST = {"own": {REPORT: ("told", 0), "*": ("own", 0)}, "told": {CONTRAST: ("own", 0), "*": ("told", 0)}}
MACHINES = {"insult": INSULT_FST, "threat": THREAT_FST, "target": TARGET_FST, "negation": NEGATION_FST, "report": REPORT_FST}


def damped(machine: str, before: str) -> float:
    """What a machine in a state leaves of what other arcs add there."""
    return {("negation", "denied"): DENIED, ("report", "told"): TOLD}.get((machine, before), 1.0)


def scaled(machine: str, before: str, symbol: int) -> float:
    """What an arc leaves of the clause's weight so far: a report after a match weakens it."""
    return TOLD if (machine, before, symbol) == ("report", "own", REPORT) else 1.0


def compose(machines: dict[str, dict]) -> list[tuple[int, float, float]]:
    """The product of transducers that read the same input: at state * SYMBOLS + symbol the next state, scale and addition."""
    start = tuple(next(iter(m)) for m in machines.values())
    number, todo, table = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for c in range(SYMBOLS):
            moves = [m[s].get(c, m[s]["*"]) for m, s in zip(machines.values(), state, strict=True)]
            to = tuple(x for x, _ in moves)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            damp = float(np.prod([damped(name, s) for name, s in zip(machines, state, strict=True)]))
            scale = float(np.prod([scaled(name, s, c) for name, s in zip(machines, state, strict=True)]))
            table[number[state] * SYMBOLS + c] = number[to], scale, damp * sum(x for _, x in moves)
    return [table[i] for i in range(len(table))]


GRAMMAR = compose(MACHINES)


def weight(codes: list[int]) -> float:
    """The weight of a clause: what its composed arcs make of zero."""
    state, total = 0, 0.0
    for c in codes:
        state, scale, add = GRAMMAR[state * SYMBOLS + (c & 15)]
        total = total * scale + add
        if c & AFTER_COMMA:
            state, scale, add = GRAMMAR[state * SYMBOLS + COMMA]
            total = total * scale + add
    return total


def core(word: bytes) -> str:
    """A word in lower case, without what is not a letter or digit at its ends."""
    w = word.decode("utf-8", "replace").lower().replace("’", "'")
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a : b - 2] if w.endswith("'s", a, b) else w[a:b]


class Lexicon:
    """Classes of words, by a bounded cache of the words as they stand in texts."""

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.words, self.stems, self.cache = words, stems, Known(CACHE_WORDS)
        self.sizes = sorted({len(x) for x in stems})

    def code(self, word: bytes) -> int:
        """The class of a word, and a flag where its clause ends or a comma follows."""
        w = core(word)
        c = self.words.get(w, OTHER) or next((self.stems[w[:k]] for k in self.sizes if w[:k] in self.stems), OTHER)
        return c + (AFTER_END if word[-1:] in (b".", b"!", b"?", b";") else AFTER_COMMA if word[-1:] in (b",", b":") else 0)

    def codes(self, words: list[bytes]) -> list[int]:
        return self.cache.of(words, lambda new: map(self.code, new))

    def clauses(self, text: bytes) -> tuple[int, list[float]]:
        """The number of words, and the weights over 0 of the clauses in their order."""
        codes = self.codes(text.split())
        if HOT.isdisjoint(codes):
            return len(codes), []
        out = []
        for line in text.split(b"\n"):
            own = self.codes(line.split())
            if HOT.isdisjoint(own):
                continue
            at = 0
            for i, c in enumerate(own, 1):
                if c & AFTER_END or i == len(own):
                    if not HOT.isdisjoint(own[at:i]) and (w := weight(own[at:i])) > 0:
                        out.append(w)
                    at = i
        return len(codes), out

    def features(self, text: bytes) -> list[float]:
        count, found = self.clauses(text)
        matches, mentions = sum(w for w in found if w >= MATCH), [w for w in found if w < MATCH]
        again = sum(mentions) - max(mentions, default=0.0)
        return [1.0, np.log1p(2 * again), np.log1p(2 * matches), min(2.0, max(found)) if matches else 0.0, min(1.0, 20 * (matches + again) / max(count, 20)), np.log1p(2 * (matches + again)), float(len(found) == len(mentions) == 1)]


def base_lexicon() -> dict[str, int]:
    """The fixed words; of a word in several lists the first class here holds."""
    lists = ((TARGETS, TARGET), (INSULTS, INSULT), (THREATS, THREAT), (NEGATIONS, NEGATION), (REPORTS, REPORT), (SELVES, SELF), (ARTICLES, ARTICLE), (COPULAS, COPULA), (CONTRASTS, CONTRAST))
    out: dict[str, int] = {}
    for words, c in lists:
        for w in words.split():
            out.setdefault(w, c)
    return out


PERSONS = frozenset(TARGETS.split())
SHORTEST, LONGEST = 5, 10


def marks(text: bytes) -> set[str]:
    """The distinct words of a text, their beginnings (marked by a star), and the words that stand right before a person word (marked by >)."""
    own = list(map(core, text.split()))
    words = {w for w in own if 2 <= len(w) <= 40}
    before = {a + ">" for a, b in zip(own, own[1:], strict=False) if b in PERSONS and 2 <= len(a) <= 40}
    return words | before | {w[:k] + "*" for w in words for k in range(SHORTEST, LONGEST + 1) if len(w) > k}


def _counts(rows: DataFrame) -> DataFrame:
    """mark, pos, neg: in how many sampled toxic and other rows it occurs; summed within partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(both[0].keys() | both[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([both[1][k] for k in keys], pa.int32()), pa.array([both[0][k] for k in keys], pa.int32())], ["mark", "pos", "neg"])

        for batch in batches:
            for y, t in zip(batch.column("__label").to_pylist(), texts(batch), strict=True):
                both[y].update(marks(t))
                if len(both[0]) + len(both[1]) > 500_000:
                    yield out()
                    both[0].clear()
                    both[1].clear()
        yield out()

    return map_arrow(rows, run, "mark string, pos int, neg int").groupBy("mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def one_of_copies(rows: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """One of the rows of either class that share their least shingle hash, and of those one of each group of near fingerprints.

    rows are a bounded sample, so its distinct fingerprints (8 bytes each) are linked on the driver.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), WORD_SPLIT), lambda w: w != "")
    with_words = rows.withColumn("__words", F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - width, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get("__words", i + F.lit(k)) for k in range(width))))
    once = cut(with_words.withColumn("__sketch", F.array_min(hashes)).dropDuplicates(["__sketch", "__label"]).select("doc_id", "text", "__label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash.fingerprint(t) for t in texts(batch)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("__label").cast(pa.int32()), pa.array(fp)], ["text", "__label", "fp"])

    once = cut(map_arrow(once.select("text", "__label"), run, "text string, __label int, fp bigint"))
    fps = np.array([r["fp"] for r in once.select("fp").distinct().collect()], np.int64)
    forest = simhash.Forest()
    for a, b in simhash.forest_edges(fps, radius):
        forest.join(a, b)
    roots = [(x, root) for x in fps.tolist() if (root := forest.find(x)) != x]
    if not roots:
        return once.dropDuplicates(["fp", "__label"]).select("text", "__label")
    named = once.sparkSession.createDataFrame(roots, "fp bigint, root bigint")
    named = once.join(F.broadcast(named), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.dropDuplicates(["root", "__label"]).select("text", "__label")


class Model:
    """Learned words and stems with their classes, and the calibration of the clause features."""

    def __init__(self, words: dict[str, int], stems: dict[str, int], beta: np.ndarray):
        self.words, self.stems, self.beta, self._lexicon = words, stems, beta, None

    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.words | base_lexicon(), self.stems)
        return self._lexicon

    def __getstate__(self):
        return self.__dict__ | {"_lexicon": None}

    def score(self, docs: list[bytes]) -> np.ndarray:
        x = np.array([self.lexicon().features(t) for t in docs], np.float64).reshape(-1, len(FIXED))
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


#: The calibration where nothing is learned: a mention alone stays under 0.3, a match passes it.
FIXED = np.array([-4.0, 1.0, 3.0, 1.0, 1.0, 0.5, 0.5])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + penalty * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - penalty * np.array([0, *beta[1:]]))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def cutoff(found: dict[int, int], tested: int, wrong: float) -> int | None:
    """The least number of tenths of nats that a mark's ratio must reach, so that at most a share `wrong` of those that
    do is there by chance (Benjamini and Hochberg; exp(-ratio) bounds a mark's chance). found: marks by tenths."""
    best, passing = None, 0
    for tenths in sorted(found, reverse=True):
        passing += found[tenths]
        if tested * np.exp(-tenths / 10) <= wrong * passing:
            best = tenths
    return best


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, each: int = 12_000, wrong: float = 0.1, pure: float = 0.95, least: int = 3) -> Model:
    """A model of labels.toxic, from the rows outside the held fold.

    A mark is learned if the likelihood ratio of its rows against chance passes the cutoff for the share `wrong` of false
    discoveries among the marks in `least` rows or more, and its share of toxic rows is at least `pure`, classes weighed
    alike and half a clean row added. Copies would make any of their words look telling, so one of near copies is counted.
    """
    rows = cut(labelled(docs, sample_of(labels, "toxic", folds, held, each)))
    by = class_sizes(labels, "toxic", folds, held)
    fixed = Model({}, {}, FIXED)
    if len(by) < 2:
        return fixed
    once = cut(one_of_copies(rows))
    size = {r["__label"]: r["n"] for r in once.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return fixed
    words, stems = telling(cut(_counts(once)), size, wrong, pure, least)
    model = Model(words, stems, FIXED)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([shared.value.lexicon().features(t) for t in texts(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__label").cast(pa.int32()), x], ["doc_id", "y", "x"])

    got = map_arrow(rows, run, f"doc_id {kind}, y int, x array<double>").orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "y", "x").limit(2 * each).collect()
    x, y = np.array([r["x"] for r in got], np.float64).reshape(-1, len(FIXED)), np.array([r["y"] for r in got], np.float64)
    if len(set(y)) < 2:
        return fixed
    ratio = by[1] / max(1, by[0]) * (y == 0).sum() / max(1, (y == 1).sum())
    return Model(words, stems, _logistic(x, y, np.where(y == 1, ratio, 1.0)))


def telling(counts: DataFrame, size: dict[int, int], wrong: float, pure: float, least: int) -> tuple[dict[str, int], dict[str, int]]:
    """The learned words and stems with their classes, from the counts of marks in size[0] clean and size[1] toxic rows."""
    n, share = F.col("pos") + F.col("neg"), size[1] / (size[0] + size[1])
    part = lambda k, p: F.when(k > 0, k * F.log(k / n / F.lit(p))).otherwise(0.0)
    ratio = part(F.col("pos"), share) + part(F.col("neg"), 1 - share)
    rate = F.col("pos") + F.lit(0.5)
    tested = counts.filter((n >= least) & ~F.col("mark").endswith(">")).withColumn("tenths", F.floor(10 * ratio).cast("int"))
    toxic = (F.col("pos") > share * n) & (rate / (rate + (F.col("neg") + 0.5) * (size[1] / size[0])) >= pure)
    bins = tested.filter(toxic).groupBy("tenths").agg(F.count("*").alias("m")).collect()  # some rows for each doubling of the sample
    limit = cutoff({r["tenths"]: r["m"] for r in bins}, tested.count(), wrong)
    if limit is None:
        return {}, {}
    found = cut(tested.filter(toxic & (F.col("tenths") >= limit)).select("mark", "pos"))  # bounded by the sample
    beginnings = found.filter(F.col("mark").endswith("*"))
    words = counts.filter(~F.col("mark").endswith("*") & ~F.col("mark").endswith(">") & (F.col("pos") > 0)).select("mark", "pos")
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda k: F.concat(F.substring("mark", F.lit(1), k), F.lit("*")))
    under = words.filter(F.length("mark") > SHORTEST).select(F.explode(F.array_distinct(starts)).alias("mark"), "pos").groupBy("mark").agg(F.max("pos").alias("top"), F.sum("pos").alias("all"), F.count_if(F.col("pos") > 1).alias("kinds"))
    shared = beginnings.join(under, "mark").filter((F.col("kinds") >= 3) & (F.col("top") <= 0.6 * F.col("all"))).select("mark").collect()
    every = {r["mark"][:-1] for r in shared}
    stems = {s for s in every if not any(s[:k] in every for k in range(SHORTEST, len(s)))}
    whole = {r["mark"]: r["pos"] for r in found.filter(~F.col("mark").endswith("*")).collect()}
    before = counts.filter(F.col("mark").endswith(">")).select(F.expr("substring(mark, 1, length(mark) - 1)").alias("mark"), F.col("pos").alias("aimed"))
    violent = {r["mark"] for r in found.join(before, "mark").filter((F.col("aimed") >= 5) & (2 * F.col("aimed") >= F.col("pos"))).collect()}
    return {w: THREAT if w in violent else INSULT for w in whole}, dict.fromkeys(sorted(stems), INSULT)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(texts(batch)))], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def kept(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents with a score under the threshold, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(texts(batch)) < threshold))

    return map_arrow(docs, run, docs.schema)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, clause (its number among the matched ones, from 0), weight of each matched clause."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, w) for i, t in enumerate(texts(batch)) for k, w in enumerate(w for w in shared.value.lexicon().clauses(t)[1] if w >= MATCH)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "clause", "weight"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, clause bigint, weight double")

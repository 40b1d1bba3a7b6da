"""Toxicity from a learned lexicon, misspellings included.

The lexicon holds words and stems (a stem stands for all words that begin with it)
that labelled documents tie to toxicity.  A trie of them is intersected with
Levenshtein automata: a state is the set of (trie node, edits) that a prefix can be
in, and is determinised the first time that a text leads there, so a word is read
once, character by character, against all terms, and mostly ends in the dead state
after a few.  Each match is weighed by its context window: quotation marks around
it and words of reporting near it make it a mention rather than an abuse.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch
from strandloom.llm.textkernel import slices

_WORD = regex.compile(r"[\p{L}\p{N}@$]+")
_OPEN, _CLOSE = "\"“„«‹‘", "\"”“»›’"
#: Words that report another's words; a fixed part of the method, in the languages of the corpus.
REPORTING = frozenset("said says called quoted quote word term slur dit mot terme cité sagte nannte wort zitat dijo llamó palabra cita".split())
WINDOW = 6
MANY = 3


def edits(term: str) -> int:
    """Edits that a term of this length is matched with: 0 under five letters, 1 to eight, 2 beyond."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The trie of a lexicon under Levenshtein automata, determinised as words are read.

    ``terms``: (text, is_stem).  ``find(word)``: the (term number, edits) of the best match
    of each term in the word, as a tuple; () for almost all words.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget = [0]
        for number, (term, _) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.child[node][c]
            self.ends[node].append(number)
            node = 0
            for c in ["", *term]:
                node = self.child[node][c] if c else node
                self.budget[node] = max(self.budget[node], edits(term))
        self.letters = {c for x in self.child for c in x}
        self.states: dict[tuple, int] = {}
        self.rows: list[dict[str, int]] = []
        self.nodes: list[tuple] = []
        self.dead = self._state({}, {})
        self.begin = self._state(self._closed({0: 0}), {})

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """With the letters of terms that the word leaves out."""
        todo = list(at)
        while todo:
            node = todo.pop()
            for to in self.child[node].values():
                cost = at[node] + 1
                if cost <= self.budget[to] and cost < at.get(to, 99):
                    at[to] = cost
                    todo.append(to)
        return at

    def _state(self, at: dict[int, int], stems: dict[int, int]) -> int:
        for node, cost in at.items():
            for number in self.ends[node]:
                term, stem = self.terms[number]
                if stem and cost <= edits(term) and cost < stems.get(number, 99):
                    stems = stems | {number: cost}
        key = (frozenset(at.items()), frozenset(stems.items()))
        if key not in self.states:
            self.states[key] = len(self.rows)
            self.rows.append({})
            full = dict(stems)
            for node, cost in at.items():
                for number in self.ends[node]:
                    term, stem = self.terms[number]
                    if not stem and cost <= edits(term):
                        full[number] = min(cost, full.get(number, 99))
            self.nodes.append((at, stems, tuple(sorted(full.items()))))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        at, stems, _ = self.nodes[state]
        to: dict[int, int] = {}
        for node, cost in at.items():
            if cost + 1 <= self.budget[node]:  # a letter too many
                to[node] = min(cost + 1, to.get(node, 99))
            for letter, next_ in self.child[node].items():
                price = cost + (letter != c)
                if price <= self.budget[next_]:
                    to[next_] = min(price, to.get(next_, 99))
        return self._state(self._closed(to), stems)

    def find(self, word: str) -> tuple[tuple[int, int], ...]:
        state = self.begin
        for c in word:
            row = self.rows[state]
            if c not in self.letters:
                c = ""
            to = row.get(c)
            if to is None:
                to = row[c] = self._step(state, c)
            state = to
            if state == self.dead:
                return ()
        return self.nodes[state][2]


class _Found(dict):
    """Words already looked up, up to a bound."""

    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def __missing__(self, word: str) -> tuple:
        found = self.matcher.find(word)
        if len(self) < 200_000 and len(word) <= 40:
            self[word] = found
        return found


@dataclass
class Model:
    """``weights``: by (term number, edits, matches up to ``MANY``), the evidence of abusive matches; ``scale``, ``offset``: evidence to log-odds."""

    terms: list[tuple[str, bool]]
    weights: dict[tuple[int, int, int], float] = field(default_factory=dict)
    scale: float = 1.0
    offset: float = -2.0

    def matches(self, text: str, found: _Found) -> list[tuple[int, int, float]]:
        """(term number, edits, abuse) of each match; abuse is 1 for plain use and falls to 0.2 for quotation."""
        lower = text.lower()
        out: list[tuple[int, int, float]] = []
        tokens = _WORD.findall(lower)
        hits = [i for i, w in enumerate(tokens) if found[w]]
        if not hits:
            return out
        words = list(_WORD.finditer(lower))
        for i in hits:
            begin, end = words[i].span()
            before = lower[words[max(0, i - WINDOW)].start() : begin]
            after = lower[end : words[min(len(words) - 1, i + WINDOW)].end()]
            quoted = any(c in before for c in _OPEN) and any(c in after for c in _CLOSE)
            tight = before[-1:] in _OPEN and after[:1] in _CLOSE if before and after else False
            reported = not REPORTING.isdisjoint(tokens[max(0, i - WINDOW) : i])
            abuse = 1 - 0.8 * (0.7 * (quoted or tight) + 0.3 * reported if quoted or tight else 0.25 * reported)
            number, cost = min(found[tokens[i]], key=lambda x: (x[1], x[0]))
            out.append((number, cost, abuse))
        return out

    def levels(self, text: str, found: _Found) -> dict[tuple[int, int], tuple[int, float]]:
        """By term and edits: how many matches are abusive, up to ``MANY``, and the most abusive one's abuse."""
        out: dict[tuple[int, int], tuple[int, float]] = {}
        for number, cost, abuse in self.matches(text, found):
            n, most = out.get((number, cost), (0, 0.0))
            out[number, cost] = min(MANY, n + (abuse > 0.6)), max(most, abuse)
        return out

    def evidence(self, levels: dict[tuple[int, int], tuple[int, float]]) -> float:
        best: dict[int, float] = {}
        for (number, cost), (n, abuse) in levels.items():
            best[number] = max(best.get(number, 0.0), abuse * self.weights.get((number, cost, max(n, 1)), 0.0))
        return sum(best.values())

    def score(self, text: str, found: _Found) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * self.evidence(self.levels(text, found)) + self.offset))))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for at, texts in slices(batch, "text"):
        for i, t in enumerate(texts):
            yield at + i, t.decode()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_terms: int = 2_000, max_stem: int = 64) -> Model:
    """A model from labelled rows, of which a sample of about ``max_rows`` is used, chosen by a hash of the id.

    ``labels``: one row for each labelled id; null labels and ids are left out, and of an id
    with several labels the largest counts.  The lexicon has ``max_terms`` terms at most, the
    best first: whole words of any length, and stems of up to ``max_stem`` letters.  Counts are made where the rows are; the driver gets the lexicon and sums.
    Without a labelled row of either kind the lexicon is empty and every score is below 0.5.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    labels = labels.groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    n = labels.count()
    share = min(1.0, max_rows / max(n, 1))
    chosen = labels.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(chosen, id_col).select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for i, text in _texts(batch):
                seen[toxic[i]].update(set(_WORD.findall(text.lower())))
                seen[toxic[i]][""] += 1
            if sum(map(len, seen)) > 500_000:
                yield _counted(seen)
                seen[0].clear(), seen[1].clear()
        yield _counted(seen)

    counts = rows.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    counts = scratch.save(counts)
    totals = counts.where("word = ''").select("clean", "toxic").first()
    if not totals or not totals.toxic or not totals.clean:
        return Model([])
    ratio = totals.clean / totals.toxic
    begun = counts.where("word <> ''").select("word", "clean", "toxic", F.explode(F.array_union(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.char_length("word"), F.lit(max_stem)))), F.array(F.char_length("word")))).alias("n"))
    stems = (
        begun.where((F.char_length("word") >= F.col("n")) & (F.col("n") >= 3))
        .groupBy(F.expr("left(word, n)").alias("stem"))
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.max(F.when(F.char_length("word") == F.col("n"), F.col("toxic")).otherwise(0)).alias("word_toxic"), F.max(F.when(F.char_length("word") == F.col("n"), F.col("clean")).otherwise(0)).alias("word_clean"))
    )
    surely, perhaps = F.col("toxic") - 3 * F.sqrt("toxic"), F.col("clean") + 3 * F.sqrt("clean") + 1  # three standard errors
    odds = F.log(surely * ratio / perhaps)
    best = stems.withColumn("odds", odds).where((F.col("toxic") > 9) & (F.col("odds") > 1.5)).orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "stem").limit(20 * max_terms).collect()
    model = Model(_lexicon(best, max_terms))
    return _weighed(model, rows, totals.toxic, totals.clean)


def _counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    words = list(seen[0].keys() | seen[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], ["word", "clean", "toxic"])


def _lexicon(rows: list, max_terms: int) -> list[tuple[str, bool]]:
    """Of candidate stems the ones that explain the most, none of which begins with another.

    A stem gives way to a longer one that is as frequent; a stem nearly all of whose
    occurrences are the very word is that word.
    """
    count = {r.stem: r for r in rows}
    best: dict[str, tuple[str, float]] = {}
    for r in rows:
        for n in range(3, len(r.stem)):
            short = r.stem[:n]
            if short in count and r.toxic >= 0.9 * count[short].toxic and len(r.stem) > len(best.get(short, ("", 0))[0]):
                best[short] = r.stem, r.toxic
    terms: list[tuple[str, bool]] = []
    for r in sorted(rows, key=lambda r: (-r.odds, -r.toxic, r.stem)):
        if r.stem in best or any(r.stem.startswith(t) for t, _ in terms):
            continue
        stem = r.word_toxic < 0.9 * r.toxic
        terms.append((r.stem, stem))
        if len(terms) == max_terms:
            break
    return terms


def _weighed(model: Model, rows: DataFrame, toxic: int, clean: int) -> Model:
    """Weights from how many sampled documents of either kind each match is in; then scale and offset, by logistic regression."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = _Found(Matcher(model.terms)), defaultdict(Counter)
        for batch in batches:
            label = batch.column(1).to_pylist()
            for i, text in _texts(batch):
                hits = sorted((*k, n) for k, (n, _) in model.levels(text, found).items())
                docs[tuple(hits)][label[i]] += 1
        rows = [(";".join(f"{n},{c},{k}" for n, c, k in hits), x[0], x[1]) for hits, x in docs.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], ["hits", "clean", "toxic"])

    sums = rows.mapInArrow(seen, "hits string, clean long, toxic long").groupBy("hits").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    patterns = [([tuple(map(int, h.split(","))) for h in r.hits.split(";") if h], r.clean, r.toxic) for r in sums]
    patterns = _needed(model, patterns, clean / toxic)
    by: dict[tuple[int, int, int], list[int]] = defaultdict(lambda: [0, 0])
    for hits, c, t in patterns:
        for number, cost, level in hits:
            for k in {level, -1} if level else ():  # -1: at any level
                by[number, cost, k][0] += c
                by[number, cost, k][1] += t
    for number, (term, _) in enumerate(model.terms):
        for cost in range(edits(term) + 1):
            c, t = by[number, cost, -1]
            expected = 0.5 if cost == 0 else by[number, 0, -1][1] * (0.05, 0.01)[cost - 1]  # misspellings
            c, t = c + 0.5, t + expected + 1e-9
            least = 0.0
            for level in range(1, MANY + 1):
                some = (5 + by[number, cost, level][0]) / (c + 5), (5 * t / c + by[number, cost, level][1]) / (t + 5 * t / c)
                odds = math.log(t / (toxic + 1)) - math.log(c / (clean + 1)) + math.log(some[1]) - math.log(some[0])
                least = model.weights[number, cost, level] = max(least, odds)
    x = np.array([model.evidence({(n, e): (k, 1.0 if k else 0.4) for n, e, k in hits}) for hits, _, _ in patterns])
    y = np.array([[t, c] for _, c, t in patterns], float)
    at = np.array([1.0, -3.0])  # also what the weak prior pulls to

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float((y[:, 0] * np.logaddexp(0, -z) + y[:, 1] * np.logaddexp(0, z)).sum() + 0.5 * (at[0] - 1) ** 2 + 0.5 * (at[1] + 3) ** 2)

    for _ in range(60):  # Newton steps, halved until they improve
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        n = y.sum(1)
        error, w = y[:, 0] - n * p, n * p * (1 - p)
        gradient = np.array([(error * x).sum() - (at[0] - 1), error.sum() - (at[1] + 3)])
        step = np.linalg.solve(np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]]), gradient)
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    model.scale, model.offset = float(max(at[0], 0.1)), float(min(at[1], -0.5))
    return model


def _needed(model: Model, patterns: list, ratio: float) -> list:
    """Keeps the terms that, the best first, account for toxic documents that no better term is in, and those like them.

    Words of one much copied toxic document look telling by themselves; next to the term
    that made it toxic they account for nothing.  Returns the patterns in the new numbers.
    """

    def counts(rows: list, number: int) -> tuple[list[bool], float, float]:
        mine = [any(n == number and not e and abuse for n, e, abuse in hits) for hits, _, _ in rows]
        c, t = (sum(x[k] for x, m in zip(rows, mine) if m) for k in (1, 2))
        return mine, t, math.log((t - 3 * math.sqrt(t)) * ratio / (c + 3 * math.sqrt(c) + 1)) if t > 9 else -1.0

    left, own = list(patterns), {n: counts(patterns, n)[1:] for n in range(len(model.terms))}
    kept = []
    for number in range(len(model.terms)):
        mine, _, odds = counts(left, number)
        if odds > 1.5:
            kept.append(number)
            left = [x for x, m in zip(left, mine) if not m]
    if kept:  # and terms as frequent and telling as those
        often, telling = (float(np.median([own[n][k] for n in kept])) for k in (0, 1))
        kept = sorted({*kept, *(n for n, (t, odds) in own.items() if t >= 0.3 * often and odds >= 0.7 * telling)})
    number = {old: new for new, old in enumerate(kept)}
    model.terms = [model.terms[k] for k in kept]
    return [([(number[n], e, a) for n, e, a in hits if n in number], c, t) for hits, c, t in patterns]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, 0 to 1, from its whole text alone.

    Null and empty texts have no match and get the score of such texts.  Repeated rows are
    all returned; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(Matcher(model.terms))
        for batch in batches:
            scores = [model.score(text, found) for _, text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more.  No shuffle.

    Null and empty texts have the score of texts without a match and stay; null ids do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(Matcher(model.terms))
        for batch in batches:
            texts = (t for _, part in slices(batch, text_col) for t in part)
            keep = [model.score(t.decode(), found) < threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that is never learned from: crc32 of the id as text, modulo 5, is 0; false for null."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(False))

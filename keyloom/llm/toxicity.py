"""Toxicity: a lexicon searched with misspellings, and context windows.

From a bounded sample of labelled texts (``SAMPLE_ROWS``, read whole) the words
and stems that mark toxic texts are learned by their log-likelihood ratio; they
form tries of ``TRIE_TERMS`` terms, each intersected with Levenshtein automata
(``levenshtein.py``); a term whose misspellings are ordinary words of clean texts
allows no edits, and so does one of over ``LONG`` letters, which is looked up
whole. A misspelled hit weighs as much as it is alike to the term. Around each hit a window of
``WINDOW`` words on each side is searched for signs of quotation (quote marks on
both sides, a verb of reporting) and of address (second person, exclamation). A
logistic regression over a text's hits, by kind, gives the score. Scoring is a map
over whole texts: nothing is shuffled. Stems are the beginnings of ``STEMS``
letters; longer beginnings only count as whole words.

Defined results: a null or empty text has no hits and scores as a text without
any; without usable labels the lexicon is empty and every text scores 0 (kept);
rows that repeat an id are scored each for itself; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import buffers, code_points, released, runs, slices
from .common import two_columns
from .levenshtein import Term, build
from .training import held_out_flag, labelled_sample

MODULUS, HELD_OUT = 5, 0
SAMPLE_ROWS = 12_000
#: Terms that one trie takes in; the lexicon has as many tries as it needs.
TRIE_TERMS = 96
#: What a term must show.
LEAST_RATIO = 20.0
LEAST_PRECISION = 0.6
STEMS = (4, 5, 6, 7)
#: Letters from which a term is looked up whole.
LONG = 32
WINDOW = 8
#: Share of the sample whose clean texts may hold misspellings of a term, before they count as ordinary words.
ORDINARY = 2e-3
LEAST = 3
#: Terms, and terms with their places, that a worker holds before it passes them on.
TERMS_HELD = 100_000
PLACES_HELD = 100_000

#: Signs of quotation and of address, in the languages of the corpus.
QUOTE_MARKS = re.compile("[\"“”«»„‟‘]")
REPORTING = re.compile(r"\b(said|says|called|calls|wrote|writes|quoted?|quoting|word|term|sagte|schrieb|genannt|dit|écrit|appelé|dijo|escribió|llamó)\b")
ADDRESS = re.compile(r"\b(you|your|you're|ur|du|dich|dein|ihr|tu|toi|vous|ton|tú|usted|eres)\b|!")

N_FEATURES = 5


def _words(text: str) -> list[str]:
    return [w for w in _word_pattern().findall(text.lower()) if not w.isdigit()]


@cache
def word_characters() -> np.ndarray:
    """Code point -> is it part of a word: letters, digits, marks that combine with them, and the soft hyphen."""
    return np.array([c.isalnum() or c == "\xad" or category(c)[0] == "M" for c in map(chr, range(0x110000))])


@cache
def _word_pattern() -> re.Pattern:
    starts, ends, _ = runs(word_characters(), np.array([0, 0x110000]))
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)) + "]+")


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, end of each word in them, words of each document, byte where each code point starts and the end)."""
    points, at = code_points(data)
    starts, ends, per_doc = runs(word_characters()[points], np.searchsorted(at, offsets))
    return points, starts, ends, per_doc, at


def _terms_of(word: str) -> list[str]:
    """The word, marked ``=``, and its beginnings, marked ``^``."""
    return ["=" + word, *("^" + word[:n] for n in STEMS if len(word) >= n)] if len(word) >= 3 else []


def learn_lexicon(sample: DataFrame) -> list[Term]:
    """Words, and beginnings of words, that stand in toxic texts far more often than in others."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}

        def flushed() -> pa.RecordBatch:
            # a term of no toxic text is no candidate here; what this part lacks, another may have
            names = list(counts[True] | counts[False])
            columns = [pa.array(names, pa.string()), *(pa.array([counts[label][t] for t in names], pa.int64()) for label in (True, False))]
            for own in counts.values():
                own.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                counts[label == 1].update({t for w in set(_words(text.as_py())) for t in _terms_of(w)})
                # what comes in parts is summed below
                if len(counts[True]) + len(counts[False]) >= TERMS_HELD:
                    yield flushed()
        yield flushed()

    totals = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n_toxic, n_clean = int(totals[0] or 0), int(totals[1] or 0)
    if min(n_toxic, n_clean) < LEAST:
        return []
    found = sample.select("text", "label").mapInArrow(released(tally), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = found.where((F.col("toxic") >= 3) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    # copies of one toxic text repeat its words between the same neighbours: they count as one, before any term is left out
    found = found.join(context_counts(sample), "term")
    found = found.withColumn("ratio", _likelihood_ratio(F.least("toxic", "places"), n_toxic, F.col("clean"), n_clean))
    scored = []
    # strong terms of the bounded sample, all of them: stems and words that cover each other are told apart below
    for r in found.where(F.col("ratio") >= LEAST_RATIO).select("term", "toxic", "clean", "ratio").collect():
        weight = math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1))
        scored.append((-r["ratio"], r["term"][0] == "^", -len(r["term"]), r["term"], weight))
    terms: dict[str, Term] = {}
    stems: set[str] = set()
    begun: set[str] = set()
    for _, stem, _, name, weight in sorted(scored):
        text = name[1:]
        # what an accepted stem covers, or what only begins an accepted term, adds nothing
        if any(text[:n] in stems for n in STEMS) or text in begun:
            continue
        n = len(text)
        edits = 0 if n > LONG else (1 if n >= 6 else 0) if stem else 2 if n >= 9 else 1 if n >= 5 else 0
        terms[text] = Term(text, stem, weight, edits)
        begun.update([text, *(text[:k] for k in STEMS)])
        if stem:
            stems.add(text)
    return list(terms.values())


def context_counts(sample: DataFrame) -> DataFrame:
    """(term, places): between how many different pairs of neighbours each term stands in the toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()

        def flushed() -> pa.RecordBatch:
            found = list(zip(*seen, strict=True)) or [(), ()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found[0]), pa.string()), pa.array(list(found[1]), pa.int64())], names=["term", "place"])

        for batch in batches:
            for text in batch.column("text"):
                words = ["", *_words(text.as_py()), ""]
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    place = zlib.crc32(f"{before} {after}".encode())
                    seen.update((t, place) for t in _terms_of(word))
                    # what comes twice is made distinct below
                    if len(seen) >= PLACES_HELD:
                        yield flushed()
        yield flushed()

    pairs = sample.where("label = 1").select("text").mapInArrow(released(run), "term string, place long")
    return pairs.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("places"))


def _likelihood_ratio(k1: Column, n1: int, k2: Column, n2: int) -> Column:
    def ll(k: Column, n: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)

    p = (k1 + k2) / (n1 + n2)
    return 2 * (ll(k1, n1, k1 / n1) + ll(k2, n2, k2 / n2) - ll(k1, n1, p) - ll(k2, n2, p))


class Lexicon:
    """Terms as tries of bounded size, and a table of the long ones."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        short = [k for k, t in enumerate(terms) if len(t.text) <= LONG]
        self.parts = [np.array(short[at : at + TRIE_TERMS], dtype=np.int64) for at in range(0, len(short), TRIE_TERMS)]
        self.automata = [build([terms[k] for k in part]) for part in self.parts]
        self.long = {t.text: k for k, t in enumerate(terms) if len(t.text) > LONG}

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of each word that is within a term's edits: the closest term, of these the first."""
        found = []
        for part, automaton in zip(self.parts, self.automata, strict=True):
            words, terms, edits = automaton.match(points, starts, ends)
            found.append((words, part[terms], edits))
        if self.long:
            rows = [(w, self.long.get("".join(map(chr, points[starts[w] : ends[w]].tolist())), -1), 0) for w in np.flatnonzero(ends - starts > LONG).tolist()]
            rows = [r for r in rows if r[1] >= 0]
            found.append(tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3)
        words, terms, edits = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        order = np.lexsort((terms, edits, words))
        words, terms, edits = words[order], terms[order], edits[order]
        first = np.ones(len(words), dtype=bool)
        first[1:] = words[1:] != words[:-1]
        return words[first], terms[first], edits[first]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    coefficients: np.ndarray
    bias: float

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row for each document: weights of plain and of quoted hits, hits that address someone, different terms, density; texts without hits have zeros."""
        out = np.zeros((len(offsets) - 1, N_FEATURES))
        if not self.lexicon.terms:
            return out
        points, starts, ends, per_doc, at = words_of(data, offsets)
        words, terms, edits = self.lexicon.match(points, starts, ends)
        if not len(words):
            return out
        upto = np.cumsum(per_doc)
        doc_of = np.searchsorted(upto, words, side="right")
        sums: dict[int, list] = {}
        for word, term, edit, doc in zip(words.tolist(), terms.tolist(), edits.tolist(), doc_of.tolist(), strict=True):
            # the window: WINDOW words on each side with what stands between and around them
            first, last = int(upto[doc] - per_doc[doc]), int(upto[doc]) - 1
            low = int(at[ends[word - WINDOW - 1]]) if word - WINDOW > first else int(offsets[doc])
            high = int(at[starts[word + WINDOW + 1]]) if word + WINDOW < last else int(offsets[doc + 1])
            quoted, address = self._context(data[low : at[starts[word]]], data[at[ends[word]] : high])
            own = sums.setdefault(doc, [0.0] * 3 + [set()])
            hit = self.lexicon.terms[term]
            own[quoted] += hit.weight * (1 - edit / len(hit.text))
            own[2] += address
            own[3].add(term)
        for doc, own in sums.items():
            out[doc, :3] = np.log1p(np.maximum(own[:3], 0))
            out[doc, 3] = math.log1p(len(own[3]))
            out[doc, 4] = own[0] / max(1, per_doc[doc]) * 10
        return out

    @staticmethod
    def _context(left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        """(is the hit quoted?, is someone addressed?) from what stands around it."""
        before, after = left.tobytes().decode("utf-8", "ignore"), right.tobytes().decode("utf-8", "ignore")
        quoted = bool(QUOTE_MARKS.search(before) and QUOTE_MARKS.search(after)) or bool(REPORTING.search(before) and QUOTE_MARKS.search(after))
        return int(quoted), int(bool(ADDRESS.search(before) or ADDRESS.search(after)))

    def logits(self, column: pa.Array) -> np.ndarray:
        data, offsets = buffers(pc.utf8_lower(column))
        rows = [self.features(part, cuts) @ self.coefficients for _, _, part, cuts in slices(data, offsets)]
        return np.concatenate([np.zeros(0), *rows]) + self.bias


def _regress(x: np.ndarray, y: np.ndarray, rounds: int = 3000, rate: float = 0.5, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression; plain hits never count against toxicity."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w, b = x / scale, np.zeros(x.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    g2, h2 = np.full(x.shape[1], 1e-6), 1e-6
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-np.clip(z @ w + b, -60, 60))) - y
        grad, gb = z.T @ wrong / len(y) + ridge * w, wrong.mean()
        g2 += grad * grad
        h2 += gb * gb
        w -= rate * grad / np.sqrt(g2)
        b -= rate * gb / math.sqrt(h2)
        w[0] = max(w[0], 0.0)
    return w / scale, float(b)


def trusted_edits(sample: DataFrame, terms: list[Term]) -> list[Term]:
    """The terms, those without edits whose misspellings are ordinary words of clean texts."""
    sent = sample.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        for batch in batches:
            data, offsets = buffers(pc.utf8_lower(batch.column("text")))
            clean = np.array(batch.column("label")) == 0
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for first, _, part, cuts in slices(data, offsets):
                points, starts, ends, per_doc, _ = words_of(part, cuts)
                words, hits, edits = lexicon.match(points, starts, ends)
                doc = first + np.searchsorted(np.cumsum(per_doc), words, side="right")
                some = (edits > 0) & clean[doc]
                found.append((hits[some], doc[some]))
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            hits, n = np.unique(pairs[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hits), pa.array(n)], names=["term", "n"])

    rows = sample.select("text", "label").mapInArrow(tally, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    often = max(1, sample.count() * ORDINARY)
    ordinary = {r["term"] for r in rows if r["n"] > often}
    return [replace(t, edits=0) if k in ordinary else t for k, t in enumerate(terms)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn lexicon and weights from at most ``rows`` labelled texts outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows, "toxicity")
    terms = learn_lexicon(sample)
    if terms:
        terms = trusted_edits(sample, terms)
    model = ToxicityModel(Lexicon(terms), np.zeros(N_FEATURES), -30.0)
    if not terms:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(pc.utf8_lower(batch.column("text")))
            x = np.concatenate([np.zeros((0, N_FEATURES)), *(sent.value.features(part, cuts) for _, _, part, cuts in slices(data, offsets))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sample.select("doc_id", "label", "text").mapInArrow(released(hits), "doc_id long, label int, x array<double>").collect()
    sent.destroy()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["label"] for r in got], dtype=float)
    model.coefficients, model.bias = _regress(x, y)
    return model


SCHEMA = "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(sent.value.logits(batch.column(1)), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = two_columns(docs, id_col, text_col).mapInArrow(released(run), SCHEMA)
    return scored.select("doc_id", held_out_flag(MODULUS, HELD_OUT).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text isn't rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(place), "")
            yield batch.filter(pa.array(sent.value.logits(text) < 0))

    return docs.mapInArrow(released(run), docs.schema)

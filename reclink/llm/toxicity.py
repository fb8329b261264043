"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

Fitting uses a bounded sample of labelled rows (``TRAIN_DOCS``, chosen by a hash of the id) that are not held out:

1. Lexicon.  Words and word beginnings (``STEM`` letters) that occur in toxic documents are counted by the number of their
   distinct contexts (the word and the one before it), so that copies of a document count once; then the same in the other
   documents.  Terms with enough contexts and a high share of toxic ones stay, all of them and of any length.  The counts are
   grouped aggregations; only terms that pass the first threshold reach the driver.
2. Weights.  The features below of the sample's documents, a few numbers each, go into a logistic regression whose prior
   says that exact hits count most, misspelt ones less, quoted ones least.

Scoring a document: every word is looked up, exactly, by its beginning, and, where neither is found, by running the
Levenshtein automaton of the word (1 edit from 5 letters on, 2 from 9 on) against the trie of the lexicon's words.  A hit is
quoted if it stands within quotation marks or after a word of reporting in its window of ``WINDOW`` words; else the other
hits in the window add to it, as abuse comes in clusters.  Documents are scored whole and alone; nothing is shuffled.

Defined cases: a null or empty text has no hits and the score of such a text; repeated rows get equal scores; no labels, or
labels of one class: a constant score (0.5 without labels); labels of null are ignored, several of one document: toxic if
any is; a null id is not held out and never labelled; of rows that repeat a labelled id the one with the first text is
learnt from; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.logistic import fit as fit_weights
from reclink.llm.logistic import sigmoid
from reclink.session import written

TRAIN_DOCS = 12_000
STEM, WINDOW, LEAST_CONTEXTS, LEAST_SHARE = range(3, 8), 8, 6, 0.8
#: Words in one generation of a matcher's memory, which changes only the speed.
KNOWN = 300_000
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_QUOTES = re.compile("[\"“”„«»]")
_REPORTS = frozenset("said says wrote writes called calls quoted quote reported dit écrit appelé dijo dice escribió llamó sagte sagt schrieb nannte zitat".split())
FEATURES = ("any_plain", "plain", "any_quoted", "quoted", "any_fuzzy", "fuzzy", "window", "density")
PRIOR = np.array([3.0, 1.0, 0.3, 0.1, 1.5, 0.5, 0.5, 0.0, -3.0])


class LevenshteinAutomaton:
    """The automaton that accepts what is within ``most`` edits of a word; a state has, for each number of edits, a bit for each position."""

    def __init__(self, word: str, most: int):
        self.end, self.most, self.at = 1 << len(word), most, {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << i
        self.all = (self.end << 1) - 1

    def start(self) -> tuple[int, ...]:
        return tuple(((1 << e + 1) - 1) & self.all for e in range(self.most + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...] | None:
        """The next state, or None if nothing can be accepted any more."""
        same, out, old, new = self.at.get(char, 0), [], 0, 0
        for row in state:
            # the word's character, another one in its place, one too many; one left out
            new = ((row & same) << 1 | old << 1 | old | new << 1) & self.all
            old = row
            out.append(new)
        return tuple(out) if new else None

    def distance(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, row in enumerate(state) if row & self.end), None)


class Trie:
    """Words as nested dictionaries; '' marks an end."""

    def __init__(self, words):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def nearest(self, word: str, most: int) -> tuple[str, int] | None:
        """The lexicon word with the fewest edits (the first by alphabet on ties), from the intersection with the word's automaton."""
        automaton, best = LevenshteinAutomaton(word, most), None
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            if "" in node and (d := automaton.distance(state)) is not None and (best is None or (d, node[""]) < best):
                best = (d, node[""])
            for c, child in node.items():
                if c and (then := automaton.step(state, c)):
                    stack.append((child, then))
        return (best[1], best[0]) if best else None


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Model:
    """Lexicon, beginnings, and weights of the features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] | None = None
    base: float = 0.5

    def matcher(self) -> Matcher:
        return Matcher(self)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.base)
        w = np.array(self.weights)
        return sigmoid(features @ w[:-1] + w[-1])


class Matcher:
    """Looks up the words of texts; remembers a bounded number of words that are no hits."""

    def __init__(self, model: Model):
        self.model = model
        long = [w for w in model.words if edits_for(len(w))]
        self.trie = Trie(long)
        # an edit leaves one half of a word as it is, two edits one third, near its place: words that share none of these pieces so are no candidates
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for w in long:
            n = edits_for(len(w) + edits_for(len(w))) + 1
            for i in range(n):
                a, b = i * len(w) // n, (i + 1) * len(w) // n
                self.pieces.setdefault(w[a:b], []).append((a, len(w)))
        self.piece = re.compile("|".join(map(re.escape, sorted(self.pieces))) or r"(?!)").search
        self.piece_lengths = sorted({len(p) for p in self.pieces})
        self.long_lengths = {len(w) for w in long}
        # words that are no hits and words that are, and those of the generation before
        self.known: set[str] = set()
        self.hits: dict[str, tuple[float, bool]] = {}
        self.before: tuple[set[str], dict[str, tuple[float, bool]]] = set(), {}
        lengths = sorted({len(s) for s in model.stems})
        self.stem_lengths = lengths

    def look_up(self, chunk: str) -> tuple[float, bool] | None:
        """(weight, exact) of a word with its punctuation, or None."""
        word = _EDGES.sub("", chunk.lower())
        if not word:
            return None
        if word in self.model.words:
            return self.model.words[word], True
        for n in self.stem_lengths:
            if len(word) >= n and word[:n] in self.model.stems:
                return self.model.stems[word[:n]], True
        most = edits_for(len(word))
        if most and self.may_be_near(word, most) and (found := self.trie.nearest(word, most)) and found[1] <= edits_for(len(found[0])):
            return self.model.words[found[0]] * (1 - 0.25 * found[1]), False
        return None

    def may_be_near(self, word: str, most: int) -> bool:
        """Whether a piece of some lexicon word of fitting length stands in ``word`` where that many edits can have moved it."""
        n = len(word)
        if self.long_lengths.isdisjoint(range(n - most, n + most + 1)) or not self.piece(word):
            return False
        for size in self.piece_lengths:
            for i in range(n - size + 1):
                for at, length in self.pieces.get(word[i : i + size], ()):
                    if -most <= i - at <= most and -most <= n - length <= most:
                        return True
        return False

    def features(self, text: str) -> list[float]:
        chunks = text.split()
        distinct = set(chunks)
        if len(self.known) + len(self.hits) > KNOWN:
            self.before, self.known, self.hits = (self.known, self.hits), set(), {}
        known, hits = self.before
        for chunk in distinct - self.known - self.hits.keys():
            if chunk in known or not (hit := hits.get(chunk) or self.look_up(chunk)):
                self.known.add(chunk)
            else:
                self.hits[chunk] = hit
        lookup = {c: self.hits[c] for c in self.hits.keys() & distinct}
        return self._in_context(chunks, lookup) if lookup else [0.0] * len(FEATURES)

    def _in_context(self, chunks: list[str], lookup: dict[str, tuple[float, bool]]) -> list[float]:
        places = [(i, *lookup[c]) for i, c in enumerate(chunks) if c in lookup]
        plain, quoted, fuzzy, best = 0.0, 0.0, 0.0, 0.0
        low = high = 0
        for i, weight, exact in places:
            # a window has at most 2 * WINDOW + 1 places, in order
            while places[low][0] < i - WINDOW:
                low += 1
            while high < len(places) and places[high][0] <= i + WINDOW:
                high += 1
            before = chunks[max(0, i - WINDOW) : i]
            marks = sum(len(_QUOTES.findall(c)) for c in before) + len(_QUOTES.findall(chunks[i][: len(chunks[i]) // 2]))
            after = any(_QUOTES.search(c) for c in chunks[i : i + WINDOW])
            if (marks % 2 and after) or any(_EDGES.sub("", c.lower()) in _REPORTS for c in before[-4:]):
                quoted += weight
                continue
            near = sum(w for _, w, _ in places[low:high])
            best = max(best, near)
            if exact:
                plain += weight
            else:
                fuzzy += weight
        return [float(plain > 0), np.log1p(plain), float(quoted > 0), np.log1p(quoted), float(fuzzy > 0), np.log1p(fuzzy), np.log1p(best), 100 * (plain + fuzzy) / (10 + len(chunks))]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(text: str):
    """(term, context) of each word and its beginnings; beginnings end with '*'."""
    before = ""
    for chunk in text.split():
        word = _EDGES.sub("", chunk.lower())
        if not word:
            continue
        context = hash_of(before + " " + word)
        if len(word) > 2:
            yield word, context
        for n in STEM:
            if len(word) > n:
                yield word[:n] + "*", context
        before = word


def hash_of(text: str) -> int:
    from zlib import crc32

    return crc32(text.encode())


def _contexts(train: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(term, contexts): distinct contexts of each term over the texts, of ``wanted`` terms only if given."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                seen: set[tuple[str, int]] = set()
                for text in batch.column(0).slice(at, 200).to_pylist():
                    seen.update((t, c) for t, c in _terms(text or "") if wanted is None or t in wanted)
                terms, contexts = zip(*seen) if seen else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(contexts, pa.int64())], names=["term", "context"])

    return train.select("text").mapInArrow(run, "term string, context bigint").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("contexts"))


def learn_lexicon(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their log odds."""
    least = max(LEAST_CONTEXTS, n_toxic // 400)
    rows = _contexts(toxic, None).where(F.col("contexts") >= least).collect()
    often = {r["term"]: r["contexts"] for r in rows}
    other = {r["term"]: r["contexts"] for r in _contexts(clean, set(often)).collect()}
    odds = {}
    for term, a in often.items():
        # clean documents as if there were as many as toxic ones
        b = other.get(term, 0) * n_toxic / max(1, n_clean)
        if a / (a + b + 1) >= LEAST_SHARE and other.get(term, 0) <= 0.25 * a:
            odds[term] = float(np.log((a + 0.5) / (b + 0.5)))
    odds = dict(sorted(odds.items(), key=lambda x: (-often[x[0]], x[0])))
    words = {t: w for t, w in odds.items() if not t.endswith("*")}
    stems: dict[str, float] = {}
    for t, w in sorted(odds.items(), key=lambda x: len(x[0])):
        # a beginning must say more than the one word that has it, and be the shortest that does
        if t.endswith("*") and not any(t[:n] in stems for n in STEM if n < len(t) - 1) and often[t] > 1.2 * max((often[x] for x in words if x.startswith(t[:-1])), default=0):
            stems[t[:-1]] = w
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled rows that are not held out (see the module's description)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = known.count()
    share = min(1.0, train_docs / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # at most about train_docs rows, one of an id
    train = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "toxicity-train")
    size = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    n_toxic, n_clean = size.get(1, 0), sum(v for k, v in size.items() if k != 1)
    if not n_toxic or not n_clean:
        return Model(base=1.0 if n_toxic else 0.0 if n_clean else 0.5)
    model = Model(*learn_lexicon(train.where("y = 1"), train.where("y <> 1"), n_toxic, n_clean))
    rows = features(train, model).withColumn("y", F.col("y") == 1).collect()
    x = np.array([r["x"] for r in rows], float)
    model.weights = fit_weights(x, np.array([r["y"] for r in rows], float), PRIOR).tolist()
    return model


def features(train: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        matcher = model.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.features(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    return train.select("y", "text").mapInArrow(run, "y int, x array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row."""

    def run(batches):
        matcher = model.matcher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                s = model.score(np.array([matcher.features(x or "") for x in part.column(2).to_pylist()], float))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(run, f"`{id_col}` bigint, held_out boolean, score double, predicted int")

"""Posterior constraints: rules over segments, first labels, label pairs and alignments, with weights of each mention.

A mention's weights theta >= 0 minimise  log Z(theta) + b.theta + 1/2 sum rho theta^2  by projected gradient steps along the
projection arc.  A penalty takes theta off the score wherever its rule fires; a match adds it.  b counts where a rule can
fire at all: a fixed number for penalties, minus a share for each unique place of a match.  Weights are kept between calls
in a table (mention_id, theta: map<string, double>).

The rules are data: (name, labels, pattern) for tokens, so that the same list gives boolean columns and penalties in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.config import NO_RECORD, WITH_RECORD
from reclink.functions.features import HOTEL_CLASSES, full_match
from reclink.functions.similarity import is_initials
from reclink.functions.text import HOTEL_LEXER  # noqa: F401
from reclink.operators.fields import Field
from reclink.operators.lattice import JOINT, Chain, Row, _lattice_input, _lengths, _sum_exp, forward_backward, joint_batch, lattice_of, viterbi
from reclink.session import ship


@dataclass(frozen=True)
class TokenRule:
    """Fires for each token of a segment that matches while the segment's label is (``inside``) or isn't one of ``labels``."""

    name: str
    labels: tuple[str, ...]
    pattern: str
    inside: bool = False
    negated: bool = False
    lower: bool = False
    next_pattern: str | None = None
    rho: float = 0.01

    def matches(self, words: list[str], k: int) -> bool:
        word = words[k].lower() if self.lower else words[k]
        hit = re.fullmatch(self.pattern, word) is not None
        if self.next_pattern is not None:
            hit = hit and k + 1 < len(words) and re.fullmatch(self.next_pattern, words[k + 1]) is not None
        return hit != self.negated


def _one_of(words: str) -> str:
    return "|".join(map(re.escape, words.split()))


#: Labels, words and patterns of the rules.
HOTEL_RULES = [
    TokenRule("starRatingAndNotMatchesPattern", ("starrating",), r"\d.*\*", inside=True, negated=True),
    TokenRule("notStarRatingAndMatchesPattern", ("starrating",), r"\d.*\*"),
    TokenRule("notOtherAndMatchesPattern", ("O",), "|".join(f"(?:{p})" for _, p in HOTEL_CLASSES)),
]
HOTEL_STOP_WORDS = frozenset({"hotel", "hotels", "resort", "resorts", "in", "or"})
YEAR = r"\(?\s*(?:19|20)\d\d[a-z]?\s*\)?"
PAGES = r"pages|pp\.|\d+\s*[\-{#]{2,}\s*\d+|\d{3,}\s*[\-{#]\s*\d{3,}"
NUMERIC_FIELDS = ("pages", "volume", "date")
CITATION_RULES = [
    TokenRule("matchesPatternAndNotYear", ("date",), YEAR, lower=True, rho=1.0),
    TokenRule("numericFieldAndNotMatchesPattern", NUMERIC_FIELDS, r".*\d.*", rho=1.0),
    TokenRule("numericFieldAndNotMatchesPattern", NUMERIC_FIELDS, r"pages|pp\.?|vol\.?|no\.?", lower=True, next_pattern=r".*\d.*", rho=1.0),
    TokenRule("techField", ("tech",), _one_of("thesis tech technical report ph.d. ph.d"), lower=True),
    TokenRule("techField", ("tech",), "TR", next_pattern=r"[\-\d].*"),
    TokenRule("noteField", ("O",), _one_of("submitted appear"), lower=True),
    TokenRule("booktitleField", ("booktitle",), _one_of("Proc. Proceedings Conference Workshop")),
    TokenRule("journalField", ("journal",), _one_of("Journal IEEE Annals")),
    TokenRule("matchPatternAndNotPage", ("pages",), PAGES, lower=True),
    # no label has this name, so the rule fires for every one
    TokenRule("institutionField", ("institute",), _one_of("University Department Univ Dept Univ. Dept. Institute Corporation Laboratory")),
    TokenRule("editorField", ("editor",), r"[Ee]ditors?|Ed\.|[Ee]ds\."),
    TokenRule("seriesField", ("series",), _one_of("LNCS LNAI Lecture Lectures")),
    TokenRule("publisherField", ("publisher",), _one_of("Press Prentice Publishers Springer Kluwer")),
]
VALID_STARTS = ("O", "author", "editor", "title", "tech")


def rule_fires(rule: TokenRule, word: Column, next_word: Column, label: Column) -> Column:
    """The rule as a column over a token, the one after it and the label of its segment."""
    hit = full_match(F.lower(word) if rule.lower else word, rule.pattern)
    if rule.next_pattern is not None:
        hit = hit & F.coalesce(full_match(next_word, rule.next_pattern), F.lit(False))
    if rule.negated:
        hit = ~hit
    among = label.isin(list(rule.labels))
    return hit & (among if rule.inside else ~among)


def flags(tokens: DataFrame, rules: list[TokenRule]) -> DataFrame:
    """``tokens`` (word, next_word, label) with a boolean column for each rule name."""
    names = dict.fromkeys(r.name for r in rules)
    fires = {n: [rule_fires(r, F.col("word"), F.col("next_word"), F.col("label")) for r in rules if r.name == n] for n in names}
    out = {}
    for n, columns in fires.items():
        one = columns[0]
        for more in columns[1:]:
            one = one | more
        out[n] = one
    return tokens.withColumns(out)


# -- penalties of one mention -----------------------------------------------------------------------------------------


@dataclass
class Penalty:
    """Where a rule fires, and how often: in segments (N, D, L), first labels (L), label pairs (L, L)."""

    name: str
    b: float
    rho: float
    segments: np.ndarray | None = None
    starts: np.ndarray | None = None
    transitions: np.ndarray | None = None

    def may_fire(self, scores: np.ndarray) -> bool:
        live = np.isfinite(scores)
        if self.segments is not None and (self.segments[live] > 0).any():
            return True
        if self.starts is not None and len(scores) and (live[0].any(0) & (self.starts > 0)).any():
            return True
        return self.transitions is not None and len(scores) > 1 and bool((self.transitions > 0).any())


def _token_penalties(rules: list[TokenRule], words: list[str], labels: list[str], depth: int) -> list[Penalty]:
    n, out = len(words), {}
    for name in dict.fromkeys(r.name for r in rules):
        own = [r for r in rules if r.name == name]
        hit = np.array([any(r.matches(words, k) for r in own) for k in range(n)], float)
        among = np.array([x in own[0].labels for x in labels])
        which = among if own[0].inside else ~among
        sums = np.concatenate([[0.0], np.cumsum(hit)])
        begin, d = np.arange(n)[:, None], np.arange(depth)[None, :]
        number = sums[np.minimum(begin + d + 1, n)] - sums[begin]
        out[name] = Penalty(name, 0.0, own[0].rho, number[:, :, None] * which[None, None, :])
    return list(out.values())


def hotel_penalties(words: list[str], labels: list[str], depth: int, ends: np.ndarray) -> list[Penalty]:
    """Rules for hotel texts."""
    single = np.zeros((len(words), depth, len(labels)))
    if "hotelname" in labels:
        single[:, 0, labels.index("hotelname")] = [w in HOTEL_STOP_WORDS for w in words]
    return [*_token_penalties(HOTEL_RULES, words, labels, depth), Penalty("singleHotelStopWord", 0.0, 0.01, single)]


def citation_penalties(words: list[str], labels: list[str], depth: int, ends: np.ndarray) -> list[Penalty]:
    """Rules for citations."""
    n, shape = len(words), (len(words), depth, len(labels))

    def of(*names: str) -> np.ndarray:
        return np.array([x in names for x in labels], float)

    out = _token_penalties(CITATION_RULES, words, labels, depth)
    for name, which, rho in (("countTitleAtMostOne", of("title"), 0.01), ("countJournalAtMostOne", of("journal"), 0.01), ("countBooktitleAtMostOne", of("booktitle"), 0.01), ("countBooktitleOrJournalAtMostOne", of("booktitle", "journal"), 0.1)):
        out.append(Penalty(name, 1.0, rho, np.broadcast_to(which, shape)))
    initials = np.zeros(shape)
    initials[:, 0] = np.array([re.fullmatch(r"[a-z]\.", w.lower()) is not None for w in words], float)[:, None] * of("author", "editor")
    out.append(Penalty("nameContainsOnlyInitials", 0.0, 0.01, initials))
    marker = np.zeros(shape)
    if n:
        numeric = re.search(r"\d", words[0]) is not None
        for d in range(min(depth, n)):
            if ends[d + 1] and (numeric or ("[" in words[0] and "]" in words[d])):
                marker[0, d] = 1 - of("O")
    out.append(Penalty("refMarkerIsNotOther", 0.0, 0.01, marker))
    out.append(Penalty("invalidStart", 0.0, 0.01, starts=1 - of(*VALID_STARTS)))
    for name, label in (("newAuthorsSegment", "author"), ("newEditorSegment", "editor")):
        into = of(label)
        out.append(Penalty(name, 1.0, 1.0, starts=into, transitions=(1 - into)[:, None] * into[None, :]))
    return out


@dataclass
class Domain:
    """What a kind of text is constrained by."""

    penalties: Callable[[list[str], list[str], int, np.ndarray], list[Penalty]]
    iterations: int
    match_share: float
    abbreviations: frozenset[str] = frozenset()
    fields: dict[str, Field] = field(default_factory=dict)


def hotel_domain(fields: list[Field]) -> Domain:
    return Domain(hotel_penalties, 10, 0.99, frozenset({"localarea"}), {f.name: f for f in fields})


def citation_domain(fields: list[Field]) -> Domain:
    return Domain(citation_penalties, 5, 0.95, frozenset(), {f.name: f for f in fields})


def _terms(words: list[str]) -> list[str]:
    out = (re.sub("[^a-z0-9]+", " ", w.lower()).strip() for w in words)
    return list(dict.fromkeys(t for t in out if t))


class Matches:
    """Where spans of a mention match a value: abbrMatch once for a segment, simMatch for each token that is alike by itself."""

    def __init__(self, domain: Domain, words: list[str]):
        self.domain, self.words, self.known = domain, words, {}

    def _similar(self, f: Field, b: int, e: int, value: tuple[str, ...]) -> float:
        key = (f.name, b, e, value)
        if key not in self.known:
            self.known[key] = f.similar(_terms(list(value)), _terms(self.words[b:e]))
        return self.known[key]

    def __call__(self, label: str, b: int, e: int, value: tuple[str, ...]) -> tuple[bool, tuple[int, ...]]:
        """(abbreviation, tokens alike)."""
        f = self.domain.fields.get(label)
        if f is None or label == "O":
            return False, ()
        if label in self.domain.abbreviations and e - b == 1 and self.words[b] and is_initials(self.words[b], list(value)):
            return True, ()
        if self._similar(f, b, e, value) > f.sim_threshold:
            return False, tuple(k for k in range(b, e) if self._similar(f, k, k + 1, value) > 0)
        return False, ()


class Constrained:
    """One mention with its candidates: the objective and its gradient over theta, and the constrained decoding."""

    def __init__(self, row: Row, base: np.ndarray, chain: tuple[np.ndarray, np.ndarray], labels: list[str], candidates: list[dict], domain: Domain, only_segmentation: bool = False):
        self.row, self.base, self.labels = row, base, labels
        self.start, self.transition = chain
        self.none_weight = 0.0 if only_segmentation else NO_RECORD
        self.candidates = [] if only_segmentation else candidates
        self.penalties = [p for p in domain.penalties(row.words, labels, base.shape[1], row.ends) if p.may_fire(base)]
        self.names = [p.name for p in self.penalties] + ["abbrMatch", "simMatch"]
        self.b = np.array([p.b for p in self.penalties] + [0.0, 0.0])
        self.rho = np.array([p.rho for p in self.penalties] + [0.0, 0.0])
        self.n_penalties, self.abbr, self.sim = len(self.penalties), len(self.penalties), len(self.penalties) + 1
        matches, places = Matches(domain, row.words), (set(), set())
        #: for each candidate and label: value ids with numbers of abbreviation and similarity matches (N, D)
        self.choices: list[dict[int, list[tuple[str, np.ndarray, np.ndarray]]]] = []
        n, depth, _ = base.shape
        for c in self.candidates:
            of: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
            for x, label in enumerate(labels):
                if label == "O":
                    continue
                of[x] = []
                for v in (v for v in c["values"] if v["field"] == label):
                    a, s = np.zeros((n, depth)), np.zeros((n, depth))
                    for b, d in zip(*np.nonzero(np.isfinite(base[:, :, x]))):
                        abbreviation, alike = matches(label, int(b), int(b + d + 1), tuple(v["phrase"]))
                        a[b, d], s[b, d] = float(abbreviation), len(alike)
                        if abbreviation:
                            places[0].add(int(b))
                        places[1].update(alike)
                    of[x].append((v["value_id"], a, s))
            self.choices.append(of)
        for at, found in zip((self.abbr, self.sim), places):
            if found:
                self.b[at], self.rho[at] = -domain.match_share * len(found), 0.01

    def _penalised(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores, start, transition = self.base.copy(), self.start.copy(), self.transition.copy()
        for p, t in zip(self.penalties, theta):
            if p.segments is not None:
                scores -= t * p.segments
            if p.starts is not None:
                start -= t * p.starts
            if p.transitions is not None:
                transition -= t * p.transitions
        return scores, start, transition

    def _lattices(self, theta: np.ndarray):
        """(weight, candidate, scores summed over values, best over values) of no record and each candidate."""
        scores, start, transition = self._penalised(theta)
        yield self.none_weight, None, scores, scores, start, transition
        for c, of in zip(self.candidates, self.choices):
            total, top = scores.copy(), scores.copy()
            for x, values in of.items():
                if not values:
                    total[:, :, x] = top[:, :, x] = -np.inf
                    continue
                stack = np.stack([theta[self.abbr] * a + theta[self.sim] * s for _, a, s in values])
                total[:, :, x] += _sum_exp(stack, 0)
                top[:, :, x] += stack.max(0)
            yield WITH_RECORD, c, total, top, start, transition

    def value_and_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        found = [(w, c, forward_backward(total, start, transition)) for w, c, total, _, start, transition in self._lattices(theta)]
        logs = np.array([w + p.log_z for w, _, p in found])
        log_z = float(_sum_exp(logs, 0))
        gradient = self.b + self.rho * theta
        if not np.isfinite(log_z):
            return 0.0, np.zeros(len(theta))
        for k, (share, (_, c, p)) in enumerate(zip(np.exp(logs - log_z), found)):
            if not share:
                continue
            for f, penalty in enumerate(self.penalties):
                for counts, where in ((p.segments, penalty.segments), (p.starts, penalty.starts), (p.transitions, penalty.transitions)):
                    if where is not None:
                        gradient[f] -= share * float((counts * where).sum())
            if c is not None:
                for x, values in self.choices[k - 1].items():
                    if values:
                        stack = np.stack([theta[self.abbr] * a + theta[self.sim] * s for _, a, s in values])
                        of_value = np.exp(stack - _sum_exp(stack, 0)) * p.segments[:, :, x]
                        gradient[self.abbr] += share * float(sum((q * a).sum() for q, (_, a, _) in zip(of_value, values)))
                        gradient[self.sim] += share * float(sum((q * s).sum() for q, (_, _, s) in zip(of_value, values)))
        return log_z + float(self.b @ theta + 0.5 * (self.rho * theta**2).sum()), gradient

    def fit(self, theta: np.ndarray, iterations: int, least_change: float = 1e-3) -> tuple[np.ndarray, list[float]]:
        """Projected gradient descent; objective values never rise."""
        value, gradient = self.value_and_gradient(theta)
        values = [value]
        for _ in range(iterations):
            step, then = 1.0, None
            while step > 1e-8:
                trial = np.maximum(0.0, theta - step * gradient)
                v, g = self.value_and_gradient(trial)
                if v <= value - 1e-4 * float(gradient @ (theta - trial)):
                    then = (trial, v, g)
                    break
                step /= 2
            if then is None:
                break
            change = abs(value - then[1]) / max(1e-12, (abs(value) + abs(then[1])) / 2)
            theta, value, gradient = then
            values.append(value)
            if change < least_change:
                break
        return theta, values

    def best(self, theta: np.ndarray):
        """(record_id, score, log_z, segments)."""
        found, logs = None, []
        for k, (weight, c, total, top, start, transition) in enumerate(self._lattices(theta)):
            score, path = viterbi(top, start, transition)
            logs.append(weight + forward_backward(total, start, transition).log_z)
            if found is None or weight + score > found[0]:
                found = (weight + score, c, path, k)
        score, c, path, k = found
        segments = []
        for b, e, x in path:
            value = None
            if c is not None and self.choices[k - 1].get(x):
                of = self.choices[k - 1][x]
                value = of[int(np.argmax([theta[self.abbr] * a[b, e - b - 1] + theta[self.sim] * s[b, e - b - 1] for _, a, s in of]))][0]
            segments.append({"begin": b, "end": e, "label": self.labels[x], "record_id": c and c["record_id"], "value_id": value})
        return c and c["record_id"], score, float(_sum_exp(np.array(logs), 0)), segments

    def segmentation_posterior(self, theta: np.ndarray):
        """Expected tokens, starts and transitions over all lattices, and log Z."""
        found = [(w, forward_backward(total, start, transition)) for w, _, total, _, start, transition in self._lattices(theta)]
        logs = np.array([w + p.log_z for w, p in found])
        log_z = float(_sum_exp(logs, 0))
        share = np.exp(logs - log_z) if np.isfinite(log_z) else np.zeros(len(found))
        mix = lambda part: sum(s * part(p) for s, (_, p) in zip(share, found))
        return log_z, mix(lambda p: p.tokens()), mix(lambda p: p.starts), mix(lambda p: p.transitions)


STATE = "mention_id string, theta map<string,double>"


def constrained_decode(rows: DataFrame, chain: Chain, longest: dict[str, int], domain: Domain, state: DataFrame | None = None, use_gen: bool = True, use_disc: bool = False, only_segmentation: bool = False, update: bool = True) -> DataFrame:
    """``decode_joint`` under constraints, with theta (for the next call's ``state``), the objective's values, and error.

    ``rows``: scored texts, with candidates unless ``only_segmentation``.
    """
    labels, lengths = chain.labels, _lengths(chain.labels, longest)
    if "candidates" not in rows.columns:
        rows = rows.withColumn("candidates", F.lit(None).cast("array<struct<record_id:string,values:array<struct<field:string,value_id:string,phrase:array<string>>>>>"))
    if state is not None:
        rows = rows.join(state.select("mention_id", "theta"), "mention_id", "left")
    else:
        rows = rows.withColumn("theta", F.lit(None).cast("map<string,double>"))
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            candidates, thetas = batch.column(names.index("candidates")).to_pylist(), batch.column(names.index("theta")).to_pylist()
            out, states, values = [], [], []
            for row, own, had in zip(Row.read(batch, len(labels)), candidates, thetas):
                base = lattice_of(row, labels, lengths, False)
                model = Constrained(row, base, chain.scores(row.is_record, use_gen, use_disc), labels, own or [], domain, only_segmentation)
                start = dict(had or {})
                theta, path = np.array([start.get(n, 0.0) for n in model.names]), []
                if update and len(row.words):
                    theta, path = model.fit(theta, domain.iterations)
                out.append((row.id, *model.best(theta)))
                states.append(list({**start, **dict(zip(model.names, theta.tolist()))}.items()))
                values.append(path)
            found = joint_batch(out)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(states, pa.map_(pa.string(), pa.float64())), pa.array(values, pa.list_(pa.float64()))], names=[*found.schema.names, "theta", "objective"])

    return rows.select(*_lattice_input(rows), "candidates", "theta").mapInArrow(run, JOINT + ", theta map<string,double>, objective array<double>")


def constrained_expectations(rows: DataFrame, chain: Chain, longest: dict[str, int], domain: Domain, state: DataFrame | None = None, use_gen: bool = True, use_disc: bool = False, only_segmentation: bool = False) -> DataFrame:
    """``lattice.expectations`` under constraints whose theta is fitted from ``state`` on."""
    from reclink.operators.lattice import _POSTERIOR, _posterior_batch

    labels, lengths = chain.labels, _lengths(chain.labels, longest)
    if "candidates" not in rows.columns:
        rows = rows.withColumn("candidates", F.lit(None).cast("array<struct<record_id:string,values:array<struct<field:string,value_id:string,phrase:array<string>>>>>"))
    rows = rows.join(state.select("mention_id", "theta"), "mention_id", "left") if state is not None else rows.withColumn("theta", F.lit(None).cast("map<string,double>"))
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            candidates, thetas = batch.column(names.index("candidates")).to_pylist(), batch.column(names.index("theta")).to_pylist()
            out = []
            for row, own, had in zip(Row.read(batch, len(labels)), candidates, thetas):
                model = Constrained(row, lattice_of(row, labels, lengths, False), chain.scores(row.is_record, use_gen, use_disc), labels, own or [], domain, only_segmentation)
                start = dict(had or {})
                theta, _ = model.fit(np.array([start.get(n, 0.0) for n in model.names]), domain.iterations) if row.words else (np.zeros(len(model.names)), [])
                log_z, tokens, starts, pairs = model.segmentation_posterior(theta)
                out.append((row.id, log_z, np.ravel(tokens), np.ravel(starts), np.ravel(pairs), None if np.isfinite(log_z) else "no segmentation is allowed"))
            yield _posterior_batch(out)

    return rows.select(*_lattice_input(rows), "candidates", "theta").mapInArrow(run, _POSTERIOR)

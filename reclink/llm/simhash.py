"""SimHash near-duplicates: fingerprints, generalised pigeonhole search, connected components.

The 64 bits are dealt into parts, and part i has a threshold t_i of -1 or more; if the thresholds sum to
``radius - parts + 1``, two fingerprints within the radius agree up to t_i bits in at least one part (a threshold of -1
means that the part isn't probed).  Correlated bits are put in one part, so that parts are closer to independent and each
says more.  Thresholds come from dynamic programming over estimated candidate counts: the distances of all pairs of a
bounded sample of distinct fingerprints (``SAMPLE``), scaled to their number.  Parts and thresholds change the cost alone;
every choice finds every pair within the radius.

A part with threshold t is probed by masking each choice of t of its bits and matching the rest exactly; fingerprints that
share a key are verified on all 64 bits.  Equal fingerprints are folded to one row (with the smallest id) before any of
this.  A key's fingerprints are streamed in order; a run of more than ``RUN`` is searched from row to row, where each meets
only what no earlier one has reached, so a dense group costs far less than its square, and one of more than ``LONG`` is
first split by the same pigeonhole argument over all bits if that helps.  Links within a stretch of keys are folded to a
spanning forest before they leave the task.

Similar documents (shingle sets of a Jaccard similarity of 0.8 or more) differ in 15 % of their signature bits, and within such
a radius the pigeonhole argument asks for parts of 5 bits for each differing one: candidates in proportion to the square of
the input.  ``similar_documents`` so probes parts of a signature of ``WORDS`` words at threshold 0, as wide and as many as
cost least for a given recall.  This signature counts each shingle of a text once, as its set does; the fingerprints of
``near_duplicates`` count repeats.  Rows that share a part and whose signatures are within a wide margin are candidates (all
words go with a key: two of them let through pairs down to a similarity of 0.39, eight down to 0.6).  Candidates aren't sent
as pairs, whose number grows with the square of a group's size, but as links of a spanning forest, and the sets of shingle
hashes of a cluster (what such links connect) meet in one task, each once; a cluster of more than ``CLUSTER_BYTES`` is cut
into blocks, and each two of them meet.  There all sets are compared exactly (``similar_forest``), whether or not they were
candidates themselves.

Defined cases: a null text is an empty one; texts without a word have fingerprint zero and link like any other; a text of
fewer words than a shingle is one shingle; repeated rows have equal fingerprints; rows with a null id keep their
fingerprint and have a null component; an empty table gives an empty result; extra columns are not read.  For similar
documents, rows that share an id but not a text are documents of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reclink.llm.components import components
from reclink.llm.words import exact, mixed
from reclink.session import dropped, written

BITS, RADIUS, SHINGLE = 64, 2, 3
SAMPLE, RUN, LONG = 4_096, 2_048, 65_536
#: Words of a signature of similar documents, and the share of pairs at the similarity itself that parts must bring together.
WORDS, RECALL = 8, 0.99
#: Standard deviations above the expected number of differing bits, of the first word and of all, up to which pairs are candidates.
MARGIN = 5.0
#: Bytes of shingle hashes of a block of a cluster.
CLUSTER_BYTES = 4 << 20
#: Rows of one signature from which they are joined by broadcast, and most signatures and ids that are broadcast (after a count).
HOT, MOST_HOT, MOST_IDS = 1_000, 500_000, 1_000_000
#: Comparisons that cost as much as a row in a shuffle.
ROW_COST = 400.0


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) of the word shingles, with repeats, of a text whose A-Z are lower-cased; none without a word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], "<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE, words_out: int = 1, distinct: bool = False) -> list[int]:
    """Majority, bit by bit, of the hashes of a text's shingles, each as often as it occurs or, if ``distinct``, once.

    With ``words_out`` over 1, further 64-bit words follow, from scrambled hashes.
    """
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return [0] * words_out
    return _majority(np.unique(hashes) if distinct else hashes, words_out)


def _majority(hashes: np.ndarray, words_out: int = 1) -> list[int]:
    out = []
    for i in range(words_out):
        own = mixed(hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) if i else hashes
        total = np.zeros(BITS, np.int64)
        for at in range(0, len(own), 1 << 15):
            total += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(total * 2 > len(own), bitorder="little").tobytes(), "little"))
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words_out: int = 1, distinct: bool = False) -> DataFrame:
    """(id, fp, sig): the fingerprint of every row as a signed 64-bit integer, and all its words as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                rows = [fingerprint((x.as_py() or "").encode(), shingle, words_out, distinct) for x in part.column(1)]
                words = np.array(rows, "<u8").reshape(len(rows), words_out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words[:, 0].copy().view(np.int64)), pa.array([w.tobytes() for w in words], pa.binary())], names=["id", "fp", "sig"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id bigint, fp bigint, sig binary")


def grouped_bits(sample: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Parts of these sizes; each takes, bit by bit, the free bit most correlated with those it has."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    x = bits.astype(float) - bits.mean(0) if len(sample) else np.zeros((1, BITS))
    norm = np.sqrt((x**2).sum(0))
    like = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(like, 0)
    free, out = set(range(BITS)), []
    for size in sizes:
        part = [max(free, key=lambda b: (like[b, list(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (like[b, part].sum(), -b)))
            free.discard(part[-1])
        out.append(sorted(part))
    return out


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def allocate(sample: np.ndarray, parts: list[list[int]], n: int, radius: int = RADIUS) -> tuple[float, list[int]]:
    """Cost and thresholds, one for each part, that sum to radius - parts + 1, by dynamic programming.

    The cost of a part at threshold t: its keys (each fingerprint shuffles C(width, t) of them) and its candidates (pairs
    within distance t there, estimated from all pairs of the sample and from chance, whichever is more).
    """
    from math import comb

    pairs = np.triu_indices(min(len(sample), 1_024), 1)
    different = sample[pairs[0]] ^ sample[pairs[1]]
    costs = []
    for part in parts:
        near = np.bitwise_count(different & np.uint64(_mask(part))) if len(different) else np.zeros(0, np.uint8)
        row = {-1: 0.0}
        for t in range(radius + 1):
            share = max(float((near <= t).mean()) if len(near) else 0.0, sum(comb(len(part), j) for j in range(t + 1)) / 2.0 ** len(part))
            row[t] = 40.0 * n * comb(len(part), t) + share * n * n / 2
        costs.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in row.items():
                if total + t not in then or cost + c < then[total + t][0]:
                    then[total + t] = (cost + c, [*chosen, t])
        best = then
    return best[radius - len(parts) + 1]


def plan_search(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits of a part, its threshold) for the cheapest of several numbers and widths of parts; parts that aren't probed are left out."""
    best = None
    layouts = [[BITS // m + (i < BITS % m) for i in range(m)] for m in range(2, radius + 2)] + [[36, 28], [28, 20, 16], [30, 26, 8]]
    for sizes in layouts:
        parts = grouped_bits(sample, sizes)
        cost, thresholds = allocate(sample, parts, n, radius)
        if best is None or cost < best[0]:
            best = (cost, [(p, t) for p, t in zip(parts, thresholds) if t >= 0])
    return best[1]


def _keys(fps: np.ndarray, plan: list[tuple[list[int], int]]):
    """For each probe of the plan: the key of each fingerprint."""
    number = 0
    for part, t in plan:
        whole = _mask(part)
        for gone in combinations(part, t):
            number += 1
            yield mixed((fps & np.uint64(whole & ~_mask(gone))) ^ mixed(np.array([number], np.uint64)))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return start, np.diff(np.append(start, len(keys)))


class Near:
    """Whether pairs of rows link: the first word within ``radius`` bits and, if there are more words, all within ``whole`` bits."""

    def __init__(self, words: np.ndarray, radius: int, whole: int | None = None):
        self.words, self.first, self.radius, self.whole = words, words[:, 0].copy(), radius, whole

    def __call__(self, a, b) -> np.ndarray:
        hit = np.bitwise_count(self.first[a] ^ self.first[b]) <= self.radius
        if self.whole is not None and hit.any():
            some = np.flatnonzero(hit)
            x = self.words[a[some]] if np.ndim(a) else self.words[a][None, :]
            hit[some] = np.bitwise_count(x ^ self.words[b[some]]).sum(1) <= self.whole
        return hit


class Forest:
    """Union-find on arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not ((up := self.root[self.root]) == self.root).all():
                self.root = up


def _grow(near: Near, rows: np.ndarray, forest: Forest) -> None:
    """Link ``rows`` by search: each row meets only those that no row before it has reached."""
    free = rows
    while len(free):
        front, free = [int(free[0])], free[1:]
        while front and len(free):
            row = front.pop()
            hit = near(row, free)
            if hit.any():
                found = free[hit]
                forest.link(np.full(len(found), row), found)
                front += found.tolist()
                free = free[~hit]


def _link_long(near: Near, rows: np.ndarray, bits: list[int], forest: Forest) -> None:
    """Link a long run: by search, or, where its other bits split it well, by the pigeonhole argument over these."""
    parts = np.array_split(np.array(bits), near.radius + 1)
    if len(rows) > LONG and len(parts[-1]):
        groups = []
        for part in parts:
            key = near.first[rows] & np.uint64(_mask(part.tolist()))
            order = np.argsort(key, kind="stable")
            start, size = _runs(key[order])
            groups.append((part, order, start[size > 1], size[size > 1]))
        if all((size <= len(rows) // 2).all() for _, _, _, size in groups):
            for part, order, start, size in groups:
                rest = [b for b in bits if b not in set(part.tolist())]
                for a, n in zip(start.tolist(), size.tolist()):
                    _link_long(near, rows[order[a : a + n]], rest, forest)
            return
    _grow(near, rows, forest)


def forest_of(keys: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) that span what is near among rows with equal keys; keys are sorted."""
    start, size = _runs(keys)
    forest = Forest(len(keys))
    # short runs together: each row with the d-th after it
    d, rows = 1, np.flatnonzero(np.repeat((size > 1) & (size <= RUN), size))
    left = np.repeat(start + size, size)
    while len(rows := rows[rows + d < left[rows]]):
        hit = rows[near(rows, rows + d)]
        forest.link(hit, hit + d)
        d += 1
    for a, n in zip(start[size > RUN].tolist(), size[size > RUN].tolist()):
        _link_long(near, np.arange(a, a + n), list(range(BITS)), forest)
    linked = np.flatnonzero(forest.root != np.arange(len(keys)))
    return linked, forest.root[linked]


def _bytes_of(column, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def _whole_runs(batches, width: int):
    """The columns of batches, whose first one is sorted, as arrays that hold whole runs of it; binary columns are signatures."""
    held: list[list[np.ndarray]] = []
    joined = lambda parts: [np.concatenate(x) for x in zip(*parts)]
    for batch in batches:
        now = [_bytes_of(c, width) if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns]
        if not len(now[0]):
            continue
        at = int(np.searchsorted(now[0], now[0][-1], "left"))
        if at or held and held[-1][0][-1] != now[0][0]:
            yield joined([*held, [x[:at] for x in now]])
            held = []
        held.append([x[at:] for x in now])
    if held:
        yield joined(held)


def links(distinct: DataFrame, keys, radius: int = RADIUS, whole: int | None = None, width: int = 1) -> DataFrame:
    """Links (u, v) that connect what is near; ``distinct`` has (fp, sig, id) with distinct signatures.

    ``keys`` gives the keys of all rows for one probe after another, from their words.
    """

    def probe(batches):
        for batch in batches:
            for k in keys(_bytes_of(batch.column(0), width)) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column(0), batch.column(1)], names=["k", "sig", "id"])

    def verify(batches):
        for k, sig, i in _whole_runs(batches, width):
            a, b = forest_of(k, Near(sig, radius, whole))
            yield pa.RecordBatch.from_arrays([pa.array(i[a]), pa.array(i[b])], names=["u", "v"])

    probes = distinct.select("sig", "id").mapInArrow(probe, "k bigint, sig binary, id bigint")
    return probes.repartition("k").sortWithinPartitions("k", "id").mapInArrow(verify, "u bigint, v bigint")


def plan_parts(n: int, agree: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a part, parts): the cheapest that bring a pair whose bits agree with that probability together, by rows shuffled and comparisons."""
    best = None
    for bits in range(8, 41):
        parts = int(np.ceil(np.log(1 - recall) / np.log1p(-(agree**bits))))
        cost = ROW_COST * n * parts + parts * n * n / 2 / 2.0**bits
        if best is None or cost < best[0]:
            best = (cost, bits, parts)
    return best[1], best[2]


def part_keys(words: np.ndarray, bits: int, parts: int):
    """For each part: the key of each row.  Parts share no bits until all have been used, then they are dealt anew."""
    total = words.shape[1] * BITS
    rng = np.random.default_rng([total, bits])
    deck: list[int] = []
    flat = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    for number in range(parts):
        if len(deck) < bits:
            deck = [int(i) for i in rng.permutation(total)]
        part, deck = deck[:bits], deck[bits:]
        key = flat[:, part].astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
        yield mixed(key ^ mixed(np.array([number + 1], np.uint64)))


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for a broadcast if a count says that it is small."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, hashes): the sorted set of shingle hashes, as bytes, of each text of the ids that are ``wanted`` (id)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                sets = [np.unique(shingle_hashes((x.as_py() or "").encode(), shingle)) for x in part.column(1)]
                fps = np.array([_majority(x)[0] if len(x) else 0 for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "fp", "hashes"])

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = texts.join(_few(written(wanted.distinct(), "wanted")), "id", "left_semi").mapInArrow(run, "id bigint, fp bigint, hashes binary")
    # rows that repeat an id and a text, and texts of equal sets under one id, are one
    return found.groupBy("id", "fp").agg(F.min("hashes").alias("hashes"))


def similar_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs), each of two sets of at least that Jaccard similarity, that connect whatever such pairs connect.

    What two sets share is at most what either shares with any other: sets for which that leaves no partner go at once, and
    of those that stay each is compared with the ones that no earlier one has reached.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate([np.zeros(0, "<u8"), *sets]), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    part = similarity / (1 + similarity)
    alive, shared = np.ones(len(sets), bool), size
    while alive.any():
        often = np.bincount(ids)
        keep = alive[owner] & (often[ids] > 1)
        ids, owner = ids[keep], owner[keep]
        shared = np.bincount(owner, minlength=len(sets))
        sizes = np.append(np.sort(size[alive]), np.iinfo(np.int32).max)
        least = sizes[np.searchsorted(sizes, similarity * size - 1e-6)]
        before, alive = alive, alive & (shared >= part * (size + least) - 1e-6)
        if (alive == before).all():
            break
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    marked = np.zeros(int(ids.max(initial=0)) + 1, bool)
    free = np.flatnonzero(alive)
    free = free[np.argsort(-shared[free] / np.maximum(size[free], 1), kind="stable")]
    u, v = [], []
    while len(free):
        front, free = [int(free[0])], free[1:]
        while front and len(free):
            row = front.pop()
            some = free[np.minimum(shared[row], shared[free]) >= part * (size[row] + size[free]) - 1e-6]
            if not len(some):
                continue
            own = ids[first[row] : first[row + 1]]
            marked[own] = True
            ends = np.cumsum(shared[some])
            at = np.arange(int(ends[-1])) + np.repeat(first[some] - ends + shared[some], shared[some])
            both = np.diff(np.append(0, np.cumsum(marked[ids[at]])[ends - 1])) if len(at) else np.zeros(len(some), np.int64)
            marked[own] = False
            # two empty sets are equal
            found = some[both / (size[row] + size[some] - both) >= similarity] if size[row] else some[size[some] == 0]
            if len(found):
                u += [row] * len(found)
                v += found.tolist()
                front += found.tolist()
                free = free[~np.isin(free, found)]
    return np.array(u, np.int64), np.array(v, np.int64)


def _similar(clustered: DataFrame, similarity: float) -> DataFrame:
    """(u, v), structs of id and fp, that connect what is similar within the clusters (g, gf) of ``clustered`` (id, fp, g, gf, hashes)."""

    def run(batches):
        at, rows, sets = None, [], []

        def linked():
            a, b = similar_forest(sets, similarity)
            own = np.array(rows, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (own[a, 0], own[a, 1], own[b, 0], own[b, 1])], names=["u", "fu", "v", "fv"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(4)))
            for n, (key, i, fp) in enumerate(zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if key != at:
                    if len(rows) > 1:
                        yield linked()
                    at, rows, sets = key, [], []
                rows.append((i, fp))
                sets.append(np.frombuffer(batch.column(6)[n].as_buffer(), "<u8").copy())
        if len(rows) > 1:
            yield linked()

    # blocks of a large cluster meet two by two
    large = clustered.groupBy("g", "gf").agg(F.ceil(F.sum(F.length("hashes")) / CLUSTER_BYTES).cast("int").alias("blocks")).where("blocks > 1")
    rows = clustered.join(_few(written(large, "large-clusters")), ["g", "gf"], "left").withColumn("own", F.expr("pmod(xxhash64(id, fp), blocks)").cast("int"))
    met = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")), lambda x: F.struct(F.least(x, "own").alias("a"), F.greatest(x, "own").alias("b")))
    rows = rows.select("g", "gf", F.explode(F.coalesce(met, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))).alias("m"), "id", "fp", "hashes")
    meet = rows.select("g", "gf", "m.a", "m.b", "id", "fp", "hashes").repartition("g", "gf", "a", "b").sortWithinPartitions("g", "gf", "a", "b")
    found = meet.mapInArrow(run, "u bigint, fu bigint, v bigint, fv bigint")
    return _linked_rows(found)


def _linked_rows(found: DataFrame) -> DataFrame:
    """(u, v), structs of id and fp, of (u, fu, v, fv)."""
    return found.select(F.struct(F.col("u").alias("id"), F.col("fu").alias("fp")).alias("u"), F.struct(F.col("v").alias("id"), F.col("fv").alias("fp")).alias("v"))


def similar_links(distinct: DataFrame, keys, sets_of, limits: tuple[int, int], width: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect what is similar among ``distinct`` (fp, sig, id), of rows that share one of ``keys`` and are near, directly or through others.

    ``limits`` says how many bits of the first word and of all of them near rows may differ in; ``sets_of`` gives the table
    (id, fp, hashes) of a table of ids.
    """

    def probe(batches):
        for batch in batches:
            for k in keys(_bytes_of(batch.column(0), width)) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column(0), batch.column(1)], names=["k", "sig", "id"])

    def meet(batches):
        for k, sig, i in _whole_runs(batches, width):
            a, b = forest_of(k, Near(sig, *limits))
            fp = sig[:, 0].copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i[a], fp[a], i[b], fp[b])], names=["u", "fu", "v", "fv"])

    rows = distinct.select("sig", "id").mapInArrow(probe, "k bigint, sig binary, id bigint")
    near = rows.repartition("k").sortWithinPartitions("k", "id").mapInArrow(meet, "u bigint, fu bigint, v bigint, fv bigint").distinct()
    clusters = components(_linked_rows(near))
    of = clusters.select(F.col("node.id").alias("id"), F.col("node.fp").alias("fp"), F.col("component.id").alias("g"), F.col("component.fp").alias("gf"))
    clustered = written(sets_of(of.select("id")).join(of, ["id", "fp"]).select("id", "fp", "g", "gf", "hashes"), "clustered")
    found = written(_similar(clustered, similarity), "similar")
    dropped(distinct.sparkSession, clusters, clustered)
    return found


def _folded(docs: DataFrame, id_col: str, text_col: str, shingle: int, width: int, distinct_shingles: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, fp, sig) of every row, and (fp, sig, id, n) with the smallest id and the number of rows for each signature."""
    prints = written(signatures(docs, id_col, text_col, shingle, width, distinct_shingles), "fingerprints")
    return prints, written(prints.where("id is not null").groupBy("fp", "sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")


def _unfolded(prints: DataFrame, of: DataFrame) -> DataFrame:
    """``prints`` with the component of their signature in ``of`` (sig, n, component); signatures of many rows are joined by broadcast."""
    hot = of.where(F.col("n") > HOT)
    if not 0 < hot.count() <= MOST_HOT:
        return prints.join(of.select("sig", "component"), "sig", "left")
    rest = prints.join(F.broadcast(hot.select("sig")), "sig", "left_anti").join(of.select("sig", "component"), "sig", "left")
    return rest.unionByName(prints.join(F.broadcast(hot.select("sig", "component")), "sig"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id) for every row; components join fingerprints within ``radius`` bits."""

    def linked(distinct: DataFrame, n: int) -> DataFrame:
        sample = np.array([r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
        plan = plan_search(sample, n, radius)
        return links(distinct, lambda words: _keys(words[:, 0], plan), radius)

    prints, distinct = _folded(docs, id_col, text_col, shingle, 1)
    found = components(linked(distinct, distinct.count()))
    of = written(distinct.join(found, distinct["id"] == found["node"], "left").select("sig", "n", F.coalesce("component", "id").alias("component")), "components")
    return _unfolded(prints, of).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, recall: float) -> DataFrame:
    """(id, fp, component: struct of id and fp) for every row."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    prints, distinct = _folded(docs, id_col, text_col, shingle, WORDS, True)
    bits, parts = plan_parts(max(distinct.count(), 1), 1 - share, recall)
    limits = tuple(int(np.ceil(b * share + MARGIN * np.sqrt(share * (1 - share) * b))) for b in (BITS, WORDS * BITS))
    sets_of = lambda ids: shingle_sets(docs, ids, id_col, text_col, shingle)
    found = components(similar_links(distinct, lambda words: part_keys(words, bits, parts), sets_of, limits, WORDS, similarity))
    own = F.struct("id", "fp")
    of = written(distinct.withColumn("own", own).join(found, F.col("own") == F.col("node"), "left").select("sig", "n", F.coalesce("component", "own").alias("component")), "components")
    dropped(docs.sparkSession, distinct, found)
    return _unfolded(prints, of).select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(id_col, component_id): components of documents whose word shingles are similar (Jaccard of their sets).

    Sets of equal size and Jaccard j have a cosine of 2j / (1 + j), and a bit of their signatures differs with the angle's share
    of a half turn: 78 of 512 bits at 0.8, give or take 8.  Parts bring at least ``recall`` of the pairs at that similarity together, and more
    of those above it; all that they bring together and that is within the margin is verified exactly.
    """
    rows = _similar_rows(docs, id_col, text_col, shingle, similarity, recall)
    return rows.select(F.col("id").alias(id_col), F.col("component.id").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of similar ones.

    Rows with a null id all stay.  Rows that share an id are documents of their own if their texts aren't similar, else the
    one with the first text stays.
    """
    rows = written(_similar_rows(docs, id_col, text_col, shingle, similarity, recall).where("id is not null"), "similar-rows")
    stays = F.struct("id", "fp") == F.col("component")
    repeated = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    gone = written(rows.where(~stays).select("id").union(repeated).distinct(), "gone")
    key = F.col(f"`{id_col}`").cast("bigint")
    ones = docs.join(_few(gone.withColumnRenamed("id", "near__id")), key == F.col("near__id"), "left_anti")
    if repeated.isEmpty():
        return ones

    @F.pandas_udf("bigint")
    def first_word(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint((x or "").encode(), shingle, 1, True)[0] for x in texts], np.uint64).view(np.int64))

    several = docs.join(_few(repeated.withColumnRenamed("id", "near__id")), key == F.col("near__id"), "left_semi").withColumn("near__fp", first_word(f"`{text_col}`"))
    kept = rows.where(stays).select(F.col("id").alias("near__id"), F.col("fp").alias("near__of")).distinct()
    several = several.join(kept, (key == F.col("near__id")) & (F.col("near__fp") == F.col("near__of")), "left_semi")
    first = several.withColumn("near__n", F.row_number().over(W.partitionBy(key, "near__fp").orderBy(F.col(f"`{text_col}`").asc_nulls_first(), *exact([c for c in docs.columns if c != text_col]))))
    return ones.unionByName(first.where("near__n = 1").select(*exact(docs.columns)))

"""Substring dedup, SimHash, mixing, quality and toxicity against brute force, and on awkward tables."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5, sha256
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from edge import documents, labels, split
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reclink.llm import mixing, quality, queries, simhash, substring_dedup, toxicity


# -- substring dedup --------------------------------------------------------------------------------------------------


def removed(rows, window=13):
    """Kept words of each row, by definition."""
    first = {}
    words = [split(r["text"]) for r in rows]
    ids = [math.inf if r["doc_id"] is None else r["doc_id"] for r in rows]
    for i, w in zip(ids, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, math.inf), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def digests(rows):
    return sorted((str(r["doc_id"]), len(split(r["text"])), len(split(r["text"])) - len(k), sha256(" ".join(k).encode()).hexdigest()) for r, k in zip(rows, removed(rows)))


@pytest.mark.parametrize("table", ["fixture", "edge", "copies"])
def test_substrings(spark, data, docs, table):
    if table == "edge":
        docs = documents(spark)
    if table == "copies":  # many copies of few phrases, chains of overlaps, one anchor with different passages
        base = [f"w{i}" for i in range(40)]
        docs = spark.createDataFrame([(i, " ".join(base[i % 7 :] + [f"own{i}"] + base[: 20 + i % 11])) for i in range(300)], "doc_id bigint, text string")
    found = substring_dedup.dedup_substrings(docs, digests=True)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()) == digests(docs.collect())


def test_substrings_keep_columns_and_texts(spark):
    docs = documents(spark)
    found = substring_dedup.dedup_substrings(docs)
    assert found.schema.simpleString() == docs.schema.simpleString()
    assert sorted(str(split(r["text"])) for r in found.collect()) == sorted(str(k) for k in removed(docs.collect()))
    assert {r["text"] for r in found.where("doc_id = 5").collect()} == {" \t\n\x0b\x0c\r "}
    assert found.where("doc_id is null and text is null").count() == 1


def test_substrings_of_nothing(spark):
    assert substring_dedup.dedup_substrings(documents(spark).where("false"), digests=True).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(documents(spark), window=3)


# -- SimHash ----------------------------------------------------------------------------------------------------------


def fingerprint(text, size=3):
    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, rows):
    prints = [(r["doc_id"], fingerprint(r["text"])) for r in rows]
    near = [(a, b) for (a, x), (b, y) in combinations(prints, 2) if (x ^ y).bit_count() <= 2]
    expected = grouped(near, [i for i, _ in prints])
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{x:016x}", expected[i]) for i, x in prints}


def test_simhash_awkward(spark):
    table = documents(spark)
    found = simhash.near_duplicates(table).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in found) == sorted((str(r["doc_id"]), f"{fingerprint(r['text']):016x}") for r in table.collect())
    of = {r["doc_id"]: r["component_id"] for r in found if r["fingerprint"] == "0" * 16 and r["doc_id"] is not None}
    assert set(of) >= {3, 4, 5} and set(of.values()) == {3}
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    assert simhash.near_duplicates(table.where("false")).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_pigeonhole_finds_every_pair(spark, dense):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 3 if dense else 400, dtype=np.uint64)
    fps = set()
    for _ in range(6000):
        x = int(rng.choice(centres))
        for b in rng.integers(0, 12 if dense else 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    expected = grouped(np.argwhere(np.triu(apart <= 2, 1)).tolist(), range(len(fps)))
    table = spark.createDataFrame([(int(x.view(np.int64)), x.tobytes(), i) for i, x in enumerate(fps)], "fp bigint, sig binary, id bigint")
    for plan in (simhash.plan_search(fps, len(fps)), simhash.plan_search(fps, 10**9)):
        assert sum(t + 1 for _, t in plan) == simhash.RADIUS + 1
        found = simhash.links(table, lambda words, plan=plan: simhash._keys(words[:, 0], plan)).collect()
        assert grouped([(r["u"], r["v"]) for r in found], range(len(fps))) == expected


def test_long_runs_are_split_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 8)
    monkeypatch.setattr(simhash, "LONG", 32)
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64) * np.uint64(1 << 20))
    a, b = simhash.forest_of(np.zeros(len(fps), np.int64), simhash.Near(fps[:, None], 2))
    pairs = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)).tolist()
    assert grouped(zip(a.tolist(), b.tolist()), range(len(fps))) == grouped(pairs, range(len(fps)))


def test_similar_documents(spark):
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(3000)]
    table, expected = [], {}
    for base in range(0, 2000, 5):
        text = rng.choice(words, 150).tolist()
        for i in range(5):
            changed = list(text)
            for at in rng.integers(0, 150, i // 2):  # up to two words: a similarity of about 0.87 or more
                changed[at] = "changed" + str(rng.integers(1 << 30))
            table.append((base + i, " ".join(changed)))
            expected[base + i] = base
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    right = sum(found[i] == expected[i] for i in expected)
    assert right >= 0.97 * len(expected) and all(found[i] // 5 == i // 5 for i in found)
    kept = simhash.deduplicated(spark.createDataFrame(table, "doc_id bigint, text string")).count()
    assert 400 <= kept <= 420


def test_similar_documents_count_a_repeated_shingle_once(spark):
    rng = np.random.default_rng(5)
    pool = iter(rng.permutation(100_000).tolist())
    body = lambda: [f"w{next(pool)}" for _ in range(200)]
    line = [f"line{i}" for i in range(12)]
    table = []
    for base in range(0, 80, 4):
        one, two, three = body(), body(), body()
        table += [(base, one + 11 * line), (base + 1, two + 11 * line), (base + 2, three + line), (base + 3, three + 5 * line)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in table], "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(rows).collect()}
    assert found == {i: i - (i % 4 == 3) for i, _ in table}


def exact_groups(table, similarity=0.8, shingle=5):
    """(groups, similar pairs) by the Jaccard similarity of all pairs' shingle sets."""
    sets = {}
    for i, text in table:
        words = text.lower().split()
        sets[i] = {tuple(words[a : a + shingle]) for a in range(max(1, len(words) - shingle + 1))}
    alike = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]
    return grouped(alike, list(sets)), alike


def changed(rng, text, n):
    out = list(text)
    for at in rng.choice(np.arange(10, len(text) - 10, 6), n, replace=False):
        out[at] = "changed" + str(rng.integers(1 << 30))
    return out


def test_similar_documents_are_verified_exactly(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(3000)]
    table = []
    for base in range(0, 600, 2):
        text = rng.choice(words, 150).tolist()
        table += [(base, text), (base + 1, changed(rng, text, 1 + base // 2 % 6))]  # similarities of 0.93 to 0.66
    # copies of one text that are similar to it but not to each other; it comes last
    text = rng.choice(words, 150).tolist()
    table += [(600 + i, changed(rng, text, 2)) for i in range(60)] + [(660, text)]
    table = [(i, " ".join(t)) for i, t in table]
    expected, alike = exact_groups(table)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert all(expected[i] == expected[c] for i, c in found.items())
    assert sum(found[a] == found[b] for a, b in alike) >= 0.95 * len(alike)


def test_similar_forest():
    rng = np.random.default_rng(7)
    text = rng.choice(1 << 20, 120, replace=False)
    sets = [np.zeros(0, np.int64)] * 2 + [np.arange(3), np.arange(3) + 1]
    for n in [*range(0, 40), *range(0, 40)]:
        own = text.copy()
        own[rng.choice(120, n, replace=False)] = rng.choice(1 << 30, n)  # some edits are shared by two sets
        sets += [own, np.append(own, rng.choice(1 << 30, 1 + n // 4))]
    sets = [np.unique(x).astype("<u8") for x in sets]
    pairs = [(a, b) for a, b in combinations(range(len(sets)), 2) if (len(x := np.union1d(sets[a], sets[b])) == 0) or len(np.intersect1d(sets[a], sets[b])) / len(x) >= 0.8]
    u, v = simhash.similar_forest(sets, 0.8)
    assert {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())} <= set(pairs) and len(u) < len(sets)
    assert grouped(zip(u.tolist(), v.tolist()), range(len(sets))) == grouped(pairs, range(len(sets)))
    assert len(simhash.similar_forest([], 0.8)[0]) == 0


def test_copies_that_are_not_similar_enough_are_not_paired(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = rng.choice([f"v{i}" for i in range(3000)], 150).tolist()
    # to the text a similarity of 0.87, to each other 0.76 or so: candidates, but no links; the text itself joins some of them
    table = [(i, " ".join(changed(rng, text, 2 + 2 * (i % 3 > 0)))) for i in range(240)] + [(240, " ".join(text))]
    expected, alike = exact_groups(table)
    rows, write = Counter(), simhash.written

    def counted(df, label):
        out = write(df, label)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    for size in (simhash.CLUSTER_BYTES, 60_000):  # one block, and several that meet two by two
        monkeypatch.setattr(simhash, "CLUSTER_BYTES", size)
        rows.clear()
        found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
        assert all(expected[i] == expected[c] for i, c in found.items())
        assert sum(found[a] == found[b] for a, b in alike) >= 0.99 * len(alike)
        assert max(rows.values()) < 8 * len(table), rows


def test_deduplicated_awkward(spark):
    table = documents(spark)
    kept = simhash.deduplicated(table)
    assert kept.columns == table.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[None] == 2 and ids[1] == 1 and ids[6] == 1 and 7 not in ids and all(n == 1 for i, n in ids.items() if i is not None)
    assert simhash.deduplicated(table.where("false")).count() == 0


# -- mixing -----------------------------------------------------------------------------------------------------------


def mixed(rows, exponent, factor=1.0, seed=17):
    """(weight, copies) by definition, given the exponent."""
    total = defaultdict(int)
    for r in rows:
        total[r["source"]] += len(split(r["text"]))
    every = sum(total.values())
    power = {s: (t / every) ** exponent for s, t in total.items() if t}
    weight = {s: round(p / sum(power.values()), 9) for s, p in power.items()}
    out = []
    for s in total:
        own = sorted((md5(f"{'null' if r['doc_id'] is None else r['doc_id']}:{seed}".encode()).hexdigest(), len(split(r["text"])), str(r["doc_id"])) for r in rows if r["source"] == s)
        budget = math.floor(weight.get(s, 0) * every * factor)
        whole, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        so_far = 0
        for _, n, i in own:
            so_far += n
            out.append((i, n, weight.get(s, 0.0), whole + (so_far <= rest and weight.get(s, 0) > 0)))
    return sorted(out)


@pytest.mark.parametrize("table", ["fixture", "edge"])
def test_mixing(spark, docs, table):
    docs = documents(spark) if table == "edge" else docs
    sources = docs.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("tokens"))
    a = mixing.exponent(sources)
    found = mixing.mix(docs)
    assert [c for c in docs.columns if not c.startswith("mix_")] == found.columns[:-3]
    assert sorted((str(r["doc_id"]), r["mix_tokens"], r["mix_weight"], r["mix_copies"]) for r in found.collect()) == mixed(docs.collect(), a)
    tokens = np.array([r["tokens"] for r in sources.collect() if r["tokens"]], float)
    q = tokens / tokens.sum()
    w = q**a / (q**a).sum()
    assert -(w * np.log(w)).sum() >= mixing.ENTROPY * math.log(len(q)) - 1e-4 or a == 1 or (w / q).max() >= mixing.MAX_REPEATS - 1e-3
    assert (w / q).max() <= mixing.MAX_REPEATS + 1e-4


def test_mixing_sql_and_native(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = queries.op8_mixing(spark, data)
    expected = con.sql(queries.ORACLE_SQL["op8_mixing"])
    order = [expected.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in expected.fetchall())
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|Cartesian|NestedLoop", plan)


def test_mixture_repeats_small_sources(spark):
    rows = [(i, "big", "a b c") for i in range(1000)] + [(5000 + i, "small", "a b c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = Counter(r["source"] for r in mixing.mixture(docs).collect())
    assert found["small"] > 20 and found["big"] < 1000 and mixing.mixture(docs).columns == docs.columns
    assert mixing.mixture(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("source = 'big'")).where("mix_weight <> 1 or mix_copies <> 1").count() == 0


# -- quality ----------------------------------------------------------------------------------------------------------


def test_quality_posteriors(spark, docs, data):
    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    found = quality.assess(docs, model, F.col("source"), F.col("lang")).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    p = model.evidence(np.array([quality.features(texts[i] or "") for i in found["doc_id"]]))
    assert np.allclose(found["q_evidence"], p)
    share = p.mean()
    host = found.groupby("source").q_evidence.agg(["sum", "count"])
    between = (host["count"] * (host["sum"] / host["count"] - share) ** 2).sum() / len(found) - share * (1 - share) * len(host) / len(found)
    k = min(1e6, max(1.0, share * (1 - share) / between - 1)) if between > 0 else 1e6
    prior = ((host["sum"] + k * share) / (host["count"] + k)).to_dict()
    path = found.groupby(["source", "lang"]).q_evidence.agg(["sum", "count"]).to_dict("index")
    at = [path[s, x] for s, x in zip(found["source"], found["lang"])]
    q_path = np.array([(c["sum"] - e + k * prior[s]) / (c["count"] - 1 + k) for c, e, s in zip(at, found["q_evidence"], found["source"])])
    assert np.allclose(found["q_host"], found["source"].map(prior)) and np.allclose(found["q_path"], q_path)
    logit = lambda x: np.log(x / (1 - x))
    clip = lambda x: np.clip(x, 1e-9, 1 - 1e-9)
    score = 1 / (1 + np.exp(-(logit(clip(p)) + quality.SITE_WEIGHT * (logit(clip(q_path)) - logit(share)))))
    assert np.allclose(found["q_score"], score) and ((found["q_score"] >= 0.5) == found["q_keep"]).all()


def test_quality_separates_held_out(spark):
    docs, known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, known)
    found = quality.assess(docs, model, F.col("source"), F.col("lang")).join(known, "doc_id").where(toxicity.held_out()).select("q_keep", "quality").collect()
    assert sum(r["q_keep"] == (r["quality"] == 1) for r in found) >= 0.9 * len(found)


def test_quality_awkward(spark):
    table = documents(spark)
    for known in (labels(spark), labels(spark).where("false"), labels(spark).where("quality = 1")):
        model = quality.fit(table, known)
        found = quality.assess(table, model, F.col("source"), F.col("lang"))
        assert found.count() == table.count() and found.where("q_score is null or q_keep is null").count() == 0
        assert [c for c in table.columns if c != "q_path"] == [c for c in found.columns if not c.startswith("q_")]
    assert quality.assess(table.where("false"), model, F.col("source"), F.col("lang")).count() == 0
    assert quality.features("") == [0.0] * quality.N_FEATURES


# -- toxicity ---------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_automaton(word, other, most):
    automaton = toxicity.LevenshteinAutomaton(word, most)
    state = automaton.start()
    for c in other:
        state = automaton.step(state, c) if state is not None else None
    found = None if state is None else automaton.distance(state)
    expected = edits(word, other)
    assert found == (expected if expected <= most else None)


@given(st.lists(st.text("abcde", min_size=5, max_size=12), min_size=1, max_size=30, unique=True), st.text("abcde", min_size=5, max_size=12))
def test_lookup_misses_nothing(lexicon, word):
    matcher = toxicity.Matcher(toxicity.Model({w: 1.0 for w in lexicon}, {}, [0.0] * 9))
    most = toxicity.edits_for(len(word))
    near = [w for w in lexicon if edits(word, w) <= min(most, toxicity.edits_for(len(w)))]
    found = matcher.look_up(word)
    if word in lexicon:
        assert found == (1.0, True)
    elif near:
        assert found is not None or toxicity.Trie(lexicon).nearest(word, most)[0] not in near
    assert not near or word in lexicon or matcher.may_be_near(word, most)


def test_quotation_counts_less():
    model = toxicity.Model({"insult": 2.0, "abuse": 2.0}, {}, toxicity.PRIOR.tolist())
    matcher = model.matcher()
    score = lambda t: float(model.score(np.array([matcher.features(t)]))[0])
    plain, quoted, misspelt, clean = score("you insult and abuse"), score('he called it an "insult" there'), score("you insolt and abusse"), score("a fine day")
    assert clean < quoted < plain and clean < misspelt


def test_window_of_a_text_with_many_hits():
    rng = np.random.default_rng(8)
    matcher = toxicity.Model({"insult": 2.0, "abuse": 1.5}, {}, toxicity.PRIOR.tolist()).matcher()
    chunks = rng.choice(["insult", "abuse", "plain", "other"], 600).tolist()
    weight = [{"insult": 2.0, "abuse": 1.5}.get(c, 0.0) for c in chunks]
    best = max(sum(weight[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]) for i, w in enumerate(weight) if w)
    assert sum(w > 0 for w in weight) >= 200
    assert matcher.features(" ".join(chunks))[toxicity.FEATURES.index("window")] == pytest.approx(np.log1p(best))


def test_memory_of_words_changes_nothing(monkeypatch):
    model = toxicity.Model({"badword": 2.0, "horrible": 1.0, "x" * 60: 3.0}, {"awf": 1.5})
    texts = [f"w{i} badword {'horrible' if i % 3 else 'horrable'} v{i} awful{i % 5} w{i - 1}" for i in range(50)] + ["x" * 59 + "y", "x" * 62, "x" * 63]
    expected = [model.matcher().features(x) for x in texts]
    assert expected[50][4] == 1 and expected[51][4] == 1 and not any(expected[52])
    monkeypatch.setattr(toxicity, "KNOWN", 3)
    matcher = model.matcher()
    assert [matcher.features(x) for x in texts] == expected


def test_toxicity_separates_held_out(spark):
    docs, known = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, known)
    found = toxicity.score(docs, model).join(known, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    toxic = [r["score"] for r in found if r["toxic"] == 1]
    clean = [r["score"] for r in found if r["toxic"] == 0]
    assert np.mean([t >= 0.5 for t in toxic]) >= 0.8 and np.mean([c >= 0.5 for c in clean]) <= 0.05


def test_toxicity_awkward(spark):
    table = documents(spark)
    for known in (labels(spark), labels(spark).where("false"), labels(spark).where("toxic = 1")):
        found = toxicity.score(table, toxicity.fit(table, known)).collect()
        assert len(found) == table.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
        assert not any(r["held_out"] for r in found if r["doc_id"] is None)
        assert len({r["score"] for r in found if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.score(table.where("false"), toxicity.fit(table.where("false"), labels(spark))).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, docs, data):
    from zlib import crc32

    known = spark.read.parquet(f"{data}/labels.parquet")
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.fit(docs, k)).orderBy("doc_id").collect() for k in (known, flipped))
    assert a == b and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in a)


def test_components_with_hubs(spark, monkeypatch):
    from reclink.llm import components as module

    monkeypatch.setattr(module, "HUB", 10)
    rng = np.random.default_rng(3)
    edges = [(0, i) for i in range(1, 200)] + [(999, i) for i in range(500, 700)] + [(i, i + 1) for i in range(2000, 2060)] + rng.integers(3000, 3400, (300, 2)).tolist() + [(7, 7)]
    table = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "u bigint, v bigint")
    for most in (500_000, 0):
        monkeypatch.setattr(module, "MOST_HUBS", most)
        found = {r["node"]: r["component"] for r in module.components(table).collect()}
        expected = grouped([e for e in edges if e[0] != e[1]], {x for e in edges for x in e if e[0] != e[1]})
        assert found == expected
    assert module.components(table.where("false")).count() == 0

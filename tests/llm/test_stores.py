"""Encoders, stores, archives, media and search against libraries and brute force, and on awkward tables."""

import gzip
import struct
from hashlib import sha1, sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
from edge import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reclink.llm import ann, bpe, jpeg, queries, token_store, warc


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def packed(ids):
    return np.array(ids, "<u4").tobytes()


# -- BPE --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["fixture", "edge"])
def test_bpe(spark, docs, library, table):
    docs = documents(spark) if table == "edge" else docs
    found = bpe.encode_documents(docs, queries.vocabulary(), outputs=())
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((str(r["doc_id"]), len(ids), sha256(packed(ids)).hexdigest(), sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()) == sorted(expected)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    own, library = bpe.load(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    ids = library.encode(text, add_special_tokens=False).ids
    found = own.encode_batch([text])[0]
    assert np.frombuffer(found, "<u4").tolist() == ids
    assert own.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_bpe_special_tokens_and_nothing(spark, library):
    own = bpe.load(queries.vocabulary())
    for text in ("a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|endoftext|", "don't I'LL we've 12345"):
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.encode_documents(documents(spark).where("false"), queries.vocabulary()).count() == 0


# -- token store ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["fixture", "edge"])
def test_token_store(spark, docs, library, table):
    docs = documents(spark) if table == "edge" else docs
    store = token_store.write_store(docs, queries.vocabulary(), end_id=1)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    ids = [library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in rows]
    found = store.documents().collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((str(r["doc_id"]), len(i), crc32(packed(i))) for r, i in zip(rows, ids))
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == [r["doc_id"] for r in rows]
    some = rows[len(rows) // 2]["doc_id"]
    assert sorted(x.tolist() for x in store.lookup(some)) == sorted(i for r, i in zip(rows, ids) if r["doc_id"] == some)


def test_words_that_come_back_are_not_encoded_again(monkeypatch):
    own, learnt = token_store.LibraryBPE(queries.vocabulary()), []
    monkeypatch.setattr(own, "merge_words", lambda words: learnt.append(len(words)) or [b"\x01\0\0\0"] * len(words))
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(str(x).translate(letters) for x in range(at, at + 205_000)) for at in (1_000_000, 2_000_000, 3_000_000)]
    for text in [*texts, texts[0]]:
        assert len(own.encode_batch([text])[0]) == 4 * 205_000
    assert sum(learnt) == 3 * 205_000


def test_token_store_of_nothing(spark):
    store = token_store.write_store(documents(spark).where("false"), queries.vocabulary())
    assert store.documents().count() == 0 and store.lookup(1) == []


# -- WARC -------------------------------------------------------------------------------------------------------------


PAGES = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, "x" * 1500), (4, "http://c\r\nX: y", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 600), (9, "u", "é" * 600), (10, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", "x" * 1500), (3, "dup", "x" * 1500)]


def pages(spark):
    return spark.createDataFrame([(*p, "id", 1) for p in PAGES], "page_id bigint, url string, html string, digest string, n_bytes int")


def test_warc_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    df = queries.op10_warc(spark, data)
    expected = con.sql(queries.ORACLE_SQL["op10_warc"])
    order = [expected.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in expected.fetchall())


def test_warc_awkward(spark):
    folder = warc.write_archives(pages(spark))
    records = warc.read_archives(spark, folder)
    found = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in records.collect())
    expected = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        best = max((j for j, _, h in PAGES if j is not None and h == html), default=None) if len(body) >= 1000 else None
        revisit = best is not None and (i is None or i < best)
        expected.append((-1 if i is None else i, "revisit" if revisit else "response", best if revisit else None, len(body), sha1(body).hexdigest()))
    assert found == sorted(expected, key=str) or sorted(map(str, found)) == sorted(map(str, expected))
    whole = warc.resolve(records).collect()
    assert all(sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in whole) and len(whole) == len(PAGES)
    assert warc.read_archives(spark, warc.write_archives(pages(spark).where("false"))).count() == 0


def test_warc_files_are_archives(spark):
    folder = warc.write_archives(pages(spark))
    for r in spark.read.format("binaryFile").load(folder).select("content").collect():
        data = gzip.decompress(r["content"])
        kinds = [h["warc-type"] for h, _ in warc.parse_records(data)]
        assert set(kinds) <= {"response", "revisit"}
    with pytest.raises(ValueError):
        list(warc.parse_records(b"nothing"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# -- JPEG -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["fixture", "edge"])
def test_media(spark, docs, table):
    docs = (documents(spark) if table == "edge" else docs).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    stored = jpeg.store_texts(docs)
    files = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    found = {r["doc_id"]: r for r in jpeg.media_features(stored).collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        payload = text + b" " * (-len(text) % 192 if text else 192)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]))
        assert r["media_bytes"] == len(files[i]) and r["media_sha256"] == sha256(files[i]).hexdigest()
        assert files[i][:2] == b"\xff\xd8" and files[i][-2:] == b"\xff\xd9" and r["feature"]
    features = {}
    for i, text in texts.items():
        features.setdefault(text, set()).add((found[i]["media_sha256"], found[i]["feature"]))
    assert all(len(x) == 1 for x in features.values())


def test_media_awkward_ids(spark):
    table = documents(spark)
    assert jpeg.media_features(jpeg.store_texts(table)).count() == table.count()
    assert jpeg.media_features(jpeg.store_texts(table.where("false"))).count() == 0


def test_carrier_is_lossless_for_all_bytes():
    rng = np.random.default_rng(0)
    payloads = [jpeg.padded(x) for x in (b"", bytes(range(256)), rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"\xff\x00" * 500)]
    images = [jpeg.parse(x) for x in jpeg.write_payloads(payloads)]
    for image, coefficients, payload in zip(images, jpeg.decode_coefficients(images), payloads):
        assert jpeg.read_payload(image, coefficients)[1] == payload


def _segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def flat_jpeg(levels, quant=16):
    """A grey picture of 8x8 blocks in one row, by hand: block k has the DC coefficient levels[k]; the DC table has lengths 4, no AC."""
    head = b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([quant] * 64))
    head += _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * len(levels), 1) + b"\x01\x11\x00")
    head += _segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    head += _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    head += _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    bits, last = "", 0
    for level in levels:
        d, last = level - last, level
        size = abs(d).bit_length()
        bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    return head + data + b"\xff\xd9"


def test_decoder_on_a_picture_made_by_hand():
    levels = [0, 5, -7, 60, 60, -60, 31]
    image = jpeg.parse(flat_jpeg(levels))
    coefficients = jpeg.decode_coefficients([image])[0]
    assert np.asarray(coefficients[0]).reshape(-1, 64)[:, 0].tolist() == levels
    pixels = jpeg.thumbnail(image, coefficients)
    assert pixels.shape == (1, len(levels))
    assert np.abs(pixels.ravel().astype(float) - np.clip([128 + x * 16 / 8 for x in levels], 0, 255)).max() <= 1


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc2\x00\x04ab"])
def test_decoder_refuses_other_files(data):
    with pytest.raises(ValueError):
        jpeg.parse(data)


def test_average_hash_sees_every_pixel():
    picture = np.zeros((80, 40), np.uint8)
    picture[1:10, 6:10] = 255  # in the first row of cells, in the second column, but for its corner
    assert jpeg.average_hash(picture) == 1 << 62
    assert jpeg.average_hash(np.zeros((1, 3), np.uint8)) == 0
    assert jpeg.average_hash(np.array([[0, 9]], np.uint8)) == 0x0F0F0F0F0F0F0F0F


# -- nearest neighbours -----------------------------------------------------------------------------------------------


def brute(rows, k=20):
    good = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["vec_id"] is not None and r["embedding"] and all(x is not None for x in r["embedding"])]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and (v != 0).any()]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted(((-(w * v).sum(), j) for j, w in good if j != i))[:k]
    return out


def test_recall_and_order(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    expected = brute(rows.collect())
    found = {}
    for r in queries.op4_nearest(spark, data).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(expected)
    hits = sum(len({j for j, _ in found[q]} & {j for _, j in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    by_id = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    for q, of in found.items():
        assert [(-s, j) for j, s in of] == sorted((-s, j) for j, s in of) and len(of) == 20
        assert all(s == pytest.approx(float((by_id[q] * by_id[j]).sum()), abs=1e-12) for j, s in of)


def test_nearest_awkward(spark):
    bad = [(20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (140, [])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (160, [0.0, 1.0]), (160, [0.0, 1.0])]
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in bad + good], "vec_id bigint, embedding array<float>, id string, b int")
    found = ann.nearest(rows, F.col("id") % 20 == 0).orderBy("query_id", "rank", "vec_id").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 160), (160, 1, 3), (160, 2, 0), (160, 3, 1), (160, 4, 2)]
    assert ann.nearest(rows.where("false"), F.col("id") % 20 == 0).count() == 0


def test_nearest_is_never_short(spark):
    rng = np.random.default_rng(1)
    for n, scale in ((1, 1), (6, 1), (21, 1), (400, 1000)):
        x = rng.normal(size=(n, 16))
        x[n // 2] *= scale
        rows = [{"vec_id": 5 * i, "embedding": v.tolist()} for i, v in enumerate(x)]
        found = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 20 == 0).collect()
        expected = {q: [j for _, j in of] for q, of in brute(rows).items()}
        own = {q: [r["vec_id"] for r in found if r["query_id"] == q] for q in expected}
        assert {q: len(x) for q, x in own.items()} == {q: min(20, n - 1) for q in expected}
        assert sum(len(set(own[q]) & set(expected[q])) for q in expected) >= 0.9 * sum(map(len, expected.values()))


def test_hot_cells_are_split(spark, monkeypatch):
    rows = [{"vec_id": i, "embedding": [1.0, 0.0, 0.0]} for i in range(300)] + [{"vec_id": 300 + i, "embedding": [0.0, 1.0, i / 1000]} for i in range(100)]
    monkeypatch.setattr(ann, "CELL_ROWS", 16)
    found = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    expected = [(q, n + 1, j) for q, of in brute(rows).items() for n, (_, j) in enumerate(of)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found if r["query_id"] < 300] == [x for x in sorted(expected) if x[0] < 300]


@given(st.lists(st.floats(0, 1, exclude_max=True), min_size=2, max_size=5), st.integers(1, 12))
def test_probes_come_in_order_of_success(inside, n):
    from itertools import product

    every = []
    for moves in product((-1, 0, 1), repeat=len(inside)):
        every.append(sum(f * f if m < 0 else (1 - f) ** 2 for f, m in zip(inside, moves) if m))
    steps = 7 ** np.arange(len(inside))
    codes, scores = ann.probe_sequence(np.array([inside]), steps, n)
    assert np.allclose(scores[0], sorted(every)[: len(scores[0])]) and len(scores[0]) == min(n, len(every))
    for code, score in zip(codes[0].tolist(), scores[0]):
        moves = [m for m in product((-1, 0, 1), repeat=len(inside)) if np.dot(m, steps) == code]
        assert len(moves) == 1 and score == pytest.approx(sum(f * f if m < 0 else (1 - f) ** 2 for f, m in zip(inside, moves[0]) if m))

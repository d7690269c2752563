"""Toxicity, packing, SentencePiece: held-out accuracy, brute force, round trips."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import packing, toxicity, viterbi
from paperloom.llm.queries import tokenizer_path

RNG = random.Random(7)
MILD, CLEAN = [f"bad{k}" for k in range(8)], [f"word{k}" for k in range(500)]


def toxic_text(n, k):
    out = [RNG.choice(CLEAN) for _ in range(n)]
    for _ in range(k):
        out[RNG.randrange(n)] = RNG.choice(MILD)
    return " ".join(out)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for k in range(700):
        bad = k % 5 == 0
        rows.append((k, toxic_text(60, RNG.randrange(1, 9) if bad else 0), int(bad)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:500]] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    return rows, docs, labels


def test_toxicity_held_out(spark, labelled):
    rows, docs, labels = labelled
    model = toxicity.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == toxicity.GRADES
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = rows[500:]
    assert sum(got[i]["toxic"] == bool(y) for i, _, y in held) >= 0.97 * len(held)
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in got.values())
    mild, strong = (np.mean([got[i]["severity"] for i, t, y in held if y and f(sum(w in MILD for w in t.split()))]) for f in (lambda n: n <= 2, lambda n: n >= 6))
    assert mild < strong
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}


def test_scores_equal_the_formula(spark, labelled):
    """Severity is the sum over thresholds of P(grade > k), by plain arithmetic on the words of the text."""
    rows, docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows[::20]:
        words = text.lower().split()
        z = 0.0
        for f, w in model.weights.items():
            n = sum(x[: len(f) - 1] == f[1:] and len(x) > len(f) - 1 for x in words) if f.startswith("^") else words.count(f)
            z += w * 3 * math.log(1 + 100 * n / len(words))
        above = [1 - 1 / (1 + math.exp(min(40, z - t))) for t in model.thresholds]
        assert got[i]["severity"] == pytest.approx(sum(above), abs=1e-6) and got[i]["p_toxic"] == pytest.approx(above[0], abs=1e-6)
        p = [1 - above[0], *(a - b for a, b in zip(above, [*above[1:], 0], strict=True))]
        assert got[i]["grade"] == int(np.argmax(p)) and got[i]["toxic"] == (above[0] >= toxicity.CUTOFF)


def test_the_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 4, f"word{k} bad0" if k % 2 else f"word{k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)] * 3, "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_cumulative_link
    monkeypatch.setattr(toxicity, "LEAST_G", 0.0)
    monkeypatch.setattr(toxicity, "fit_cumulative_link", lambda owner, at, values, grades, n, **k: seen.append(len(grades)) or fit(owner, at, values, grades, n, **k))
    toxicity.fit(docs, labels, sample_rows=12)
    assert seen == [4]


def test_toxicity_edges(spark, labelled):
    _, docs, labels = labelled
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "bad1 " * 9), (4, "bad1 bad2 " * 50_000), (4, "x")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["toxic"]) for r in toxicity.score(odd, model).collect()) == [("1", False), ("2", False), ("4", False), ("4", True), ("None", True)]
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.drop_toxic(odd.limit(0), model).count() == 0
    blank = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, blank).filter("toxic").count() == 0


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, toxicity.GRADES + 1, 300)
    owner, at, values = np.arange(300), np.zeros(300, int), grades + rng.normal(0, 0.5, 300)
    weights, theta = toxicity.fit_cumulative_link(owner, at, values, grades, 1, steps=1500)

    def loss(w, t):
        cdf = lambda k: 1.0 if k >= len(t) else 0.0 if k < 0 else 1 / (1 + np.exp(-(t[k] - w * values)))
        p = np.array([np.broadcast_to(cdf(k), 300) for k in range(len(t) + 1)])
        low = np.vstack((np.zeros(300), p[:-1]))
        return -np.log((p - low)[grades, np.arange(300)]).mean() + 0.5e-3 * w * w

    best = loss(weights[0], theta)
    for dw, dt in ((0.02, 0), (-0.02, 0), (0, np.array([0.05, 0, 0])), (0, np.array([0, -0.05, 0])), (0, np.array([0, 0, 0.05]))):
        assert loss(weights[0] + dw, theta + dt) >= best - 1e-6


# --- packing ---


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_tree_is_first_fit(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    bins, offsets = packing.first_fit_decreasing(sizes, 20)
    room: list[int] = []
    for size, b, o in zip(sizes.tolist(), bins, offsets, strict=True):
        want = next((k for k, r in enumerate(room) if r >= size), len(room))
        if want == len(room):
            room.append(20)
        assert b == want and o == 20 - room[want]
        room[want] -= size


def test_packing_is_whole(spark):
    texts = [None, "", "plain text", "plain text", "<|endoftext|> is ordinary", "é漢😀" * 50, "word " * 30_000]
    texts += [toxic_text(RNG.randrange(1, 900), 0) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "lost", "x")], "doc_id long, text string, start string")
    rows = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), group_pieces=16).toPandas()
    encode = packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        ids = np.array([*encode([t or ""])[0], 0], "<u4")
        own = rows[rows.doc_id == k].sort_values("start")
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, one in rows.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == np.cumsum([0, *one.length])[:-1].tolist() and one.length.sum() <= 1024
    assert packing.pack_documents(docs.limit(0), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_one_id_spreads_over_all_groups(spark):
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "concat('word ', id % 3) AS text")
    pieces = packing.tokenize_pieces(docs, tokenizer_path("byte_bpe_50k.tiktoken"))
    sizes = [r["count"] for r in pieces.groupBy((pieces.draw % 25).alias("g")).count().collect()]
    assert len(sizes) == 25 and max(sizes) < 4400 and sum(sizes) == 100_000


def test_a_repeated_id_keeps_both_texts(spark):
    docs = spark.createDataFrame([(1, "one", "a"), (1, "two words", "b"), (1, "one", "c"), (2, None, "d")], "doc_id long, text string, draw string")
    rows = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in rows) == [(1, 2), (1, 2), (1, 3), (2, 1)]
    assert [r["offset"] for r in sorted(rows, key=lambda r: r["offset"])] == [0, 3, 5, 7] and len({r["sequence_id"] for r in rows}) == 1


def test_both_vocabulary_files_give_equal_ids():
    texts = ["Hello  world\n\n 12345 don't", "\t\r\n x", "<|endoftext|>", "ÀÉ 漢字 😀‍👩", "a" * 5000, ""]
    one, two = (packing.encoder(tokenizer_path(f"byte_bpe_50k.{kind}"))(texts) for kind in ("json", "tiktoken"))
    assert one == two


# --- SentencePiece ---

MODEL = tokenizer_path("piece_bpe_32k.model")


def as_unigram(codec):
    """The same pieces and scores as a unigram model of the library."""
    import sentencepiece

    def number(n):
        out = b""
        while n >= 128:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    data = b""
    for k, piece in enumerate(codec.pieces):
        kind = 2 if own.is_unknown(k) else 3 if own.is_control(k) else 6 if own.is_byte(k) else 1
        text = piece.encode()
        one = b"\x0a" + number(len(text)) + text + b"\x15" + struct.pack("<f", codec.scores.get(k, 0.0)) + b"\x18" + number(kind)
        data += b"\x0a" + number(len(one)) + one
    trainer, normalizer = b"\x18\x01" + number(35 << 3) + b"\x01", b"\x0a\x08identity\x18\x01\x20\x00\x28\x01"
    for field, part in ((b"\x12", trainer), (b"\x1a", normalizer)):
        data += field + number(len(part)) + part
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def test_viterbi_is_as_good_as_the_library():
    codec = viterbi.Codec(MODEL)
    library = as_unigram(codec)
    rng = random.Random(3)
    same = 0
    for _ in range(200):
        text = " ".join("".join(rng.choice("aeiourstnlé") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 12)))
        score, ids = codec.encode(text)
        other = library.encode(text)
        assert abs(score - sum(codec.scores[k] for k in other)) < 1e-3  # the library adds in single precision
        same += ids.tolist() == other
    assert same >= 190


def test_viterbi_is_best_by_brute_force():
    codec = viterbi.Codec(MODEL, "stored")
    known = {codec.pieces[k]: codec.scores[k] for k in codec.plain}
    for text in ("the cat", "aab", "internationalization", "a  b"):
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e18] * len(marked)
        for end in range(1, len(marked) + 1):
            best[end] = max(best[s] + known[marked[s:end]] for s in range(end) if marked[s:end] in known)
        assert codec.encode(text)[0] == pytest.approx(best[-1])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    own = viterbi.codec(MODEL)
    assert own.decode(own.encode(text)[1].tolist()) == text


def test_sentencepiece_table(spark):
    rows = [(1, None), (2, ""), (3, " ▁ a▁b \x00\n"), (3, "repeat"), (None, "no id"), (5, "abc " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = viterbi.encode_documents(docs, MODEL)
    assert [r["decoded_equal"] for r in coded.collect()] == [True] * 6
    back = sorted((str(r["doc_id"]), r["text"]) for r in viterbi.decode_documents(coded, MODEL).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert viterbi.encode_documents(docs.limit(0), MODEL).count() == 0

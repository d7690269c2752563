"""Licences, fingerprints and HTML against brute force."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest

from paperloom.llm import fingerprints, html_text, licenses

RNG = random.Random(11)
APACHE = "Licensed under the Apache License, Version 2.0."
LONG_MIT = " ".join(licenses.TEMPLATES["mit-text"][0].split())


def prose(n):
    return " ".join(f"p{RNG.randrange(3000)}" for _ in range(n))


def scan(spark, texts):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    return [r for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]


def test_labels(spark):
    texts = [
        None, "", "...", f"{prose(300)}\n{APACHE}", f"{prose(50)} {LONG_MIT} {prose(50)}", "Licensed under CC BY-NC 4.0.", "All rights reserved.",
        "GNU General   Public-License", "licensed under the apache tree version 2 0", "the license of all cats cc by", APACHE + " " + prose(40_000),
    ]
    got = scan(spark, texts)
    assert [r["labels"] for r in got] == [
        "", "", "", "apache-2.0", "mit-text", "cc-by,cc-by-nc-4.0", "all-rights-reserved,reserved", "gpl", "", "cc-by", "apache-2.0",
    ]
    assert [r["n_words"] for r in got[:3]] == [0, 0, 0] and got[0]["first_word"] is None and got[0]["score"] == 0
    span = got[4]["spans"][0]
    assert span["first_word"] == 50 and span["coverage"] == 1.0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_an_edited_notice_is_still_found(spark):
    words = LONG_MIT.split()
    for k in (9, 20, 33):
        words[k] = "zzz"
    words.insert(15, "inserted")
    assert "mit-text" in scan(spark, [" ".join(words)])[0]["labels"]


def test_base_places_equal_brute_force(spark):
    pool = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "x", "É"]
    texts = [RNG.choice((" ", "-", "\n")).join(RNG.choice(pool) for _ in range(RNG.randrange(60))) for _ in range(80)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text, r in zip(texts, scan(spark, texts), strict=True):
        words = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        places = sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))


def chain_by_hand(own, words):
    """Length of the longest common subsequence by the table of all prefixes."""
    row = [0] * (len(words) + 1)
    for a in own:
        new = [0]
        for k, b in enumerate(words):
            new.append(row[k] + 1 if a == b else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_chains_equal_brute_force():
    for _ in range(300):
        own, words = ([RNG.choice([b"a", b"b", b"c", b"d"]) for _ in range(RNG.randrange(12))] for _ in range(2))
        places = {w: [k for k, x in enumerate(own) if x == w] for w in own}
        size, lo, hi = licenses.longest_chain(places, words, 0, len(words))
        assert size == chain_by_hand(own, words)
        if size:
            assert chain_by_hand(own, words[lo : hi + 1]) == size
            assert chain_by_hand(own, words[:hi]) < size and chain_by_hand(own, words[lo + 1 : hi + 1]) < size


def test_every_template_is_found_with_words_put_in_taken_out_and_changed():
    index = licenses.build_index({}, 1000)
    rare = frozenset(index)
    for label, own in licenses.template_words().items():
        sizes = [0] if len(own) < 12 else [0, len(own) // 20, len(own) // 10]
        for edits in sizes:
            for _ in range(5):
                words = list(own)
                keys = {w for p in licenses.TEMPLATES[label][1] for w in p.encode().split()}
                for _ in range(edits):
                    k = RNG.randrange(len(words))
                    if words[k] in keys:
                        continue
                    kind = RNG.randrange(3)
                    words[k : k + 1] = [] if kind == 0 else [b"zzz"] if kind == 1 else [words[k], b"qqq"]
                text = prose(30).encode().split() + words + prose(30).encode().split()
                spans = [s for s in licenses.match_templates(text, index, rare.intersection(text), 0.7) if s[0] == label]
                # the key phrases may have been torn by an insertion between them
                stretch = b" " + b" ".join(words) + b" "
                if all(b" " + p.encode() + b" " in stretch for p in licenses.TEMPLATES[label][1]):
                    assert len(spans) == 1 and abs(spans[0][1] - 30) <= edits + 1, (label, edits)
                    assert spans[0][3] == pytest.approx(chain_by_hand(own, text) / len(own), abs=0.05)


def test_each_of_many_placements_is_found_and_none_beyond():
    index = licenses.build_index({}, 1000)
    rare = frozenset(index)
    own = licenses.template_words()
    text, want = [], []
    for _ in range(40):
        text += prose(RNG.randrange(3, 60)).encode().split()
        label = RNG.choice(("mit-text", "isc-text", "zlib-text", "unlicense-text"))
        want.append((label, len(text), len(text) + len(own[label]) - 1, 1.0))
        text += own[label]
    assert licenses.match_templates(text, index, rare.intersection(text), 0.7) == sorted(want)
    scattered = sorted({w for ws in own.values() for w in ws}) * 3
    RNG.shuffle(scattered)
    plain = [s for s in licenses.match_templates(scattered, index, rare.intersection(scattered), 0.7) if len(own[s[0]]) > 12]
    assert plain == []


@pytest.mark.parametrize("unit", ["cc by ", "mit license ", "all rights reserved ", LONG_MIT + " ", "permission software copyright granted "], ids=lambda u: u[:12])
def test_long_repeats_take_linear_time(unit):
    index = licenses.build_index({}, 1000)
    words = licenses.words_of((unit * (1_200_000 // len(unit))).encode())
    start = time.process_time()
    licenses.base_places(words)
    licenses.match_templates(words, index, frozenset(index).intersection(words), 0.7)
    assert time.process_time() - start < 30


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, APACHE), (1, APACHE), (None, APACHE), (1, "x")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["labels"]) for r in licenses.scan_licenses(docs).collect()) == [("1", ""), ("1", "apache-2.0"), ("1", "apache-2.0"), ("None", "apache-2.0")]


def test_no_documents(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- fingerprints ---


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_fingerprints(spark):
    base = prose(2000)
    texts = [None, "", "é", "one two three", base, base, base[: len(base) // 3], prose(900), "  "] + [prose(RNG.randrange(1, 400)) for _ in range(40)]
    docs = spark.createDataFrame([(k * 10, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, range_id int").repartition(5)
    got = fingerprints.fingerprint_documents(docs).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    assert [r["doc_id"] for r in got] == [k * 10 for k in range(len(texts))]
    for k, r in enumerate(got):
        after = plain[(k + 1) % len(plain)]
        cut = len(plain[k]) // 4
        edited = plain[k][: len(plain[k]) - cut] + after[:cut]
        assert r["n_chars"] == len(plain[k]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprints.encode(fingerprints.sketches([edited.encode()])[0])
        if len(plain[k]) > 3000:
            a, b = shingles(plain[k]), shingles(edited)
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.15
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0
    assert got[5]["contained_in_next"] < 0.5 and got[0]["near_next"] == 1.0 and got[1]["near_next"] == 0.0


MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def sketch_by_hand(text, fraction=fingerprints.FRACTION):
    """Hashes of shingles one by one in whole numbers; none of the operator's array code."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    own = [mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & MASK) for w in words]
    runs = [own[k : k + 5] for k in range(len(own) - 4)] if len(own) >= 5 else [own] if own else []
    hashes = sorted({mixed(sum(h * pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k, h in enumerate(r)) & MASK) >> 16 for r in runs})
    return [h for h in hashes if h < int(fraction * (1 << 48))] or hashes[:1]


def test_fingerprints_equal_brute_force(spark):
    texts = [None, "", "é 漢字", "one two three", "a b c d e a b c d e", prose(30), "x" * 5000, prose(40) * 2, " \n", prose(20_000)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    plain = [t or "" for t in texts]
    for k, r in enumerate(fingerprints.fingerprint_documents(docs).orderBy("doc_id").collect()):
        after = plain[(k + 1) % len(plain)]
        cut = len(plain[k]) // 4
        own, edited, following = sketch_by_hand(plain[k]), sketch_by_hand(plain[k][: len(plain[k]) - cut] + after[:cut]), sketch_by_hand(after)
        assert r["fingerprint"] == base64.b64encode(b"".join(h.to_bytes(6, "big") for h in own)).decode()
        assert r["edited_fingerprint"] == base64.b64encode(b"".join(h.to_bytes(6, "big") for h in edited)).decode()
        for other, near, inside in ((edited, "near_edited", "contained_in_edited"), (following, "near_next", "contained_in_next")):
            a, b = set(own), set(other)
            assert r[near] == pytest.approx(len(a & b) / len(a | b) if a and b else float(len(a) == len(b)))
            assert r[inside] == pytest.approx(len(a & b) / len(a) if a and b else float(len(a) == len(b)))


def test_one_id_for_all_rows(spark):
    docs = spark.createDataFrame([(5, f"text {k} of many words that are here") for k in range(300)], "doc_id long, text string").repartition(4)
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == 300 and {r["doc_id"] for r in got} == {5}


def test_one_row_is_its_own_next_and_none_gives_none(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h"), (None, "x")], "doc_id long, text string")
    got = fingerprints.fingerprint_documents(one).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(one.limit(0)).count() == 0


def test_repeated_ids_have_each_a_next(spark):
    rows = spark.createDataFrame([(k % 3, f"text {k}") for k in range(30)], "doc_id long, text string").repartition(4)
    assert fingerprints.fingerprint_documents(rows).count() == 30


def test_sketches_merge_and_estimate():
    one, two = prose(5000), prose(3000)
    a, b, both = fingerprints.sketches([one.encode(), two.encode(), f"{one}\n{two}".encode()])
    merged = fingerprints.merge(a, b)
    assert len(np.setdiff1d(merged, both)) == 0 and len(both) - len(merged) <= 4
    assert np.array_equal(fingerprints.decode(fingerprints.encode(a)), a)
    assert fingerprints.likeness(b, both)[1] == pytest.approx(1.0)
    tiny = fingerprints.sketches([b"one", b"two"], 1e-6)
    assert [len(t) for t in tiny] == [1, 1] and len(fingerprints.merge(*tiny, 1e-6)) == 1


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> The Site</header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies for everything we do here, please accept them all now.</div>
<div class="layout"><aside class="sidebar"><p>Related things to read when you have nothing else to do today.</p></aside>
{body}
<div id="comments"><h2>Comments</h2><div class="comment"><p>First! This is a long reader comment that says nothing of interest at all.</p></div></div></div>
<form><label>Name</label><input name="q"><button>Send</button></form><footer>&copy; Someone</footer></body></html>"""
BODY = """<h1>The &amp; Title</h1><p>First   paragraph with <b>bold</b>,<br>and a <a href="#">link</a> in it that goes on for a while.
<p>Short.</p><ol class="commentlist"><li>me too</li></ol><div class="ad">Buy now! The best things at the best price for everyone.</div><ul><li>item one</li><li>item two</li></ul>
<p>Last &lt;paragraph&gt; of the text, long enough to be counted as a part of it.</p>"""
TEXT = (
    "The & Title\nFirst paragraph with bold, and a link in it that goes on for a while.\nShort.\nitem one\nitem two\n"
    "Last <paragraph> of the text, long enough to be counted as a part of it."
)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<article><header>{}</header></article>",
                                  "<main><p>A lead that is not a part of the article.</p><article>{}</article></main>"])
def test_main_text(wrap):
    assert html_text.extract(PAGE.format(body=wrap.format(BODY))) == TEXT


def test_broken_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html><body></body></html>") == ""
    assert html_text.extract("<article><p>open <b>text<p>more</article><footer>f") == "open text\nmore"
    assert html_text.extract("just text, no tags & nothing &amp; else") == "just text, no tags & nothing & else"
    assert html_text.extract("<article>a < b and <b>c</b> > d</article>") == "a < b and c > d"
    assert html_text.extract("<article><p>x</p><script>never closed <p>y") == "x"
    assert html_text.extract("<article><nav><a href=x>m</a><p>menu</article><p>after</p>") == "after"
    assert html_text.extract("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_pages_table(spark):
    rows = [(1, "u", "<article><p>x &amp;&nbsp;y</p></article>"), (2, None, None), (2, "v", ""), (None, "w", "<p>z</p>")]
    got = html_text.extract_pages(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "x & y", 5), ("2", "", 0), ("2", "", 0), ("None", "z", 1)]
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

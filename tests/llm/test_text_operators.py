"""BPE, personal data, quality rules, licences: against brute force on fixtures."""

import hashlib
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA, ODD, prose
from tidemark.llm import bpe, licences, pii, quality
from tidemark.llm.arrow_text import Words, slices


def test_slices_cover_all_rows_and_never_cut_a_text():
    texts = [b"x" * n for n in (3, 0, 50, 1, 1, 1)]
    parts = list(slices(texts, 4))
    assert [i for a, b in parts for i in range(a, b)] == list(range(6)) and (2, 3) in parts
    assert list(slices([])) == []


def test_words_end_at_texts():
    w = Words([b"ab cd", b"", b"cd\x0bAB"], lower=True)
    assert list(np.diff(w.first)) == [2, 0, 2]
    h = w.hashes()
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


# -- BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.default_path())


def test_bpe_equals_library(library, vocabulary):
    encoder, decoder, rng = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary), random.Random(5)
    parts = ["the", "ing", " ", "\n", "'s", "<|endoftext|>", "é", "é", "ΑΣ", "Σ", "İ", "😀", "\x1c", "\xa0", "7", "12", "$$", "!!!", "th", "er", "'ll", "中文", "\x00", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghinorstue") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["", "a" * 3000, prose(1, 2000)]
    for t in texts:
        ids = np.frombuffer(encoder.encode(t), np.int32)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert decoder.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_equals_library_at_every_code_point(library, vocabulary):
    encoder = bpe.Encoder(vocabulary)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 4000):
        t = " ".join(f"a{chr(c)}b Q{chr(c)}" for c in every[k : k + 4000])
        assert np.frombuffer(encoder.encode(t), np.int32).tolist() == library.encode(t, add_special_tokens=False).ids, hex(every[k])


def test_bpe_normal_form_of_every_mark(library):
    from tokenizers import normalizers

    form = normalizers.NFC()
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    pairs = ["".join(chr(int(x, 16)) for x in d.split()) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and not 0xD800 <= c < 0xE000]
    for t in [f"a\u0315{m}\u0316" for m in marks] + pairs + [p + "\u0316\u0301" for p in pairs]:
        assert bpe.composed(t) == form.normalize_str(t), t.encode("unicode_escape")


def test_bpe_memory_is_emptied_and_refilled(vocabulary, monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(vocabulary)
    t = prose(9, 60)
    assert np.frombuffer(encoder.encode(t), np.int32).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(encoder.known) <= 3


def test_bpe_query(spark, small, library):
    got = {r["doc_id"]: r for r in bpe.op8_bpe(spark, DATA).collect()}
    for r in small.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(docs_of, vocabulary):
    docs = docs_of(ODD).withColumn("ids", F.lit("clash"))
    out = bpe.encode(docs, vocabulary, decoded=True).collect()
    assert len(out) == len(ODD) and [r["ids"] for r in out if not r["text"]] == [[]] * 3
    assert bpe.encode(docs_of([]), vocabulary).count() == 0


# -- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), pii.KINDS.index(k), m.end(), k))
    return sorted(out)


def test_pii_base_equals_plain_patterns():
    rng = random.Random(2)
    parts = [*"@@..a1b-_+%() 12390é\n", "4111 1111 1111 1111", "1.2.3.4", "+1 (212) 555-1234", "x@y.zz"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert sorted((a, pii.KINDS.index(k), b, k) for k, a, b in pii.base_spans(t)) == brute_spans(t), t


def test_pii_query(spark, small):
    got = {r["doc_id"]: r for r in pii.op6_pii(spark, DATA).collect()}
    for r in small.collect():
        spans = brute_spans(r["text"])
        g = got[r["doc_id"]]
        assert tuple(g[f"n_{k}"] for k in pii.BASE) == tuple(sum(s[3] == k for s in spans) for k in pii.BASE)
        assert g["base_sha256"] == hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()
        every = [s.split(":")[0] for s in g["spans"].split(",") if s]
        assert tuple(g[f"n_{k}"] for k in pii.KINDS) == tuple(every.count(k) for k in pii.KINDS) and g["n_spans"] == len(every)


def test_pii_added_kinds_need_proof_or_context():
    kinds = lambda t: [s.kind for s in pii.spans(t)]
    assert "iban" in kinds("iban GB82 WEST 1234 5698 7654 32 ok") and "iban" not in kinds("iban GB82 WEST 1234 5698 7654 33 ok")
    assert "ssn" in kinds("my ssn is 123-45-6789") and kinds("code 123-45-6789") == []
    assert "local_phone" in kinds("call (212) 555-1234 now") and kinds("(212) 555-1234") == []
    assert pii.spans("mail a@b.cc")[0].score > pii.spans("a@b.cc")[0].score
    assert pii.redact("x a@b.cc y", pii.spans("x a@b.cc y")) == "x <EMAIL> y"


def test_pii_secrets():
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    secrets = lambda t: [t[s.start : s.end] for s in pii.spans(t) if s.kind == "secret"]
    assert secrets(f'the token = "{key}".') == [key] and secrets(f"API_KEY={key}") == [key] and secrets(f"my api key: {key}, ok") == [key]
    assert secrets(f'token = "{key}"### that.92@mail2.example.com') == [key] and secrets(f"for example the token {key}") == []
    assert secrets(f"checksum {key}") == [] and secrets(f"token https://x.org/{key}/y") == []
    assert secrets("the secret of " + "a" * 40) == [] and secrets("password " + "1" * 40) == [] and secrets("password " + "-" * 50_000) == []
    assert secrets(f"token {key}@mail.org") == [] and pii.redact(f"token {key}", pii.spans(f"token {key}")) == "token <SECRET>"


def test_pii_long_runs_of_zeros_and_many_spans():
    assert [s.kind for s in pii.spans("1.2.3." + "0" * 5000)] == ["ip"] and pii.spans("1.2.3." + "0" * 5000 + "256") == []
    assert [s.kind for s in pii.spans("0000.1.2.3 and 000255.0.0.0")] == ["ip", "ip"]
    t = "call (212) 555-1234 or a@b.cc, " * 8000
    began = time.process_time()
    assert len(pii.spans(t)) == 16000
    assert time.process_time() - began < 5


def test_pii_odd_rows(docs_of):
    rows = [*ODD, (9, "1" * 20000), (10, "@" * 5000 + "a@" * 3000), (11, "a." * 5000)]
    out = pii.find(docs_of(rows).withColumn("pii_spans", F.lit(1)), redacted=True).collect()
    assert len(out) == len(rows) and all(r["redacted_text"] == (r["text"] or "") for r in out if not r["pii_spans"])
    assert pii.find(docs_of([])).count() == 0


# -- quality rules

def brute_counts(t):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts(spark, small):
    got = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, DATA).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    agree = []
    for r in small.collect():
        g, want = got[r["doc_id"]], brute_counts(r["text"])
        assert tuple(g[c] for c in quality.STATS) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g["base_failed"] and g["kept"])
        if r["doc_id"] in labels and not g["base_failed"]:
            agree.append(g["kept"] == bool(labels[r["doc_id"]]))
    assert np.mean(agree) > 0.9  # a few dozen labels only


def test_quality_counts_on_random_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "é", " ", "\n", "\r", "#", "\x0b", "a b c "]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    counts, x = quality.statistics([t.encode() for t in texts])
    assert [tuple(int(counts[c][i]) for c in quality.STATS) for i in range(len(texts))] == [brute_counts(t) for t in texts]
    assert np.isfinite(x).all()


def test_trees_learn_and_keep_their_direction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x[:2000], y[:2000], monotone=(-1, 0, 0))
    assert np.mean((model.margin(x[2000:]) > 0) == y[2000:]) > 0.97
    line = np.tile([[0.0, 0.7, 0.5]], (50, 1))
    line[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(model.margin(line)) <= 1e-12).all()
    assert quality.fit(x[:0], y[:0]).margin(x[:2]).tolist() == [0.0, 0.0]


def test_quality_odd_rows(docs_of, spark):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    model = quality.train(docs_of(ODD), labels)
    out = quality.with_quality(docs_of(ODD).withColumn("kept", F.lit("x")), model).collect()
    assert len(out) == len(ODD) and not any(r["kept"] for r in out)
    assert quality.with_quality(docs_of([]), quality.train(docs_of([]), labels)).count() == 0


# -- licences

def brute_base(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    at = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_scan(t):
    """Rules one by one with Python's expressions, suppression by looking at all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    norm = " " + " ".join(words) + " " if words else " "
    found = set()
    for r in licences.rules():
        if f" {r.keyword}" in norm:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                found.add((start, start + m[0].count(" ") + 1, r.priority, r.label))
    keep = {d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and e[1] - e[0] > d[1] - d[0]) for e in found)}
    return ",".join(sorted({d[3] for d in keep} | {x for x in brute_base(t)[4].split(",") if x}))


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "CC BY-NC 4.0 and CC-BY", "mit license mit license MIT LICENSE", "the mit\nlicensees", "BSD 3-Clause License; MPL 2.0; Mozilla Public License 2.0", "dual GPLv2 / gpl v2 only, LGPL 2.1 or later",
    "nothing here", "cc by", "xcc by y", "all rights reserved. apache 2.0 license", "creative commons attribution share alike 4.0 international",
]


def test_licences_against_brute_force(spark, docs_of, small):
    texts = LICENSED + [prose(1, 30) + " " + a + " " + b for a in LICENSED[:6] for b in LICENSED[4:]]
    rows = list(enumerate(texts)) + [(1000 + r["doc_id"], r["text"]) for r in small.collect()]
    for r in licences.scan(docs_of(rows)).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(r["text"]), r["text"]
        assert r["labels"] == brute_scan(r["text"]), r["text"]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["detections"])


def test_licences_suppress_what_they_contain(docs_of):
    got = licences.scan(docs_of([(1, "GNU General Public License v2 or later")])).first()
    assert got["labels"] == "gpl,gpl-2-or-later" and got["base_labels"] == "gpl"
    assert len(licences.rules()) > 300


def test_licences_odd_rows(docs_of):
    rows = [*ODD, (20, "mit license " * 300)]
    out = licences.scan(docs_of(rows).withColumn("score", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    assert {(r["n_words"], r["labels"], r["score"]) for r in out if not (r["text"] or "").strip()} == {(0, "", 0.0)}
    assert next(r["n_base"] for r in out if r["doc_id"] == 20) == 300
    assert licences.scan(docs_of([])).count() == 0


def test_licences_are_native(docs_of):
    plan = licences.scan(docs_of(ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_licence_keywords_are_in_every_match():
    for r in licences.rules():
        least, before = r.pattern, None
        while least != before:  # without what is optional; of alternatives each
            before, least = least, re.sub(r"\(\?:[^()]*\)\?|(?<=[a-z ])[a-z ]?\?(?!:)", "", least)
        texts = [least]
        while any("(?:" in t for t in texts):
            texts = [t.replace(m[0], x, 1) for t in texts if (m := re.search(r"\(\?:([^()]*)\)", t)) for x in m[1].split("|")] or texts
        for t in texts:
            assert " " + r.keyword in " " + t.replace("[cs]", "c"), r

"""Repetition rules, importance resampling and the divergence audit next to plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import divergence, repetition, resample

LETTERS = st.lists(st.sampled_from([b"a", b"b", b"c\xc3\xa9"]), max_size=40).map(b" ".join)


def cells(rows, *names):
    """Rows as sorted texts, so that null ids and repeated rows compare."""
    return sorted(repr(tuple(r[n] for n in names)) for r in rows)


def twice(words, width):
    """Words in windows of ``width`` that occur twice or more."""
    seen = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return {i + j for i in range(len(words) - width + 1) if seen[tuple(words[i : i + width])] > 1 for j in range(width)}


def maximal_repeats(words, least):
    found = set()
    for width in range(least, len(words)):
        at = {}
        for i in range(len(words) - width + 1):
            at.setdefault(tuple(words[i : i + width]), []).append(i)
        for key, own in at.items():
            left = {words[i - 1] if i else i for i in own}
            right = {words[i + width] if i + width < len(words) else -1 for i in own}
            if len(own) > 1 and len(left) > 1 and len(right) > 1:
                found.add(key)
    return found


@settings(deadline=None, max_examples=60)
@given(st.lists(LETTERS, max_size=5), st.integers(1, 4))
def test_repeats_are_those_of_all_windows(texts, least):
    if not texts:
        return
    own = repetition.repetition(texts, least)
    for i, text in enumerate(texts):
        words = text.split()
        repeats = maximal_repeats(words, least)
        covered = [j for s in own["spans"][i] for j in range(s["start"], s["start"] + s["words"])]
        assert set(covered) == twice(words, least) and len(covered) == own["n_covered"][i]
        assert (own["n_words"][i], own["n_repeat_words"][i]) == (len(words), len(twice(words, 3)))
        assert (own["n_repeats"][i], own["longest"][i]) == (len(repeats), max(map(len, repeats), default=0))


def test_repetition_rules(spark, docs, documents, no_docs, null_id_docs):
    rows = repetition.rules(docs).collect()
    assert len(rows) == len(documents)
    texts = {r[0]: r[1] or "" for r in documents}
    for r in rows:
        text = texts[r.doc_id]
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r.n_words == len(words) and r.word_chars == len(b"".join(words).decode())
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_dup_lines == len(lines) - len(set(lines))
        repeated = len(twice(words, 3))
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        covered, long = len(twice(words, repetition.LEAST)), twice(words, repetition.MOST_LONG + 1)
        assert (r.n_repeat_words, r.base_failed, r.n_covered) == (repeated, failed, covered)
        assert r.kept == (not failed and 100 * covered <= repetition.MOST_COVERED * len(words) and not long)
    assert {r.kept for r in rows} == {True, False}
    assert repetition.rules(no_docs).collect() == [] and not any(r.kept for r in repetition.rules(null_id_docs).collect())
    passage = " ".join(f"w{i}" for i in range(60))
    others = [" ".join(f"{c}{i}" for i in range(200)) for c in "xyz"]
    long = spark.createDataFrame([(1, f"{others[0]} {passage} {others[1]} {passage} {others[2]}"), (2, " ".join(others))], "doc_id long, text string")
    assert [(r.longest, r.n_repeats, r.base_failed, r.kept) for r in repetition.rules(long).orderBy("doc_id").collect()] == [(60, 1, False, False), (0, 0, False, True)]


def test_long_repetitive_text_in_one_portion():
    own = repetition.repetition([b"same " * 60_000 + b"end", b"", b"same same"], 8)
    assert own["n_covered"].tolist() == [60_000, 0, 0] and own["longest"].tolist() == [59_999, 0, 0]


@given(st.lists(st.binary(max_size=60), max_size=6), st.integers(1, 4))
def test_checksums_of_ngrams_from_prefixes(texts, longest):
    texts = [*texts, b"x" * 70_000 + b" Y-z"]
    for n, (owner, found) in enumerate(resample.ngram_checksums(texts, longest), 1):
        words = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in texts]
        expected = [(i, zlib.crc32(b" ".join(w[j : j + n]))) for i, w in enumerate(words) for j in range(len(w) - n + 1)]
        assert expected == list(zip(owner.tolist(), found.tolist(), strict=True))


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, docs, documents, no_docs, null_id_docs, longest):
    target = spark.createDataFrame([(documents[i][1], 1) for i in (4, 9, 9)] + [(None, 2)], "text string, weight int")

    def buckets(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 500 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own = [(r[0], *buckets(r[1])) for r in documents]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for r in target.collect() for b in buckets(r.text)[1])
    gain = {b: floor(1000 * log((t[b] + 1.0) * (sum(s.values()) + 500.0) / ((s[b] + 1.0) * (sum(t.values()) + 500.0)))) for b in s}
    expected = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        expected.append((i, n, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in expected if x[1] >= 20), key=lambda x: (-x[4], x[0]))
    taken = order[: 10 * len(order) // 100]
    ranks = {(x, i): i + 1 for i, x in enumerate(taken)}
    rows = resample.resample(docs, target, longest, buckets=500).collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(expected) and len(taken) > 3
    assert {(tuple(r)[:5], r.rank - 1): r.rank for r in rows if r.rank} == ranks
    assert [r.rank for r in resample.resample(docs, target, percent=100).where("rank is not null").orderBy("rank").collect()] == [*range(1, len(order) + 1)]
    assert resample.resample(no_docs, target).collect() == []
    assert cells(resample.resample(null_id_docs, target.limit(0)).collect(), "n_words", "rank") == cells([{"n_words": n, "rank": None} for n in (0, 7, 7)], "n_words", "rank")


def test_equal_scores_are_drawn_by_id(spark):
    scored = spark.createDataFrame([(i if i else None, 30, 30, 0, 5 + (i == 4)) for i in range(8)], "doc_id long, n_words long, n_features long, weight long, score long")
    rows = resample.drawn(scored, scored["n_words"] > 0, 50).where("rank is not null").orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [4, 1, 2, 3]


def plain_audit(documents, least, top):
    docs = [tuple(x or "" for x in (r[1], r[2], r[3])) for r in documents]
    terms = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, _, _ in docs]
    rows = []
    for lang in {d[1] for d in docs}:
        own = [(d[2], t) for d, t in zip(docs, terms) if d[1] == lang]
        seen = Counter(x for _, t in own for x in t)
        kept = [x for x in seen if seen[x] >= least]

        def shares(counts):
            total = sum(counts[x] for x in kept)
            return {x: 1 + 10**9 * (counts[x] + 5) // (total + 5 * len(kept)) for x in kept}

        sums = {s: sum((t for o, t in own if o == s), Counter()) for s, _ in own}
        p = {s: shares(c) for s, c in sums.items()}
        q = shares(sum(sums.values(), Counter()))
        for s in p:
            pair = [(-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in p if o != s]
            term = [(q[x] - p[s][x], x.encode()) for x in kept if sums[s][x] and p[s][x] > q[x]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                rows += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(rows)


@pytest.mark.parametrize(("least", "top"), [(2, 5), (1, 50), (10**6, 5)])
def test_divergence(docs, documents, least, top):
    columns = ("lang", "source", "part", "item", "value", "rank")
    rows = divergence.audit(docs, least, top).select(*columns).collect()
    assert sorted(map(tuple, rows)) == plain_audit(documents, least, top) and len(rows) > 10


def test_divergence_of_odd_tables(no_docs, null_id_docs, monkeypatch, docs, documents):
    assert divergence.audit(no_docs).collect() == []
    assert sorted({(r.lang, r.source, r.value) for r in divergence.audit(null_id_docs).where("part = 'pair'").collect()}) == []
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)  # tasks send their sums in many parts
    assert sorted(map(tuple, divergence.audit(docs, 2, 5).collect())) == plain_audit(documents, 2, 5)


def test_totals_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**13, 3 * 10**13, 1000)], "n long, total long, v long")
    assert big.select(divergence._share("n", "total")).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 5000)
    assert np.array_equal(resample.moved(np.array([7, 9], np.uint32), np.array([0, 0])), [7, 9])

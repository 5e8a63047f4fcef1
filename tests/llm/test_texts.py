"""Operators on documents next to plain versions of what they promise."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import cuckoo, line_dedup, minhash, mixing, packing, quality, repeats, subword_lm
from tabloom.llm.suffix_tree import intervals, maximal_repeats


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_minhash_components_are_those_of_all_pairs(docs, documents, k, num):
    texts = {r[0]: r[1] for r in documents}
    sets = {i: shingles(t, k) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    expected = roots(sets, links)
    rows = minhash.near_duplicates(docs, k, num, 100).collect()
    assert len(rows) == len(documents) and len(links) > 15
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_block_links_join_what_hubs_leave(spark, docs, documents):
    """One bucket that holds all documents, in blocks of three."""
    sets = {i: shingles(t, 5) for i, t in ((r[0], r[1]) for r in documents) if shingles(t, 5)}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(minhash, "BLOCK", 3)
        members = ids.where(F.col("id").isin(list(sets))).select(F.lit(1).cast("long").alias("key"), "id", F.col("id").alias("root"))
        found = minhash._block_links(members, minhash._sets(docs.dropDuplicates(["doc_id"]), ids, 5), 80, 100).collect()
    assert roots(sets, [(r.a, r.b) for r in found]) == roots(sets, links)
    assert len(found) < len(links) * 3


def test_minhash_representatives_keep_columns(docs, documents, no_docs, null_id_docs):
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in minhash.near_duplicates(docs).where("NOT kept").collect()}
    assert kept.count() == sum(r[0] not in gone for r in documents)
    assert minhash.near_duplicates(no_docs).collect() == []
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in minhash.near_duplicates(null_id_docs).collect()) == [(False, 1, True), (True, None, True), (True, None, True)]


def test_signature_coordinates_agree_as_often_as_sets(spark):
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (600, 200, 200))
    same = minhash.signature(np.concatenate([both, a]), 4000) == minhash.signature(np.concatenate([both, b]), 4000)
    assert abs(same.mean() - 0.6) < 0.04


def plain_lines(documents):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(set)
    for r in documents:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(r[0])
    out = {}
    for r in documents:
        lines = (r[1] or "").split("\n")
        out[r[0]] = lines, [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == r[0]]
    return out


def test_line_dedup(docs, documents, no_docs, null_id_docs):
    expected = plain_lines(documents)
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(documents) and sum(r.n_dropped for r in rows) > 10
    for r in rows:
        lines, kept = expected[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert r.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert line_dedup.dedup_lines(no_docs).collect() == []
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(null_id_docs).collect()) == [(0, 0), (0, 0), (1, 1)]


def test_line_dedup_stage_keeps_columns(docs, documents):
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    expected = plain_lines(documents)
    for r in out.collect():
        assert r.text == (None if r.text is None else "\n".join(expected[r.doc_id][1])) and r.n_chars == (None if r.text is None else len(r.text))


def test_line_index_is_reversible(spark, docs):
    """Adding documents and taking them out again leaves the same answers, filters included."""
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    alone = line_dedup.LineIndex.of(first)
    grown = alone.add(second)
    back = grown.remove(second.select("doc_id"))
    drops = lambda x: sorted((r.doc_id, sorted(map(tuple, r["keys"]))) for r in x.drops().collect())
    assert drops(grown) == drops(line_dedup.LineIndex.of(docs)) and drops(back) == drops(alone) != drops(grown)
    assert back.table.exceptAll(alone.table).isEmpty() and alone.table.exceptAll(back.table).isEmpty()
    none_left = sum(np.count_nonzero(np.frombuffer(r.slots, np.uint16)) for r in back.filters.collect())
    assert none_left == sum(np.count_nonzero(np.frombuffer(r.slots, np.uint16)) for r in alone.filters.collect())


def test_filters_met_by_shard_pass_the_same_postings(spark, docs, no_docs, monkeypatch):
    """Sent or met shard by shard in small pieces: the same postings pass, a line in every document included."""
    hot = docs.select("doc_id", F.concat_ws(
        "\n", F.lit("A line that all documents share"), F.format_string("Line number %d", F.pmod("doc_id", F.lit(20))), "text").alias("text"))
    monkeypatch.setattr(cuckoo, "KEYS_PER_SHARD", 7)
    index = line_dedup.LineIndex.of(hot)
    assert index.shards > 1
    sent = sorted(map(tuple, index.suspects(index.rows).collect()))
    drops = lambda x: {r.doc_id: set(map(tuple, r["keys"])) for r in x.drops().collect()}
    before = drops(index)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    monkeypatch.setattr(line_dedup, "PIECE", 20)
    assert sorted(map(tuple, index.suspects(index.rows).collect())) == sent
    assert drops(index) == before and len(before) == hot.select("doc_id").distinct().count() - 1 and len(sent) < index.rows.count()
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_line_index_counts_by_differences(spark, docs, no_docs, tmp_path):
    """After additions, removals, repeats of both, saving and loading, all is as in an index made anew."""
    state = lambda x: (sorted(map(tuple, x.table.collect())), sorted((r.doc_id, sorted(map(tuple, r["keys"]))) for r in x.drops().collect()))
    parts = [docs.where(f"pmod(coalesce(doc_id, 0), 3) = {i}") for i in range(3)]
    index = line_dedup.LineIndex.of(parts[0]).add(parts[1]).add(no_docs).add(parts[2])
    assert state(index) == state(line_dedup.LineIndex.of(docs))
    # The smallest documents leave, so that their keys are counted anew; unknown ids and repeats change nothing.
    out = parts[0].select("doc_id").unionAll(parts[0].select("doc_id")).unionAll(spark.range(10**9, 10**9 + 2))
    left = index.remove(out)
    left.save(str(tmp_path / "index"))
    again = line_dedup.LineIndex.load(spark, str(tmp_path / "index"))
    want = state(line_dedup.LineIndex.of(parts[1].unionAll(parts[2])))
    assert state(left) == state(left.compacted()) == state(again) == want
    assert state(again.remove(out)) == want
    assert state(again.add(parts[0])) == state(line_dedup.LineIndex.of(docs))
    empty = line_dedup.LineIndex.of(no_docs)
    empty.save(str(tmp_path / "empty"))
    assert state(line_dedup.LineIndex.load(spark, str(tmp_path / "empty")).add(docs)) == state(line_dedup.LineIndex.of(docs))


def test_cuckoo_filter_full_and_emptied():
    rng = np.random.default_rng(0)
    high, low = rng.integers(-(2**63), 2**63, (2, 70_000))
    f = cuckoo.CuckooFilter()
    f.insert(high[:66_000], low[:66_000])
    assert f.waiting and f.contains(high[:66_000], low[:66_000]).all()
    assert f.contains(*rng.integers(-(2**63), 2**63, (2, 20_000))).mean() < 0.01
    f.delete(high[1000:66_000], low[1000:66_000])
    assert f.contains(high[:1000], low[:1000]).all() and np.count_nonzero(f.slots) + len(f.waiting) == 1000


def test_repeats_are_those_of_all_strings(docs, documents, no_docs, null_id_docs):
    seen, expected = set(), Counter()
    for i, text in sorted(((r[0], r[1] or "") for r in documents), key=lambda x: x[0]):
        data = text.encode()
        covered = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                covered[s : s + 100] = True
            seen.add(data[s : s + 100])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        left = np.frombuffer(data, np.uint8)[~covered].tobytes()
        expected[i, len(data), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    assert Counter(map(tuple, repeats.remove_repeats(docs).collect())) == expected
    assert sum(k[2] for k in expected) > 5000
    assert repeats.remove_repeats(no_docs).collect() == []
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(null_id_docs).collect()) == [(0, 0, 0), (0, 24, 0), (1, 24, 0)]


def test_exact_copies_send_each_context_once_a_task(spark):
    """300 copies of a text: their anchors meet as one context each, not as 300."""
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 123, 3000, dtype=np.uint8)).decode()
    df = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").repartition(2)
    numbered = repeats._numbered(df)
    sent = repeats._all_suffixes(numbered, repeats._texts(numbered, 8), 8, 100).where("kind = 0").agg(F.sum("n")).first()[0]
    one = len(repeats.anchors(np.frombuffer(text.encode(), np.uint8), np.array([3000]))[0])
    assert one > 30 and one <= sent <= 8 * one
    rows = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(df).collect()}
    assert rows == {0: (0, 0)} | {i: (3000, 1) for i in range(1, 300)}


def test_repeats_read_piece_by_piece_are_the_same(docs):
    whole = Counter(map(tuple, repeats.remove_repeats(docs).collect()))
    for size in (300, 5000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(repeats, "FLUSH", size)
            assert Counter(map(tuple, repeats.remove_repeats(docs).collect())) == whole


def test_repeat_groups_hold_all_occurrences(docs, documents):
    texts = {r[0]: (r[1] or "").encode() for r in documents}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(docs).collect():
        groups[r.group].add((texts[r.doc_id][r.start : r.end], r.doc_id, r.start))
    assert len(groups) > 20
    for members in groups.values():
        strings = {m[0] for m in members}
        assert len(strings) == 1 and len(strings.pop()) >= 100
    wide = max(groups.values(), key=lambda m: len({x[1] for x in m}))
    string = next(iter(wide))[0]
    assert {x[1] for x in wide} == {i for i, t in texts.items() if string in t}


def test_long_texts_are_cut_without_a_seam(spark):
    """Segments far shorter than the text give the same strings and anchors as the whole."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 5000, dtype=np.uint8)
    whole = repeats.anchors(text, np.array([5000]))
    strings = {(int(h), int(a), s) for h, a, x, y in zip(*whole) for s in range(x, y + 1)}
    parts = set()
    for at in range(0, 4901, 201):
        part = text[at : at + 300]
        for h, a, x, y in zip(*repeats.anchors(part, np.array([len(part)]))):
            parts |= {(int(h), int(a) + at, s + at) for s in range(x, y + 1)}
    assert parts == strings and len({s for _, _, s in strings}) == 4901


def test_interval_tree_and_maximal_repeats():
    assert sorted(intervals([1, 3, 0, 2, 2])) == [(0, 2, 1), (1, 2, 3), (3, 5, 2)]
    assert list(intervals([])) == [] and list(intervals([0, 0])) == []
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = [(bytes(rng.integers(97, 99, 4).tolist()), bytes(rng.integers(97, 99, 4).tolist())) for _ in range(8)]
        text.sort(key=lambda x: x[1])
        share = lambda a, b: next((i for i in range(4) if a[i] != b[i]), 4)
        lcp = np.array([share(text[i][1], text[i + 1][1]) for i in range(7)])
        by_left = sorted(range(8), key=lambda i: text[i][0][::-1])
        place = np.argsort(by_left)
        left_lcp = np.array([share(text[a][0][::-1], text[b][0][::-1]) for a, b in zip(by_left, by_left[1:])])
        found = {(tuple(m.tolist()), a, b) for m, a, b in maximal_repeats(lcp, place, left_lcp, 4) if b}
        expected = set()
        for l in range(5):
            for r in range(max(1, 4 - l), 5):
                for i in range(8):
                    own = tuple(j for j in range(8) if text[j][0][4 - l :] == text[i][0][4 - l :] and text[j][1][:r] == text[i][1][:r])
                    if len(own) < 2:
                        continue
                    longer_left = l < 4 and len({text[j][0][3 - l] for j in own}) == 1
                    longer_right = r < 4 and len({text[j][1][r] for j in own}) == 1
                    if not longer_left and not longer_right:
                        expected.add((own, l, r))
        assert found == expected


def test_packing_places_every_token_once(docs, documents, no_docs, null_id_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = {r[0]: r[1] or "" for r in documents}
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    rows = packing.packed_documents(docs, keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(Counter), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length]
        by_sequence[r.sequence_id].append((r.offset, r.length))
    times = Counter(r[0] for r in documents)
    for i, own in ids.items():
        marks = [0, *range(len(own) % 1024 or 1024, len(own) + 1, 1024)]
        expected = {(p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *own[a:b]))): times[i] for p, (a, b) in enumerate(zip(marks, marks[1:]))}
        assert by_doc[i] == expected
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 1024) + 1
    assert packing.packed_documents(no_docs).collect() == []
    assert sorted((r.doc_id or 0, r.length) for r in packing.packed_documents(null_id_docs).collect()) == [(0, 1), (0, 8), (1, 8)]


def test_a_text_is_encoded_in_one_call(monkeypatch):
    tokenizer = packing.ByteBpe(packing.default_ranks())
    plain, calls = tokenizer.encoding, []

    class Counting:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(plain, name)

    tokenizer.encoding = Counting()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = [" ".join(f"rare{i}x" for i in range(500)), "a  b\n\n c\td é\u3000 <s>", ""]
    expected = [struct.pack(f"<{len(ids)}I", *ids) for ids in (reference.encode(t, add_special_tokens=False).ids for t in texts)]
    assert [tokenizer.encode(t) for t in texts] == expected
    assert calls == ["encode_ordinary"] * 3
    monkeypatch.setattr(packing, "LONG_TEXT", 0)
    assert [tokenizer.encode(t) for t in texts] == expected


@pytest.mark.parametrize("seed", range(6))
def test_plan_of_a_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.choice([rng.integers(1, 1025, 4000), rng.geometric(0.004, 4000), np.full(4000, 513)][seed % 3], 4000), 1, 1024)
    histogram = Counter(lengths.tolist())
    p = packing.plan(dict(histogram))
    assert Counter({k: int(v) for k, v in p.groupby("length")["items"].sum().items()}) == histogram
    used = defaultdict(list)
    for length, rank, sequence, offset, items in p.itertuples(index=False):
        for i in range(items):
            used[sequence + i].append((offset, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    assert len(used) <= 1.02 * bound + 2
    for length, own in p.groupby("length"):
        assert own["rank"].tolist() == (own["items"].cumsum() - own["items"]).tolist()


def test_mix_reaches_its_targets(docs, documents, no_docs, null_id_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(documents)
    texts = {r[0]: r for r in documents}
    sizes = {i: len((r[1] or "").encode().split()) for i, r in texts.items()}
    sources = sorted({r[3] for r in documents if r[3] is not None}) + [None]
    total = {s: sum(sizes[r[0]] for r in documents if r[3] == s) for s in sources}
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(sources)}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3.0 * total[s] if s in capped else rest * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in rows:
        s = texts[r.doc_id][3]
        assert r.size == sizes[r.doc_id] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken in (r.size * r.copies, 0) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sources:
        gap, whole = target[s] - taken[s], int(target[s] / total[s]) if total[s] else 0
        assert gap >= -1e-6
        # what is left open is little, or nothing that was not drawn would fit into it
        assert gap <= max(5, 0.02 * target[s]) or not any(r.copies == whole and 0 < r.size <= gap for r in rows if texts[r.doc_id][3] == s)
    assert sum(taken.values()) > 0.5 * sum(target.values())
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(no_docs).collect() == [] and mixing.mix(null_id_docs).count() == 3
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert Counter(r.doc_id for r in copies.collect()) == Counter({i: n for i, n in Counter(r.doc_id for r in rows for _ in range(max(x.copies for x in rows if x.doc_id == r.doc_id))).items()})


def all_segmentations(lattice, text):
    """Probability of a text, summed over every way to cut it."""
    if not text:
        return 1.0
    total = sum(np.exp(lattice.log[text[:i]]) * all_segmentations(lattice, text[i:]) for i in range(1, len(text) + 1) if text[:i] in lattice.log)
    if text[0] not in lattice.log:
        total += np.exp(sum(lattice.byte[b] for b in text[0].encode())) * all_segmentations(lattice, text[1:])
    return total


def test_scores(docs, documents, no_docs, null_id_docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {r[0]: (r[1] or "").encode().lower().split() for r in documents}
    training = [r[0] for r in documents if not held(r[0])]
    c = Counter(w for i in training for w in words[i])
    n, v = sum(c.values()) + len(training), len(c) + 1
    few = subword_lm.score(docs, frequent=20).collect()
    many = {r.doc_id: r for r in subword_lm.score(docs).collect()}
    # the lattice of the training words, and each word's probability in it
    path = subword_lm.default_vocabulary()
    sp = subword_lm._processor(path)
    counts = np.zeros(sp.get_piece_size())
    for w, k in c.items():
        for piece in sp.encode(w.decode()):
            counts[piece] += k
    lattice = subword_lm.PieceLattice(path, counts)
    own_log = {w: lattice.word(w) / np.log(10) for w in {x for o in words.values() for x in o}}
    end = (len(training) + 1) / (n + 2)
    for r in few:
        own = words[r.doc_id]
        base = sum(log10((c[w] + 1) / (n + v + 1)) for w in own) + log10((len(training) + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(own) + 1, n)
        assert r.n_known == sum(c[w] > 0 for w in own) + 1
        assert r.base_score == pytest.approx(base) and r.base_score == pytest.approx(many[r.doc_id].base_score)
        assert r.score == pytest.approx(sum(own_log[w] for w in own) + len(own) * log10(1 - end) + log10(end))
        assert r.score == pytest.approx(many[r.doc_id].score) and r.word_score == pytest.approx(many[r.doc_id].word_score)
        assert r.word_score < 0 and r.score < 0
    assert subword_lm.score(no_docs).collect() == [] and subword_lm.score(null_id_docs).count() == 3
    alone = subword_lm.score(docs.where("doc_id = 4" if held(4) else f"doc_id = {next(i for i in words if held(i))}")).collect()
    assert [(r.train_tokens, r.base_score, r.n_known) for r in alone] == [(0, 0.0, 0)]


def test_long_unknown_words_keep_their_logarithm(spark):
    rows = [(i, "some words to learn from") for i in range(30)] + [(100 + i, "q" * (60 * 10**i) + "\u4e16" * i) for i in range(4)]
    path = subword_lm.default_vocabulary()
    scores = {r.doc_id: r.score for r in subword_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), modulus=1, held_out=9).collect()}
    assert scores[102] < -500 and scores[103] < 5 * scores[102] and all(np.isfinite(x) for x in scores.values())
    unknown = [(i, "some words to learn from") for i in range(30)] + [(i, "q" * 6000) for i in range(100, 140)]
    found = {(r.held_out, round(r.score, 6)) for r in subword_lm.score(spark.createDataFrame(unknown, "doc_id long, text string")).where("doc_id >= 100").collect()}
    assert len(found) == 2 and all(s < -100 for _, s in found)
    assert subword_lm.PieceLattice(path, np.zeros(len(subword_lm._pieces(path)[0]))).word(b"q" * 6000) < -1000


def test_lattice_sums_all_segmentations():
    path = subword_lm.default_vocabulary()
    counts = np.zeros(len(subword_lm._pieces(path)[0]))
    for n in (0.0, 50.0):
        counts[300:400] = n
        lattice = subword_lm.PieceLattice(path, counts)
        for word in ("a", "nation", "états", "日本x", "\U0001f600b"):
            assert np.exp(lattice.word(word.encode())) == pytest.approx(all_segmentations(lattice, "▁" + word))
        assert sum(map(np.exp, lattice.log.values())) + sum(map(np.exp, lattice.byte)) == pytest.approx(1)


def plain_posteriors(rows, labels):
    """Classifier, host, path and document posteriors by loops over (doc_id, text, host, path) and (doc_id, quality)."""
    texts = {i: t for i, t, _, _ in rows}
    known = [(quality.statistics(texts[i]), float(y)) for i, y in labels if i in texts and y is not None]
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    cuts = [np.quantile(x[:, j], [b / quality.BINS for b in range(1, quality.BINS)]) for j in range(x.shape[1])]

    def features(values):
        z = np.zeros(len(cuts) * quality.BINS + 1)
        for j, v in enumerate(values):
            z[j * quality.BINS + sum(v >= c for c in cuts[j])] = 1
        z[-1] = 1
        return z

    z = np.array([features(v) for v in x])
    ridge = np.array([quality.RIDGE] * (z.shape[1] - 1) + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve(z.T @ np.diag(p * (1 - p)) @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
    odds = math.log(y.mean() / (1 - y.mean()))
    evidence = [min(max(float(features(quality.statistics(t)) @ w) - odds, -30), 30) for _, t, _, _ in rows]
    chance = [1 / (1 + math.exp(-(e + odds))) for e in evidence]

    def strength(groups):
        """From (good, n, prior rate): how far the rates lie apart beyond what chance explains."""
        between = sum(n * (g / n - r) ** 2 for g, n, r in groups)
        by_chance, whole = sum(r * (1 - r) for _, _, r in groups), sum(n * r * (1 - r) for _, n, r in groups)
        share = (between - by_chance) / max(whole - by_chance, 1e-9)
        return min(max(1 / max(share, 1e-6) - 1, 1.0), 1e6)

    hosts, paths = {}, {}
    for (_, _, host, path), p in zip(rows, chance):
        hosts.setdefault(host, []).append(p)
        paths.setdefault((host, path), []).append(p)
    rate = sum(chance) / len(chance)
    k = strength([(sum(v), len(v), rate) for v in hosts.values()])
    host_rate = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in hosts.items()}
    m = strength([(sum(v), len(v), host_rate[h]) for (h, _), v in paths.items()])
    out = {}
    for (i, _, host, path), e, p in zip(rows, evidence, chance):
        own = paths[host, path]
        prior = (sum(own) - p + m * host_rate[host]) / (len(own) - 1 + m)
        out[i] = (e, host_rate[host], prior, 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior))))))
    return out


def test_quality_like_the_plain_posteriors(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        host, path = rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["x", "y", None])
        good = rng.random() < {"a": 0.9, "b": 0.3}.get(host, 0.6)
        words = [rng.choice("the quick brown fox jumps over a lazy dog".split()) for _ in range(rng.randint(3, 40))]
        text = " ".join(words) + "." if good or rng.random() < 0.2 else " ".join(["BUY!!", "$$$", *words[:2]] * rng.randint(2, 6))
        rows.append((i, text if i % 37 else "", host, path))
        if i % 2:
            labels.append((i, int(good)))
    labels += [(1, 1), (10**6, 0), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = plain_posteriors(rows, labels)
    assert len(out) == len(rows) and {r.kept for r in out} == {True, False}
    for r in out:
        assert (r.evidence, r.host_rate, r.path_rate, r.quality) == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-8)
        assert abs(r.quality - 0.5) < 1e-9 or r.kept == (r.quality > 0.5)


def test_quality_separates_and_shrinks(spark, no_docs):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(900):
        good = rng.random() < (0.9 if i % 3 else 0.3)
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(30)]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 6)
        rows.append((i, None if i == 7 else text, ["a", "b"][i % 2], "spam" if i % 3 == 0 else None if i % 3 == 1 else "news", 0))
        if i % 2:
            marks.append((i, int(good), 0))
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, evidence int")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (1, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(extra, labels).collect()}
    good = {i: t is not None and "!!" not in t for i, t, *_ in rows}
    assert sum(out[i].kept == good[i] for i in out if i != 7) >= 895
    rates = {r.host: r.host_rate for r in out.values()}
    assert rates["spam"] < 0.45 < 0.8 < min(rates["news"], rates[None])
    few = extra.where("doc_id < 600").unionByName(extra.where("doc_id = 600").withColumn("source", F.lit("tiny")))
    tiny = next(r for r in quality.classify(few, labels).collect() if r.host == "tiny")
    assert 0.5 < tiny.host_rate < 0.9 and quality.classify(no_docs, labels).collect() == []
    unknown = quality.classify(extra, labels.limit(0)).collect()
    assert all(r.kept and r.evidence == 0 for r in unknown)
    kept = quality.good_documents(extra, labels)
    assert kept.columns == extra.columns and kept.count() == sum(r.kept for r in out.values())


def test_mix_includes_documents_by_their_odds(spark):
    """Realised rates of inclusion over many documents of a few sizes are p = min(1, c * size) of the rest of the target."""
    sizes = [4, 10, 25, 60, 4000]
    rows = [(i, "w " * (sizes[i % 4] if i else 4000), ["a", "b"][i % 9 == 0]) for i in range(18_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, weights=(5, 2)).toPandas()
    drawn = 0
    for _, own in out.assign(source=["b" if i % 9 == 0 else "a" for i in out["doc_id"]]).groupby("source"):
        s, target = own["size"].to_numpy(float), own["target"].iloc[0]
        whole = int(target / s.sum())
        rest = target - whole * s.sum()
        if rest <= 0:
            continue
        certain = np.zeros(len(s), bool)
        while True:
            c = (rest - s[certain].sum()) / (s[~certain] ** 2).sum()
            more = ~certain & (c * s >= 1)
            if not more.any():
                break
            certain |= more
        extra = own["copies"].to_numpy() - whole
        assert set(extra) <= {0, 1} and extra[certain].all() and abs((extra * s).sum() - rest) < 60
        for size in sizes[:4]:
            at = (s == size) & ~certain
            if not at.any():
                continue
            p = c * size
            assert abs(extra[at].mean() - p) < 4 * np.sqrt(p * (1 - p) / at.sum()) + 0.01
            drawn += at.sum() > 100 and 0.02 < p < 0.98
    assert drawn >= 4

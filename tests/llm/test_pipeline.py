"""The corpus pipeline next to the plain versions of its stages, chained."""

import struct
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from test_texts import plain_lines, roots, shingles  # noqa: E402

import corpus_pipeline  # noqa: E402
from tabloom.llm import mixing, quality  # noqa: E402


def folder(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_is_the_chain_of_plain_stages(spark, tmp_path, docs, documents):
    bad = {r[0] for r in documents if r[1] is not None and (not r[1].split() or len(set(r[1].split())) < 3)}
    labels = [(r[0], int(r[0] not in bad), 0) for r in documents if r[0] % 3]
    distinct = docs.dropDuplicates(["doc_id"])
    sf_dir = folder(spark, tmp_path, distinct, labels)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdicts = {r.doc_id: r.kept for r in quality.classify(table, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    good = [r for r in {r[0]: r for r in documents}.values() if verdicts[r[0]]]
    assert 40 < len(good) < len(verdicts)
    lines = plain_lines(good)
    texts = {r[0]: None if r[1] is None else "\n".join(lines[r[0]][1]) for r in good}
    assert texts != {r[0]: r[1] for r in good}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = roots(sets, links)
    alone = {i: t for i, t in texts.items() if component[i] == i}
    assert len(alone) < len(texts)

    # each stage on what the one before it kept
    kept = table
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:3], (verdicts, texts, alone), strict=True):
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == table.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in ids if ids is not verdicts or verdicts[i]}
    assert {r.doc_id: r.text for r in kept.collect()} == alone
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect() if r.copies}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for i, n in copies.items():
        ids = tokenizer.encode(alone[i] or "", add_special_tokens=False).ids + [2]
        marks = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(marks, marks[1:])):
            expected[i, piece, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += n
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024


@pytest.mark.parametrize("kind", ["empty", "null ids", "no labels"])
def test_run_on_odd_tables(spark, tmp_path, docs, no_docs, null_id_docs, kind):
    table = {"empty": no_docs, "null ids": null_id_docs, "no labels": docs.limit(30)}[kind]
    rows = corpus_pipeline.run(spark, folder(spark, tmp_path, table, [(1, 1, 0)] if kind == "empty" else [])).collect()
    assert (rows == []) == (kind == "empty") and all(r.offset + r.length <= 1024 for r in rows)

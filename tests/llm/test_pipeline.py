"""The pipeline against plain forms of its five stages, and the queries that have SQL against DuckDB."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from check_sql import connect, differences
from helpers import documents, prose, words_of
from test_decontaminate import edited, plain as plain_matches
from test_mixing import water_levels
from test_neardup import changed, plain as plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from spanlake.llm import decontaminate, queries, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
assert queries
NO_LANGUAGE = [None, "", "12 34, 56!", " \n\t ", "...", "+++ 7 ---"]


def noise(seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("qwxzjvkfp") for _ in range(12)) for _ in range(60))


def fixture():
    """(rows, noise ids, items): every kind of row that some stage decides on."""
    sources = ["b", "a", None, "é"]
    items = [(k, prose(900 + k, 14)) for k in range(4)] + [(9, None)]
    rows = [(k, prose(k, 20 + k % 50), "en", sources[k % 4 if k % 3 else 0]) for k in range(70)]
    rows += [(100 + k, changed(prose(1, 150), k, 0.01 * (k % 5)), "en", "a") for k in range(12)]
    rows += [(120 + k, prose(5, 25), None, sources[k % 4]) for k in range(6)]
    rows += [(140 + k, f"{prose(50 + k, 30)} {edited(decontaminate.normal(items[k % 4][1]), k, k % 3)} {prose(80 + k, 9)}",
              "en", "b") for k in range(9)]
    rows += [(200 + k, text, "en", "b") for k, text in enumerate(NO_LANGUAGE)]
    rows += [(220 + k, noise(k), None, "a") for k in range(4)] + [(None, prose(333, 40), "en", "a"), (250, prose(77, 15_000), "en", "long")]
    return rows, {220 + k for k in range(4)}, items


def expected(rows, noisy, items):
    kept = [r for r in rows if r[0] not in noisy and any(map(str.isalpha, r[1] or ""))]
    first = {d for d, _, _, keep in plain_groups([r[:2] for r in kept], 5, 80) if keep}
    kept = [r for r in kept if r[0] is None or r[0] in first]
    held = {d for d, _, _ in plain_matches([r[:2] for r in kept], items)}
    kept = [r for r in kept if r[0] not in held]
    sizes = {}
    for _, text, _, source in kept:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    targets = water_levels(sizes)
    out = []
    for doc_id, text, _, source in kept:
        name = "mix:" + ("" if doc_id is None else str(doc_id))
        u = int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / 2 ** 48
        rate = targets[source] / sizes[source]
        ids = TOKENS.encode(text, add_special_tokens=False).ids + [2]
        out += [(-1 if doc_id is None else doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] \
            * (int(rate) + (u < rate - int(rate)))
    return sorted(out)


def write(spark, folder, rows, items):
    documents(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_as_plain_stages(spark, tmp_path):
    rows, noisy, items = fixture()
    got = corpus_pipeline.run(spark, write(spark, tmp_path, rows, items)).collect()
    want = expected(rows, noisy, items)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ids = {w[0] for w in want}
    assert 1 in ids and not ids & {200, 220, 140, 101} and len(want) > len(ids) > 50
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_keep_the_columns(spark, tmp_path):
    rows, _, items = fixture()
    folder = write(spark, tmp_path, rows[:90], items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_pipeline_without_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], fixture()[2])).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    ours = registry.QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(ours, connect(SF_DIR).execute(registry.ORACLES[name]).df()) is None

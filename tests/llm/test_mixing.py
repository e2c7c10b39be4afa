import duckdb
from check_sql import differences
from helpers import documents, prose, words_of

from spanlake.llm import mixing


def some_docs(spark):
    rows = [(k, prose(k, 5 + k % 40), "en", ["b", "a", "é", None, "Z"][k % 5 if k % 3 else 0]) for k in range(400)]
    rows += [(None, None, None, "empty"), (7, "", None, "empty"), (7, "again and again", "en", "a"),
             (7, "again and again", "en", "a"), (900, " \t ", "en", "b"), (901, prose(3, 20_000), "en", "long")]
    return documents(spark, rows)


def water_levels(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        level = left / rest if rest else 0.0
        over = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_targets_and_copies(spark):
    docs = some_docs(spark)
    got = mixing.mix_table(docs).toPandas()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words_of(r.text))
    want = water_levels(sizes)
    rows = docs.count()
    assert len(got) == rows and (got.taken <= 2 * got["size"]).all()
    targets = sorted(set(got.target))
    assert all(min(abs(t - w) for w in want.values()) < 1e-6 * max(1, t) for t in targets)
    again = mixing.mix_table(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken", "target"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_same_as_sql(spark, tmp_path):
    docs = some_docs(spark)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    ours, theirs = mixing.mix_table(docs).toPandas(), con.execute(mixing.MIX_SQL).df()
    assert differences(ours, theirs) is None


def test_mix_gives_the_copies(spark):
    docs = some_docs(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = mixing.mix_table(docs).where("size > 0").selectExpr("sum(taken) AS n").first().n
    assert sum(len(words_of(r.text)) for r in mixed.collect()) == taken


def test_empty(spark):
    assert mixing.mix_table(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0


def test_columns_of_any_name(spark):
    """Columns that are called like inner ones come through with what they hold."""
    rows = [(k, "some words in a text", "a", "b" * (k % 3), "size", "src", 1.5, "rate", "row", 7, "copy", "w.x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _size string, source string, size string, source_size string, "
                                 "target double, rate string, row string, _copies int, copy string, `weight.x` string")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows) and mixed.count() > 30
    assert mixing.mix_table(docs).count() == 40

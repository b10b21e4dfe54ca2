"""The pipeline's stages, one by one and as a whole."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from lodestone.llm import packing  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def passed_on(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {"documents": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        got = passed_on(spark, stage(spark, docs, SF), tmp_path, name)
        if name != "packing":
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
            docs = got
        counts[name] = got.count()
    assert counts["documents"] >= counts["toxicity"] > counts["minhash_dedup"] == counts["substring_dedup"]
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.collect()))
    assert whole.columns == packing.pack(docs).columns


def test_mixing_repeats_rows(spark):
    rows = [(i, f"text number {i}", "en", "a" if i < 40 else "b", 10) for i in range(80)] + [(None, "no id", None, None, None), (500, None, None, "a", None)]
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), SF)
    times = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert times[None] == 1 and times[500] == 1 and set(times.values()) <= {1, 2} and 90 <= sum(times.values()) <= 140


def test_cut_repeats_keeps_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"before {passage} after\nit", "en", "a", 5), (2, f"other {passage}", "en", "a", 5), (3, "clean  text\nstays", "en", "a", 5), (4, None, None, None, None)]
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert got[1]["text"] == "before after it" and got[1]["n_chars"] == 15 and got[2]["text"] == "other"
    assert got[3]["text"] == "clean  text\nstays" and got[3]["n_chars"] == 5 and got[4]["text"] is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], DOCS), SF).count() == 0


CLASHING = "kept_text string, n_words long, n_removed int, kept_sha256 string, _copies int, _k string, _toxicity string, copies double, size string, score int, k int, nth int, `dotted.name` int, shard string, begins array<int>"


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that stages use inside."""
    long = " ".join(f"w{i % 4999}x{i % 7}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long), (5, long), (None, "no id here at all"), (None, None), (6, "x" * 200_000), (7, "tie"), (7, "tie of another text"), (8, "Ünï cödé 漢字 \U0001f600")]
    extra = ("a", 5, 6, "b", 7, "c", "d", 0.5, "e", 8, 9, 10, 11, "f", [1])
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 4 else "s", None if t is None else len(t), *extra) for i, t in rows], f"{DOCS}, {CLASHING}")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_odd_rows(spark, name):
    docs = odd(spark)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    extra = docs.columns[5:]
    first = docs.first()
    assert all(r[c] == first[c] for r in rows for c in extra)
    whole = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()), key=repr)
    left = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in rows), key=repr)
    if name == "toxicity":  # the labelled ids of the small tables are others' texts here: nothing is held but that no blank text goes
        assert {1, 2, 3} <= {i for i, _, _ in left} and (None, None, None) in left
    elif name == "minhash_dedup":
        assert len(left) == len(whole) - 1 and left.count(whole[[i for i, _, _ in whole].index(5)]) == 1
    elif name == "substring_dedup":
        assert len(left) == len(whole) and [r["text"] for r in rows if r["doc_id"] == 5] == ["", ""] and {r["n_chars"] for r in rows if r["doc_id"] == 5} == {0}
        assert [x for x in left if x[0] != 5] == [x for x in whole if x[0] != 5]
    else:
        count = {i: sum(x[0] == i for x in left) for i in {x[0] for x in whole}}
        assert count[1] == count[2] == count[3] == 1 and count[None] == 2 and all(x in whole for x in left) and max(count.values()) <= 4


def test_packing_of_odd_rows(spark):
    docs = odd(spark)
    got = corpus_pipeline.pack(spark, docs, SF)
    assert got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("whole")).where("n <> whole").isEmpty()
    assert got.where("start = 0").count() == docs.count()


def test_run_leaves_one_table(spark):
    import os

    from lodestone.sources.shared import run_dir

    folder = run_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, SF).count()
    new = sorted(n.rpartition("-")[0] for n in set(os.listdir(folder)) - before)
    assert [n for n in new if n.startswith("pipeline-")] == ["pipeline-mixing"]


def test_stages_hold_little(spark, tmp_path, monkeypatch):
    """Beside what other stages left: small Arrow batches and few remembered parts, with the same rows; the session's own bound holds again after."""
    from lodestone.llm import common, neardup, substring

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    want = {name: sorted(map(tuple, dict(corpus_pipeline.STAGES)[name].__wrapped__(spark, docs, SF).collect()), key=repr) for name in ("minhash_dedup", "substring_dedup")}
    want["packing"] = sorted(map(tuple, packing.pack(docs).collect()), key=repr)
    monkeypatch.setattr(corpus_pipeline, "BATCH_BYTES", 9_000)
    bounds, parts = [], []
    for module in (packing, neardup, substring):
        monkeypatch.setattr(module, "materialize", lambda df, tag, write=module.materialize: (bounds.append(spark.conf.get(common.BATCH_BYTES)), write(df, tag))[1])
    monkeypatch.setattr(packing, "tokenized_pieces", lambda *args, f=packing.tokenized_pieces: (parts.append(args[-1]), f(*args))[1])
    own = spark.conf.get(common.BATCH_BYTES)
    for name, rows in want.items():
        assert sorted(map(tuple, dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect()), key=repr) == rows
        assert spark.conf.get(common.BATCH_BYTES) == own
    assert set(bounds) == {"9000"} and parts == [corpus_pipeline.KEPT_PARTS] and 2 * parts[0] <= packing.KEPT_PARTS


def test_smaller_bounds_of_batches_stay(spark):
    from lodestone.llm.common import BATCH_BYTES, light_batches

    spark.conf.set(BATCH_BYTES, "1k")
    try:
        with light_batches(spark, 5000):
            assert spark.conf.get(BATCH_BYTES) == "1k"
        spark.conf.set(BATCH_BYTES, "1m")
        with pytest.raises(ZeroDivisionError), light_batches(spark, 5000):
            assert spark.conf.get(BATCH_BYTES) == "5000" and 1 / 0
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_a_worker_remembers_what_the_last_query_allows():
    from lodestone.llm import tokens

    path = tokens.default_path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(100)]
    many = tokens.encoder(path, True, 10_000)
    want = many.batch(texts)
    assert len(many.known) >= 4000
    few = tokens.encoder(path, True, 100)
    got = [ids for k in range(0, 100, 5) for ids in few.batch(texts[k : k + 5])]
    assert got == want and len(few.known) <= 100 + 250
    tokens._ENCODERS.clear()

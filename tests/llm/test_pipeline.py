import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from flowvigil.llm import contamination, private, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_plain_versions(spark, small):
    docs = queries.table(spark, small, "documents").filter("length(text) < 6000").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "private_data", "byte_bpe"]

    good = stages["quality_rules"](spark, docs, small)
    judged = quality.verdicts(docs, queries.table(spark, small, "labels"), lambda df: df)
    assert ids(good) == ids(judged.filter("kept")) and good.columns == docs.columns
    failed = {i for i, t in texts.items() if (s := brute.statistics(t))[0] < 50 or 100 * s[4] > 50 * s[0]}
    assert not failed & set(ids(good))

    one = stages["near_dedup"](spark, docs, small)
    assert ids(one) == sorted(i for i, _, _, kept in brute.near(list(texts.items()), 5, 80) if kept)

    clean = stages["decontamination"](spark, docs, small)
    items = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    gone = {d for d, *_ in brute.contained(texts.items(), items)}
    assert gone and ids(clean) == sorted(set(texts) - gone)

    masked = {r.doc_id: (r.text, r.n_chars) for r in stages["private_data"](spark, docs, small).collect()}
    assert masked == {i: (m := private.mask_text(t), len(m)) for i, t in texts.items()}
    assert all(not brute.private(t) for t, _ in masked.values())

    enc = corpus_pipeline.bpe.encoding(*queries.tokenizer())
    for r in stages["byte_bpe"](spark, docs, small).limit(40).collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (None, "x " * 80, "en", "s", 1), (1, "", "en", "s", 0), (1, "one two", None, None, None)]])
def test_stages_on_awkward_rows(spark, small, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() <= len(rows)
        assert name == "byte_bpe" or out.columns == docs.columns


def test_stages_with_clashing_names(spark, small):
    rows = [(1, "word " * 3), (None, None), (3, " ".join(f"w{i} is good." for i in range(40))), (4, " ".join(f"w{i} is good." for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_gone", "gone", "docs", "kept", "v", "h", "c", "n", "a.b", "spans", "item_id", "component_id", "bucket"):
        docs = docs.withColumn(name, F.lit(name))
    plain = docs.select("doc_id", "text")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert name == "byte_bpe" or out.columns == docs.columns
        columns = ["doc_id", "ids" if name == "byte_bpe" else "text"]
        assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, stage(spark, plain.withColumn("n_chars", F.lit(0)), small).select(columns).collect()))


def test_whole_pipeline(spark, small):
    out = queries.pipeline(spark, small)
    assert 0 < out.count() < 200 and out.filter(F.size("ids") != F.col("n_tokens")).isEmpty()


def rows_left(out):
    return sorted(((r.doc_id, r.text, r.lang) for r in out.select("doc_id", "text", "lang").collect()), key=str)


def test_rows_that_share_an_id_are_judged_apart(spark, small):
    good = [r.text for r in queries.table(spark, small, "documents").limit(60).collect()]
    docs = [(None, t, "a", "s", 1) for t in good] + [(7, t, "b", "s", 1) for t in good] + [(None, "junk", "c", "s", 1), (7, "junk", "d", "s", 1)]
    frame = spark.createDataFrame(docs, SCHEMA)
    labels = queries.table(spark, small, "labels")
    left = rows_left(corpus_pipeline.keep_good(spark, frame, small))
    plain = spark.createDataFrame([(-i - 1, *d[1:]) for i, d in enumerate(docs)], SCHEMA)
    passed = {r.doc_id for r in quality.judge(quality.statistics(plain), quality.fit_on(quality.statistics(frame), labels)).filter("kept").collect()}
    assert left == sorted(((d[0], d[1], d[2]) for i, d in enumerate(docs) if -i - 1 in passed), key=str)
    assert 0 < len(left) < len(docs)

    item = queries.table(spark, small, "benchmark").filter("text is not null").first().text
    leaked = spark.createDataFrame([(None, f"x {item} y", "a", "s", 1), (None, "clean", "b", "s", 1), (3, item, "c", "s", 1), (3, "clean too", "d", "s", 1)], SCHEMA)
    assert rows_left(corpus_pipeline.keep_uncontaminated(spark, leaked, small)) == [(3, "clean too", "d"), (None, "clean", "b")]


def test_one_copy_of_rows_that_share_an_id_stays(spark, small):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(5, one, "a", "s", 1), (5, one, "a", "s", 1), (None, one + " more", "b", "s", 1), (None, two, "c", "s", 1), (None, two, "c", "s", 1),
            (None, three, "d", "s", 1), (5, "other words under the same id", "e", "s", 1), (9, three, "f", "s", 1), (2, three + " end", "g", "s", 1),
            (None, None, "h", "s", 1), (None, "", "i", "s", 1)]
    out = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), small)
    want = [(5, one, "a"), (None, two, "c"), (5, "other words under the same id", "e"), (2, three + " end", "g"), (None, None, "h"), (None, "", "i")]
    assert rows_left(out) == sorted(want, key=str) and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_items_in_several_blocks(spark, small):
    docs = queries.table(spark, small, "documents").filter("length(text) < 6000").cache()
    items = queries.table(spark, small, "benchmark")
    gone = {r.doc_id for r in contamination.contained(docs, items).collect()}
    left = contamination.without_items(docs, items, corpus_pipeline.materialise, block_bytes=8 * sum(len(r.text.split()) for r in items.collect()) // 3)
    assert gone and ids(left) == sorted({r.doc_id for r in docs.collect()} - gone)


def test_short_items_inside_longer_documents(spark):
    items = spark.createDataFrame([(1, "Red fox"), (2, "one"), (3, "a b c d"), (4, " "), (5, None)], "item_id long, text string")
    texts = {1: "the quick red FOX jumps over it", 2: "red", 3: "fox red fo x", 4: "x a b c d", 5: "a b c x d e f", 6: "One", 7: "ones and none but two three", 8: "this is the one we want here",
             9: "", 10: None, 11: "ends in red", 12: "fox starts it"}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA).coalesce(1)
    assert ids(contamination.without_items(docs, items, lambda df: df)) == [2, 3, 5, 7, 9, 10, 11, 12]
    assert ids(contamination.without_items(docs.filter("doc_id in (2, 9, 10)"), items, lambda df: df)) == [2, 9, 10]

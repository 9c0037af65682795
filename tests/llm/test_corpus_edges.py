"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import html, langid, licenses, mixing, passages, pieces, quality, simhash, topk, warc

WORDS = " ".join(f"w{i}" for i in range(80))
LONG = " ".join(f"v{i % 997}" for i in range(40_000))
#: Names that operators use inside.
CLASHES = ["row", "key", "uid", "k", "u", "t", "node", "words", "windows", "gone", "kept", "cuts", "fp", "copy_no", "a", "b", "spans", "lh", "label"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, WORDS, "en", "s1", 5), (1, WORDS, "en", "s1", 5), (None, WORDS, None, None, None), (2, None, None, None, None), (3, "", "en", "s1", 0),
        (4, "   \n\t ", "fr", "s2", 6), (5, LONG, "en", "s2", 1), (6, "één woord é ñ ü x ß ▁", "fr", "s1", 3), (1, "other text of the same id", "en", "s1", 1),
        (7, "!!! ### $$$", "en", None, 4), (8, "x" * 5000, "en", "s1", 4), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


OPERATORS = {
    "quality": lambda d: quality.judged(d, keep=["doc_id"]),
    "cleaned": lambda d: quality.cleaned(d),
    "simhash": lambda d: simhash.grouped(d),
    "near copies": lambda d: simhash.deduplicated(d),
    "passages": lambda d: passages.classed(d),
    "removed": lambda d: passages.removed(d),
    "mixing": lambda d: mixing.mix(d),
    "pieces": lambda d: pieces.encoded(d, keep=["doc_id"]),
    "licenses": lambda d: licenses.scanned(d),
    "langid": lambda d: langid.identified(d, F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))),
}
ONE_EACH = {"quality", "simhash", "passages", "pieces", "licenses", "langid"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd)
    n = len(got.collect())
    assert n == odd.count() if name in ONE_EACH else n <= 2 * odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.filter("false")).collect() == []


def test_clashing_columns_are_kept(odd):
    for name in ("cleaned", "near copies", "removed"):
        got = OPERATORS[name](odd)
        assert got.columns == odd.columns
        assert {r.uid for r in got.collect()} <= {"extra uid"}
    mixed = mixing.mix(odd)
    assert set(odd.columns) <= set(mixed.columns) and {r.row for r in mixed.collect()} <= {"extra row"}


def test_stages(odd, spark):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == odd.columns, name
        assert stage(spark, docs.filter("false"), "").collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").filter("doc_id = 2").first().n_tokens == 0


def test_pages(spark):
    rows = [(1, "http://a/x", "<p>Hi</p>"), (1, "http://a/x", "<p>Hi</p>"), (2, None, None), (None, "http://a/y", "<p>Hi</p>"), (3, "bad url\n", ""), (4, "http://a/z", "<article><p>" + LONG + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("host", F.lit("x"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extracted(pages).collect())
    assert got == sorted([(1, "Hi", 2), (1, "Hi", 2), (2, "", 0), (0, "Hi", 2), (3, "", 0), (4, LONG, len(LONG))])
    assert html.extracted(pages.filter("false")).collect() == []
    back = warc.read(warc.write(pages)).collect()
    assert len(back) == 6 and warc.read(warc.write(pages.filter("false"))).collect() == []
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in back)
    assert kinds == [(0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "revisit", 3), (3, "response", 0), (4, "response", 0)]


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = topk.search(v, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 1, 0)]
    assert topk.search(v.filter("false"), F.col("vec_id") % 20 == 0).collect() == []


def by(rows, *columns):
    return sorted(((tuple(r[c] for c in columns)) for r in rows), key=repr)


def test_values_of_odd_rows(odd):
    """What nulls, empty texts, ties and repeated rows come to, operator by operator."""
    judged = quality.judged(odd, keep=["doc_id"]).select("row.doc_id", "n_words", "base_failed", "kept").collect()
    assert by([r for r in judged if r.kept], "doc_id", "n_words") == [(1, 80), (1, 80), (None, 80)]
    assert all(r.n_words == 0 and r.base_failed for r in judged if r.doc_id in (2, 3, 4))
    assert by(quality.cleaned(odd).collect(), "doc_id", "text") == [(1, WORDS), (1, WORDS), (None, WORDS)]

    groups = simhash.grouped(odd).collect()
    assert {r.component_id for r in groups if r.fp == 0} == {2} and sum(r.fp == 0 for r in groups) == 4
    assert len({r.fp for r in groups if r.key == 1}) == 2

    assert by(simhash.deduplicated(odd).collect(), "doc_id", "text") == by(odd.filter("doc_id in (2, 5, 6, 7, 8)").collect() + odd.filter("doc_id = 1").dropDuplicates(["text"]).collect(), "doc_id", "text")

    classes = passages.classed(odd).collect()
    assert by([r for r in classes if r.n_spans], "doc_id", "class_id", "dup_words") == [(1, 1, 80), (1, 1, 80), (None, 1, 80)]
    assert all(r.class_id == r.doc_id for r in classes if not r.n_spans)

    left = passages.removed(odd).collect()
    assert by([r for r in left if r.text != WORDS], "doc_id", "text") == by(odd.filter("text is null or text not like 'w0 w1 %'").collect(), "doc_id", "text")
    assert sum(r.text == WORDS for r in left) == 1 and {r.doc_id for r in left if r.text == WORDS} == {1} and len(left) == odd.count() - 2

    made = pieces.encoded(odd, keep=["doc_id"]).collect()
    assert {r.row.doc_id for r in made if r.n_tokens == 0} == {2, 3, None} and {r.row.doc_id for r in made if not r.round_trip} == {6}
    back = pieces.decoded(pieces.encoded(odd, keep=["doc_id"]).select("row.doc_id", "token_ids").withColumn("row", F.lit(1))).collect()
    assert by([r for r in back if r.doc_id in (2, 3, 5, 7)], "doc_id", "text") == [(2, ""), (3, ""), (5, LONG), (7, "!!! ### $$$")]

    found = licenses.scanned(odd).collect()
    assert {(r.doc_id, r.n_words) for r in found if r.n_words == 0} == {(2, 0), (3, 0), (4, 0), (7, 0), (None, 0)} and all(r.labels == "" and r.score == 0 for r in found)

    named = langid.identified(odd, F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))).collect()
    assert {r.doc_id for r in named if r.lang_pred == "und"} == {2, 3, 4, 7, None} and all(r.score == 0 for r in named if r.lang_pred == "und")


def test_copies_without_a_key_are_one_document(spark):
    docs = spark.createDataFrame([(None, WORDS), (None, WORDS), (None, WORDS), (3, "short"), (3, "short")], "doc_id long, text string")
    assert by(passages.removed(docs).collect(), "doc_id", "text") == [(3, "short"), (3, "short"), (None, WORDS)]
    assert by(simhash.deduplicated(docs).collect(), "doc_id", "text") == [(3, "short"), (None, WORDS)]


def test_intermediate_tables_can_be_deleted(odd, spark):
    from sparkloom.llm import common

    passages.classed(odd).collect()
    folder = spark._jvm.org.apache.hadoop.fs.Path(common.shared_folder(spark) + "/sparkloom")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(folder)
    common.clean(spark)
    assert not store.exists(folder)

"""What the pipeline's stages leave, where thinner settings would leave more."""

import pyarrow as pa
import pytest

import corpus_pipeline
from runscope.llm import op4_decontaminate as op4, op8_line_dedup as op8, op9_jaccard_join as op9
from runscope.llm.common import read
from tests.llm.test_op3_op9 import SCHEMA, rows, words

SMALL = "/root/testdata/sf0.001"


def brute_kept(docs, percent, width):
    """Ids that are the smallest of their component; texts of one id are one document."""
    sets = []
    for doc, text in docs:
        w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append((doc, frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if d is not None and e is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d for d, _ in sets if d is None or find(d) == d}


# ---- near-duplicates


def test_shingles_of_any_width_equal_brute_force(spark):
    docs = rows(7, 80)
    for percent, width in ((80, 5), (90, 3), (60, 1)):
        kept = op9.one_per_group(spark.createDataFrame(docs, SCHEMA).repartition(4), percent, width)
        assert {r.doc_id for r in kept.collect()} == brute_kept([d[:2] for d in docs], percent, width)


def near_copies():
    """A text, one with 18 percent appended, one with 2 percent of the words changed, and another text."""
    base = [f"w{i}" for i in range(400)]
    changed = [f"n{i}" if i % 50 == 25 else w for i, w in enumerate(base)]
    return [base, [*base, *(f"new{i}" for i in range(72))], changed, [f"v{i}" for i in range(400)]]


def test_the_stage_takes_near_copies_above_80_percent(spark):
    docs = [(i, " ".join(t), "s", None) for i, t in enumerate(near_copies())]
    frame = spark.createDataFrame(docs, SCHEMA)
    assert {r.doc_id for r in op9.one_per_group(frame).collect()} == {0, 1, 2, 3}  # the op9 query's settings
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, SMALL).collect()} == {0, 3}


def test_the_stage_equals_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.collect()], 80, 5)


# ---- groups of copies, through the line dedup


def copies(n, exact):
    """A group of ``n`` copies, each with a line of its own unless exact, and two blank texts."""
    names = "abcdefghij"
    lines = [" ".join(f"{a}{b}{c}" for c in names) for a in names for b in names[:3]]
    own = lambda k: "" if exact else "\n" + " ".join(f"{names[int(d)]}own" for d in f"{k:05}")
    return [(10 + k, "\n".join(lines) + own(k)) for k in range(n)] + [(5000, ""), (5001, " \n"), (5002, "alone here")]


@pytest.mark.parametrize("exact", [True, False])
def test_a_group_of_copies_leaves_one(spark, tmp_path, exact):
    for n in (19, 20, 1000):
        at = str(tmp_path / str(n))
        docs = [(d, t, "en", "s", len(t)) for d, t in copies(n, exact)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        assert sorted(r.doc_id for r in corpus_pipeline.run(spark, at).select("doc_id").collect()) == [10, 5000, 5001, 5002], n


# ---- lines


def test_long_lines_recur_from_two_documents_on(spark):
    passage = "the same long passage stands in " + " ".join("abcdefghijklmnopqrstuvwxyz") + " and is copied"
    docs = [(1, f"first own\n{passage} 7"), (2, f"{passage} 8\nsecond own"), (3, "short line"), (4, "short line"), (None, f"{passage} 9")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in op8.line_dedup(frame).collect()} == {1: docs[0][1], 2: "second own", 3: "short line", 4: "short line", None: ""}
    assert op8.line_report(frame, long_words=None).where("n_dropped > 0").count() == 0


# ---- decontamination


def test_a_long_overlap_scores_whole(spark):
    item = [f"w{i}" for i in range(300)]
    docs = [(1, " ".join(["a", "b", *item, "c"])), (2, " ".join(item[50:250])), (3, " ".join([*item[:200], "x", *item[201:]]))]
    docs += [(1, "another text of the same id"), (4, " ".join(["z"] * 9))]
    bench = spark.createDataFrame([(70, " ".join(item)), (71, "z " * 30)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in op4.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 70): (600, 2, 302), (2, 70): (400, 0, 200), (3, 70): (595, 0, 300)}


def test_the_pipeline_sends_small_batches_to_python(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["bytes"])

    monkeypatch.setattr(corpus_pipeline.op6_sentencepiece, "token_digests", lambda docs, _: docs.mapInArrow(sizes, "bytes long"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('a word ', 500) as text")  # 10 MB in one task
    try:
        found = [r.bytes for r in dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, "").collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(found) > 10_000_000 and max(found) < 5_000_000


def test_pipeline_reads_few_texts_at_a_time(spark, tmp_path):
    """Each batch of a Parquet file has all of its texts in one array of the JVM's heap."""
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.range(1000).selectExpr("id as doc_id", "repeat('word ', 100) as text").coalesce(1).write.parquet(f"{tmp_path}/docs")
    spark.conf.unset(rows)
    try:
        out = corpus_pipeline.encoding(spark, spark.read.parquet(f"{tmp_path}/docs"), SMALL)
        assert len(out.collect()) == 1000
        nodes = [out._jdf.queryExecution().executedPlan()]
        for node in nodes:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        (reading,) = (n for n in nodes if n.nodeName() == "ColumnarToRow")
        assert reading.metrics().apply("numInputBatches").value() >= 8  # 1 with as many rows as Spark takes
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.unset(rows)

"""Each stage of the pipeline on its own input, against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_classes, gram_jaccard
from voxstrata.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Name -> (rows before, rows after) of each stage."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), "test")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxic_documents_go_and_others_stay(spark, steps):
    before, after = map(texts, steps["toxicity"])
    toxic = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    assert all(toxic[d] for d in set(before) - set(after) if d in toxic)
    assert all(before[d] == t for d, t in after.items())


def test_lines_that_went_have_a_like_line_that_stayed(steps):
    before, after = map(texts, steps["line_dedup"])
    stayed = {line for t in after.values() for line in t.split("\n")}
    for d, t in before.items():
        rest = (after.get(d) or "").split("\n")
        for line in t.split("\n"):
            if line in rest:
                rest.remove(line)
            elif len(line.strip()) >= 24:
                assert line in stayed or any(len(line) * 0.7 < len(o) < len(line) * 1.5 and gram_jaccard(line, o) >= 0.7 for o in stayed)
            else:
                assert d not in after  # short lines go only with a whole document
    long = [line for t in after.values() for line in t.split("\n") if len(line.strip()) >= 24]
    assert len(long) == len(set(long))


def test_one_document_of_each_group_stays(steps):
    before, after = map(texts, steps["ngram_join"])
    ids = sorted(before)
    classes, n = brute_classes([before[i] for i in ids], 5, 80)
    assert set(after) == {ids[k] for k, c in enumerate(classes) if c == k}
    assert all(before[d] == t for d, t in after.items())


def test_leaks_go(spark, steps):
    before, after = map(texts, steps["decontamination"])
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    leaks = {d for d, t in before.items() if any(x in t for x in items)}
    assert leaks <= set(before) - set(after)
    for d in set(before) - set(after) - leaks:  # no window of five words of the item is missing by much
        have = set(zip(*[before[d].lower().split()[k:] for k in range(5)]))
        assert any(len(w & have) >= 0.5 * len(w) for x in items if (w := set(zip(*[x.lower().split()[k:] for k in range(5)]))))


def test_what_is_left_is_encoded(steps):
    tiktoken, vocabularies = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from voxstrata.llm.byte_bpe import load_ranks

    ref = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=load_ranks(vocabularies.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = texts(steps["byte_bpe"][0]), {r.doc_id: r for r in steps["byte_bpe"][1].collect()}
    assert set(after) == set(before)
    for d, t in before.items():
        ids = ref.encode_ordinary(t)
        assert (after[d].n_tokens, after[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert after[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns(spark, steps):
    want = table(spark, SF, "documents").columns
    assert all(after.columns == want for name, (_, after) in steps.items() if name != "byte_bpe")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small(spark, path, rows):
    """A folder with these documents, and the labels and benchmark of the smallest tables."""
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{path}/{name}.parquet")
    return f"file://{path}"


def test_stages_act_on_rows_and_not_on_ids(spark, tmp_path):
    """Ids that repeat or are null: no row goes, and no line, for what another row of its id holds."""
    line = lambda k: f"line {k} of those that are long enough to be compared with {k * k} others {k}"
    item = table(spark, SF, "benchmark").first().text
    rows = [(1, line(1) + "\n" + line(2)), (2, line(1) + "\n" + line(3)), (2, line(4) + "\n" + line(5)), (3, None), (3, ""), (None, line(6)), (None, line(7)), (4, item), (4, line(8) + " " + line(9))]
    sf = small(spark, str(tmp_path), rows)
    docs = table(spark, sf, "documents")
    lines = corpus_pipeline.drop_lines(spark, docs, sf)
    assert lines.columns == docs.columns
    want = [(1, rows[0][1]), (2, line(3)), *rows[2:]]
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text or "") for r in lines.collect() if r.text)
    kept = corpus_pipeline.drop_leaks(spark, lines, sf)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((r for r in want if r[1] != item), key=str)
    again = spark.createDataFrame([(5, line(1) * 3, "en", "s", 1), (5, line(2) * 3, "en", "s", 1), (6, line(1) * 3, "en", "s", 1), (None, line(2) * 3, "en", "s", 1), (5, line(1) * 3, "en", "s", 1)], SCHEMA)
    again = again.withColumns({"row": F.lit(1), "_row": F.lit(2), "node": F.lit(3)})
    assert sorted(r.text for r in corpus_pipeline.drop_copies(spark, again, sf).collect()) == [line(1) * 3, line(2) * 3]


def test_encode_takes_texts_in_small_batches(spark, monkeypatch):
    """Texts reach the encoder's workers in batches of a bounded size, by rows and by bytes."""

    def sizes(docs, *a, **b):
        def run(batches):
            for x in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x.num_rows], pa.int64()), pa.array([x.nbytes], pa.int64())], ["rows", "bytes"])

        return docs.select("text").mapInArrow(run, "rows long, bytes long")

    monkeypatch.setattr(corpus_pipeline.byte_bpe, "encode", sizes)
    for n, length in ((6000, 10), (1000, 40_000)):
        docs = spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), length).alias("text"))
        got = corpus_pipeline.encode(spark, docs, SF).collect()
        assert sum(r.rows for r in got) == n and max(r.rows for r in got) <= 2000 and max(r.bytes for r in got) < 16 << 20


def test_pipeline_of_an_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, small(spark, str(tmp_path), []))
    assert out.count() == 0 and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}

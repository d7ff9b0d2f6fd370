"""The pipeline stage by stage on the smallest table, each against plain Python on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from test_operators import LOWER, plain_components, plain_contamination

from barweave.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.toPandas().set_index("doc_id"), after.toPandas(), after.columns))
        docs = after
    return out


def test_columns(steps):
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, columns in steps[:-1])


def test_quality_keeps_clean_documents(spark, steps):
    labels = table(spark, FOLDER, "labels").toPandas().set_index("doc_id")["quality"]
    kept = set(steps[0][1]["doc_id"])
    marked = [(i in kept, q == 1) for i, q in labels.items()]
    assert sum(a == b for a, b in marked) >= 0.97 * len(marked)


def test_exact_dedup(steps):
    before, after, _ = steps[1]
    best = {}
    for i, t in before["text"].items():
        best[t.translate(LOWER)] = max(i, best.get(t.translate(LOWER), -1))
    assert sorted(after["doc_id"]) == sorted(best.values())


def test_near_dedup(steps):
    before, after, _ = steps[2]
    before = before.sort_index()
    labels = plain_components(list(before["text"]), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_SIMILARITY)
    assert sorted(after["doc_id"]) == [i for place, i in enumerate(before.index) if labels[place][1] == place]


def test_decontamination(spark, steps):
    before, after, _ = steps[3]
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    hits = plain_contamination(list(before["text"]), items)
    assert sorted(after["doc_id"]) == sorted(i for i, (n, hit, _) in zip(before.index, hits) if not (hit and 20 * hit >= n))


def test_packing(steps):
    before, after, _ = steps[4]
    assert set(after["doc_id"]) == set(before.index)
    assert after.groupby("sequence_id")["length"].sum().max() <= 1024


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names


# Stages over awkward rows: null and repeated ids, repeated rows, null and empty texts, clashing names.
ROWS = [
    (1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (1, "another text of the same id, all on its own here"),
    (None, "a document without an id that nobody repeats at all"), (None, "ONE two three four five six seven eight"), (None, None), (7, ""), (7, None),
    (9, "shared words " * 30 + "end"), (8, "shared words " * 30 + "END"), (None, "p q r s t u v w x y z " * 20 + "a"), (3, "p q r s t u v w x y z " * 20 + "b"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, contamination string, component string, key string, document string"


def awkward(spark, rows, path):
    df = spark.createDataFrame([(i, t, "en", "s", 0, "c", "p", "k", "d") for i, t in rows], CLASH)
    df.write.parquet(path)
    return spark.read.parquet(path)


def kept(df):
    assert df.columns == [c.split()[0] for c in CLASH.split(", ")]
    rows = df.collect()
    assert all((r["contamination"], r["component"], r["key"], r["document"]) == ("c", "p", "k", "d") for r in rows)
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages_keep_what_has_no_copy(spark, tmp_path):
    docs = awkward(spark, ROWS, f"file://{tmp_path}/docs")
    spark.createDataFrame([(1, "p q r s t u v w x y z p q")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    exact = kept(corpus_pipeline.drop_copies(spark, docs, f"file://{tmp_path}"))
    assert [i for i, t in exact if (t or "").lower() == ROWS[0][1]] == [1] and [i for i, t in exact if not t] == [7]
    assert [i for i, t in exact if (t or "").lower().endswith("end")] == [9] and len(exact) == 7
    near = kept(corpus_pipeline.drop_near_copies(spark, docs, f"file://{tmp_path}"))
    assert len([1 for i, t in near if not t]) == 3 and (None, ROWS[3][1]) in near and (1, ROWS[2][1]) in near
    assert [i for i, t in near if (t or "").lower() == ROWS[0][1]] == [1] and [i for i, t in near if (t or "").lower().endswith("end")] == [8]
    assert [i for i, t in near if (t or "").startswith("p q")] == [3]
    clean = kept(corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}"))
    assert clean == sorted(((i, t) for i, t in ROWS if not (t or "").startswith("p q")), key=str)


def test_stages_without_rows(spark, tmp_path):
    docs = awkward(spark, [], f"file://{tmp_path}/docs")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated, corpus_pipeline.pack_sequences):
        assert stage(spark, docs, f"file://{tmp_path}").isEmpty()

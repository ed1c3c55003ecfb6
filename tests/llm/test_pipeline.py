"""The pipeline's stages on a small table."""

import random

import corpus_pipeline
import pytest

from corvane.llm.mixing import copies


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(2000)]

    def text(n):
        out = []
        while len(out) < n:
            part = [r.choice(vocabulary) for _ in range(r.randint(6, 12))]
            out += [part[0].capitalize(), *part[1:-1], part[-1] + "."]
        return " ".join(out[:n])

    items = [(i, text(30)) for i in range(5)]
    passage, docs = text(60), []
    for i in range(120):
        docs.append((i, text(r.randint(40, 200)), "en", f"src{i % 3}"))
    docs += [(200, docs[7][1], "en", "src0"), (201, docs[8][1] + " tail words", "en", "src1")]  # copies
    docs += [(210 + i, " ".join(w + "%%%" for w in text(80).split()), "en", "src0") for i in range(8)]
    docs += [(220 + i, "Same Same Same Same " * 40, "en", "src0") for i in range(4)]
    docs += [(230, text(50) + " " + passage + " " + text(50), "en", "src2"), (231, text(40) + " " + passage + " " + text(40), "en", "src2")]
    docs += [(240, text(40) + " " + items[2][1] + " " + text(40), "en", None), (250, "You idiot moron. " + text(60), "en", "src1")]
    docs += [(None, None, None, None), (260, "", "en", "src1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(250, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), passage


def test_stages(spark, tables):
    path, passage = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append({r.doc_id: r for r in docs.collect()})
    good, single, clean, safe = seen
    assert set(range(120)) | {200, 201, 230, 231, 240} <= set(good) and not set(good) & ({*range(210, 224), 250, 260, None})
    assert set(good) - set(single) == {200, 201}
    assert passage in clean[230].text and passage not in clean[231].text and clean[231].n_chars == len(clean[231].text) > 200
    assert set(clean) - set(safe) == {240}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    want = {r.doc_id: r.copies for r in copies(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    assert len(rows) > 100 and {"doc_id", "text", "source", "copy"} <= set(rows[0].asDict())

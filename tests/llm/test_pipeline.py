from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from oddslake.llm import mixing, quality_model

from .test_dedup import plain_lines, plain_near


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_return_documents(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(df.columns == columns for df in stages[:-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_each_stage_by_brute_force(spark, sf_dir, stages):
    good, lines, single, mix, ids = stages
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    want = quality_model.classify(docs, labels).where("predicted = 1").select("doc_id").collect()
    assert {i for i, _ in rows(good)} == {r["doc_id"] for r in want}
    assert Counter(rows(lines)) == Counter((i, t) for i, t, *_ in plain_lines(rows(good), 10))
    kept = {i for i, _, _, keep in plain_near(rows(lines)) if keep}
    assert {i for i, _ in rows(single)} == kept
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert Counter(i for i, _ in rows(mix)) == +Counter(copies)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows(mix))
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in ids.collect())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == stages[-1].columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in stages[-1].collect())


def python_steps_ahead(df):
    """Whether a task that reads the rows of ``df`` runs Python for them: a step of Python in its plan with no exchange, written table or broadcast above it."""
    above = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        if "InArrow" in line and not any("Exchange" in x for _, x in above):
            return True
        above.append((depth, line))
    return False


@pytest.mark.parametrize("most_broadcast", [quality_model.MOST_BROADCAST_LABELS, 0])
def test_no_task_of_a_stage_holds_two_python_workers(spark, sf_dir, monkeypatch, most_broadcast):
    kind, chained = type(spark.range(0)), []
    real = kind.mapInArrow

    def watched(df, func, schema, *more, **named):
        if python_steps_ahead(df):
            chained.append(schema)
        return real(df, func, schema, *more, **named)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert python_steps_ahead(quality_model.features(docs).where("doc_id > 0"))
    assert not python_steps_ahead(quality_model.features(docs).repartition("doc_id"))
    monkeypatch.setattr(kind, "mapInArrow", watched)
    monkeypatch.setattr(quality_model, "MOST_BROADCAST_LABELS", most_broadcast)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir)
    assert not chained


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows_and_characters_beyond_the_vocabulary(spark, sf_dir, odd_rows):
    from .test_tokens import BEYOND

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(i, t, *(rest + (None, None))[:2], None) for i, t, *rest in ((*r[:2], *r[2:]) for r in odd_rows) for rest in (tuple(rest),)]
    docs = docs.limit(20).union(spark.createDataFrame(rows + [(500 + k, t, None, "z", None) for k, t in enumerate(BEYOND)], docs.schema))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.to_pieces(spark, docs, sf_dir).collect())
    assert got == Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in docs.collect())

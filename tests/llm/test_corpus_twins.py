"""Corpus queries next to their SQL twins, and the pipeline against its stages done plainly."""

import re

import pytest

import corpus_pipeline
from checks.compare import connect, difference, spark_rows, sql_rows
from custoria.llm.queries import QUERIES, TWINS
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    assert difference(spark_rows(QUERIES[name](spark, SMALL)), sql_rows(connect(SMALL), TWINS[name])) is None


def test_pipeline_keeps_what_plain_stages_keep(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    best = {}
    for d, t in docs:
        body = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[body] = min(best.get(body, (0, d)), (-len(t), d))
    docs = [(d, t) for d, t in docs if any(d == x for _, x in [best[re.sub(r"[\x20\x09-\x0D]", "", t)]])]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in docs for w in [t.lower().split()]}
    label = {d: d for d in sets}
    order = sorted(sets)
    for _ in range(4):
        for i, a in enumerate(order):
            for b in order[:i]:
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    docs = [(d, t) for d, t in docs if label[d] == d]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    wanted = {d for d, t in docs if not any(plain(item) in plain(t) for item in items)}
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()}
    assert found == wanted
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact dedup", "near dedup", "decontamination", "packing"]

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from conftest import DATA
from synthcal.llm import cascade, compress, mixing, packing, queries

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    oracle.same(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name])


def plain_first_of_near_copies(texts):
    """Every pair of texts compared: similarity 0.8 of the sets of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return sorted(set(group.values()))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rules = corpus_pipeline.quality_rules(spark, docs, SF)
    table = {r["doc_id"]: r["kept"] for r in cascade.quality_table(docs, list(cascade.RULES)).collect()}
    assert {r["doc_id"] for r in rules.collect()} == {i for i, k in table.items() if k}
    good = corpus_pipeline.quality_classifier(spark, rules, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = compress.quality_scores(rules, compress.fit_quality(docs, labels))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scores.where("score >= 0.5").collect()}
    one = corpus_pipeline.near_duplicates(spark, good, SF)
    assert sorted(r["doc_id"] for r in one.collect()) == plain_first_of_near_copies({r["doc_id"]: r["text"] for r in good.collect()})
    mixed = corpus_pipeline.mix_sources(spark, one, SF)
    taken = mixing.mix(one).agg(F.sum("taken")).first()[0]
    assert all(df.columns == columns for df in (rules, good, one, mixed))
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == taken
    packed = packing.pack(mixed, queries.tokenizer_path()).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["start"] == 0) == collections.Counter(r["doc_id"] for r in mixed.collect())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() == len(packed)

import corpus_pipeline as pipeline
import duckdb
import pytest
from conftest_llm import docs_frame
from test_links import linked, spans
from test_texts import hits

from braidwin.llm import queries
from braidwin.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_every_stage_does_its_job(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = table(spark, SF, "documents")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, kept[-1], SF), "stage-" + name)
        assert name == "packing" or out.columns == docs.columns
        kept.append(out)
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:5]]
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()} & {d for d, _ in rows[0]}
    assert len(good & {d for d, _ in rows[1]}) > 0.9 * len(good)
    assert {d for d, _ in rows[2]} == {c for _, c in linked(rows[1]).values()}
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert {d for d, _ in rows[3]} == {d for d, (_, hit, _) in hits(rows[2], bench).items() if not hit}
    assert [d for d, _ in sorted(rows[4])] == [d for d, _ in sorted(rows[3])] and not any(spans(t) for _, t in rows[4])
    before = dict(rows[3])
    assert all(t == before[d] or "<SECRET>" in t for d, t in rows[4])
    packed = kept[5].toPandas()
    assert set(packed["doc_id"]) == {d for d, _ in rows[4]} and (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()
    run = pipeline.run(spark, SF)
    assert run.count() == len(packed)


@pytest.mark.parametrize("n", range(5))
def test_stages_of_odd_rows_and_empty_tables(spark, odd, n):
    name, stage = pipeline.STAGES[n]
    out = stage(spark, odd, SF)
    assert (name == "packing" or out.columns == odd.columns) and out.count() > 0
    assert stage(spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rows, result = queries.queries()[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(rows.columns)
    assert sorted(result.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in rows.collect()) == sorted(repr([r[result.columns.index(c)] for c in columns]) for r in result.fetchall())


def test_the_queries_are_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in found if k.startswith("op")) == list(range(1, 11)) and "pipeline" in found
    assert set(queries.oracle_sql()) <= set(entry.oracle_sql())
    assert docs_frame(spark, []).count() == 0

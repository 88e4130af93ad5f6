"""Each query against its SQL in DuckDB at the smallest scale; the rest must run."""

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import annotated  # noqa: F401
from textloom.plans import queries as core

from .conftest import DATA

SF = DATA / "sf0.001"
SLOW = {"sequential_diversity"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(spark_df, duck_df):
    a, b = spark_df[sorted(spark_df.columns)], duck_df[sorted(duck_df.columns)]
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    keys = sorted(a.columns, key=lambda c: a[c].dtype.kind == "f")
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (a, b))
    for c in a.columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, str(SF)).toPandas()
    assert len(got)
    if name in core.ORACLE:
        same(got, duck.execute(core.ORACLE[name]).df())


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200


def test_streaming(spark, tmp_path):
    from textloom.streaming.counts import read_documents, stream_statistics

    spark.read.parquet(str(SF / "documents.parquet")).write.parquet(str(tmp_path / "in"))
    q = stream_statistics(read_documents(spark, str(tmp_path / "in"))).select("doc_id", "n_words", "lix").writeStream.format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stats").count() == 200


def test_components(spark):
    from textloom.plans.components import CLASSES

    docs = spark.read.parquet(str(SF / "documents.parquet")).limit(5).select("doc_id", "source", "text")
    out = docs.union(spark.createDataFrame([(-1, "src0", " ... "), (-2, None, None)], docs.schema))
    plain = ["basic", "readability", "unadapted_readability", "lexical", "style", "phonetics", "cohesion"]
    for name in plain:
        out = CLASSES[name]().transform(out)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 7 and all(rows[k][c] is None for k in (-1, -2) for c in plain)
    assert all(r.readability.lix > 0 and r.unadapted_readability.gulpease and r.basic.n_words and r.lexical.coverage == 1 for k, r in rows.items() if k >= 0)
    from textloom.functions.checks import SourceError

    with pytest.raises(SourceError):
        CLASSES["syntax"]().transform(docs)
    with pytest.raises(SourceError):
        CLASSES["readability"](basic="other").transform(docs)


def test_components_of_annotated_documents(spark):
    from textloom.plans.components import CLASSES
    from textloom.sources.readers import with_tokens

    docs = with_tokens(annotated.annotated(spark, str(SF)).where("doc_id < 4"))
    out = docs
    for name in ("syntax", "morphology", "cohesion"):
        out = CLASSES[name]().transform(out)
    rows = out.collect()
    assert len(rows) == 4 and all(r.syntax.n_sents > 0 and r.morphology.counts["pos"] and r.cohesion.p_pronouns >= 0 for r in rows)


def test_command_line(spark, tmp_path):
    import json

    from textloom.plans import cli

    (tmp_path / "f.txt").write_text("One small text. It has two sentences.", encoding="utf-8")
    assert cli.main([str(tmp_path / "f.txt"), "-s", "basic", "readability", "-f", "json", "-o", str(tmp_path / "out")]) == 0
    (line,) = [x for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert json.loads(line)["basic"]["n_words"] == 7 and json.loads(line)["readability"]["lix"] > 0
    (tmp_path / "f.conllu").write_text("".join(f"{i}\t{w}\t{w.lower()}\t{t}\t_\t_\t{h}\t{d}\t_\t_\n" for i, w, t, h, d in [(1, "Dogs", "NOUN", 2, "nsubj"), (2, "bark", "VERB", 0, "root"), (3, ".", "PUNCT", 2, "punct")]) + "\n", encoding="utf-8")
    assert cli.main([str(tmp_path / "f.conllu"), "-c", "-s", "syntax", "morphology", "-f", "json", "-o", str(tmp_path / "out2")]) == 0
    (line,) = [x for p in (tmp_path / "out2").glob("*.json") for x in p.read_text().splitlines()]
    assert json.loads(line)["syntax"]["clauses_per_sent"] == 1 and json.loads(line)["morphology"]["counts"]["pos"] == {"NOUN": 1, "VERB": 1}
    assert cli.main([str(tmp_path / "f.txt"), "-s", "syntax", "-f", "json", "-o", str(tmp_path / "out3")]) == 1

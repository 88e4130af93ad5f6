"""A document's report as one HTML page: statistics, its longest sentences in text order, highlighted text."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly, basic

STYLE = "body{font:16px serif;max-width:50em;margin:2em auto}td{padding:.2em 1em;border-bottom:1px solid #ddd}mark{background:#fe9}"


def top_sentences(docs: DataFrame, k: int = 10) -> DataFrame:
    """The k longest sentences of each document, in text order."""
    from pyspark.sql import Window as W

    rows = assembly.long_sentences(docs, 1)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n_words"), "sent_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).orderBy("doc_id", "sent_id")


def highlighted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans (start, end, layer) as marks; those that overlap an earlier one are left out."""
    out, at = [], 0
    for start, end, layer in sorted(spans):
        if start >= at:
            out += [escape(text[at:start]), f'<mark title="{escape(layer)}">{escape(text[start:end])}</mark>']
            at = end
    return "".join([*out, escape(text[at:])])


def report(docs: DataFrame, doc_id, title: str = "Report", k: int = 10) -> str:
    """HTML of one document; only its rows reach the driver."""
    one = docs.where(F.col("doc_id") == doc_id).select("doc_id", "text")
    row = one.first()
    if row is None:
        raise KeyError(doc_id)
    stats = basic.readability(basic.basic_stats(one)).first().asDict()
    table = "".join(f"<tr><td>{escape(n)}</td><td>{v:.4g}</td></tr>" if isinstance(v, float) else f"<tr><td>{escape(n)}</td><td>{escape(str(v))}</td></tr>" for n, v in stats.items() if not isinstance(v, dict))
    sents = "".join(f"<tr><td>{r.n_words}</td><td>{escape(r.sentence)}</td></tr>" for r in top_sentences(one, k).collect())
    marks = [(r.start, r.end, r.layer) for r in assembly.complex_words(one).collect()]
    body = highlighted(row.text or "", marks).replace("\n", "<br>")
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1><table>{table}</table><h2>Sentences</h2><table>{sents}</table><h2>Text</h2><p>{body}</p>"

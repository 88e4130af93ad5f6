"""python -m textloom.plans.cli FILES -s basic readability -p sentences -f csv -o OUT"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators import basic
from ..operators.assembly import by_parts
from ..sources.readers import read_annotated, read_texts, write_csv, write_json
from .components import CLASSES


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("files", nargs="+")
    p.add_argument("-s", "--stats", nargs="+", default=["basic"], choices=sorted(CLASSES))
    p.add_argument("-c", "--conllu", action="store_true", help="files are CoNLL-U: syntax, morphology and cohesion read their annotation")
    p.add_argument("-p", "--parts", choices=["sentences", "lines", "paragraphs"])
    p.add_argument("-f", "--format", default="table", choices=["table", "json", "csv"])
    p.add_argument("-e", "--encoding", default="utf-8")
    p.add_argument("-o", "--output")
    o = p.parse_args(args)
    if o.format != "table" and not o.output:
        p.error("json and csv need --output")
    spark = SparkSession.builder.getOrCreate()
    docs, failed = read_annotated(spark, o.files) if o.conllu else read_texts(spark, o.files, o.encoding), 0
    out = by_parts(docs, basic.basic_stats, o.parts) if o.parts else docs
    for name in [] if o.parts else o.stats:
        try:
            options = {"part": "doc_id"} if name == "lexical" else {}
            out = CLASSES[name](**options).transform(out)
        except Exception as e:  # one class that fails doesn't stop the others
            print(f"{name}: {e}", file=sys.stderr)
            failed = 1
    out = out.drop("text", "tokens")
    if o.format == "table":
        out.show(truncate=False, vertical=True)
    else:
        (write_json if o.format == "json" else write_csv)(out, o.output)
    return failed


if __name__ == "__main__":
    sys.exit(main())

"""python -m quillon.cli convert|score|diff|split|select|head|scan|scores|diffscores|edit … : conversion, scoring, table verbs, document and score tools."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from quillon.operators import tables
from quillon.plans import ir, models
from quillon.sources import files


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    verbs = parser.add_subparsers(dest="verb", required=True)
    convert = verbs.add_parser("convert", help="read one format, write another")
    convert.add_argument("source")
    convert.add_argument("target")
    score = verbs.add_parser("score", help="score a file with a model document")
    score.add_argument("model")
    score.add_argument("source")
    score.add_argument("target")
    score.add_argument("--keep", default="")
    diff = verbs.add_parser("diff", help="where two model documents differ")
    diff.add_argument("left")
    diff.add_argument("right")
    diff.add_argument("--digits", type=int, default=8)
    split = verbs.add_parser("split", help="share a document's segments among several")
    split.add_argument("model")
    split.add_argument("parts", type=int)
    select = verbs.add_parser("select", help="formulas over a file's rows, with cuts")
    select.add_argument("source")
    select.add_argument("target")
    select.add_argument("formulas", help="name=formula, separated by semicolons")
    select.add_argument("--where", default=None)
    for verb, text in (("head", "the first rows in order"), ("scan", "some rows as aligned text")):
        shown = verbs.add_parser(verb, help=text)
        shown.add_argument("source")
        shown.add_argument("--order", default="")
        shown.add_argument("-n", type=int, default=10)
    scores = verbs.add_parser("scores", help="formulas over score records")
    scores.add_argument("source")
    scores.add_argument("target")
    scores.add_argument("schema")
    scores.add_argument("formulas")
    scores.add_argument("--where", default=None)
    scores.add_argument("--kind", default="xml")
    changed = verbs.add_parser("diffscores", help="where two score files differ")
    changed.add_argument("left")
    changed.add_argument("right")
    changed.add_argument("schema")
    changed.add_argument("key")
    changed.add_argument("--digits", type=int, default=8)
    changed.add_argument("--kind", default="xml")
    o = parser.parse_args(args)
    if o.verb == "diff":
        found = ir.difference(ir.load(Path(o.left).read_text()), ir.load(Path(o.right).read_text()), o.digits)
        print("\n".join(found))
        return int(bool(found))
    if o.verb == "split":
        for k, part in enumerate(ir.split_segments(ir.load(Path(o.model).read_text()), o.parts)):
            Path(o.model).with_suffix(f".{k}.pmml").write_text(ir.to_xml(part))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if o.verb == "diffscores":
        key = tuple(o.key.split(","))
        found = tables.score_differences(*(files.read_scores(spark, p, o.schema, o.kind) for p in (o.left, o.right)), key, o.digits)
        print(tables.scan(found.orderBy(*key, "field"), 50))
        return int(not found.isEmpty())
    rows = files.read_scores(spark, o.source, o.schema, o.kind) if o.verb == "scores" else files.read_any(spark, o.source)
    if o.verb in ("head", "scan"):
        print(tables.scan(tables.head(rows, o.order.split(","), o.n) if o.order else rows, o.n))
        return 0
    if o.verb in ("select", "scores"):
        named = [part.partition("=") for part in o.formulas.split(";")]
        files.write(tables.select(rows, ", ".join(f for _, _, f in named), [n.strip() for n, _, _ in named], o.where), o.target)
        return 0
    if o.verb == "convert":
        files.write(rows, o.target)
    else:
        doc = ir.load(Path(o.model).read_text())
        files.write(models.score(files.check_fields(rows, doc), doc, tuple(filter(None, o.keep.split(",")))), o.target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

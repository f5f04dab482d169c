"""convert, validate and extract, from the command line: python -m assayspark.cli --help"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayspark.model import run
from assayspark.operators import extract, render
from assayspark.operators.read import read_tables
from assayspark.operators.schema import from_json_schema, schema_issues
from assayspark.operators.validate import issues, reports, summary
from assayspark.sources.rest import document_urls
from assayspark.sources.sinks import ARCHIVES, write_archive, write_documents


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="assayspark")
    commands = out.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="documents to text or JSON files")
    convert.add_argument("source"), convert.add_argument("folder")
    convert.add_argument("--to-format", choices=("txt", "json"), default="json")
    convert.add_argument("--compression", choices=("", "gz", "bz2", *ARCHIVES), default="")
    convert.add_argument("--force", action="store_true")
    validate = commands.add_parser("validate", help="issues of documents, and a summary")
    validate.add_argument("source"), validate.add_argument("--to-path"), validate.add_argument("--silent", action="store_true")
    validate.add_argument("--per-file", action="store_true", help="a file of issues for each document that has some, in place of one table")
    validate.add_argument("--schema", help="a JSON Schema file, whose rules are added: known keys of sections, for one")
    metadata = commands.add_parser("extract-metadata", help="the values of keys")
    metadata.add_argument("source"), metadata.add_argument("to_path"), metadata.add_argument("keys", nargs="+")
    metabolites = commands.add_parser("extract-metabolites", help="metabolites of documents that conditions hold for")
    metabolites.add_argument("source"), metabolites.add_argument("to_path"), metabolites.add_argument("--where", nargs="+", default=[], help="SEC:KEY=value or SEC:KEY=r'pattern'")
    for command in (metadata, metabolites):
        command.add_argument("--to-format", choices=("csv", "json"), default="json")
        command.add_argument("--no-header", action="store_true")
    urls = commands.add_parser("urls", help="addresses of analyses and studies by their ids")
    urls.add_argument("base"), urls.add_argument("item", help="the service's name for whole documents"), urls.add_argument("ids", nargs="+"), urls.add_argument("--extension", default="txt")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("assayspark").getOrCreate()
    if args.command == "urls":
        spark.createDataFrame([(i,) for i in args.ids], "id string").select("id", document_urls(args.base, F.col("id"), args.item, args.extension).alias("url")).show(len(args.ids), False)
        return
    with run(spark):
        _work(spark, args)


def _work(spark: SparkSession, args: argparse.Namespace) -> None:
    t = read_tables(spark, args.source, force=getattr(args, "force", False)).kept()
    if args.command == "convert":
        texts = render.to_text(t) if args.to_format == "txt" else render.to_json(t)
        if args.compression in ARCHIVES and args.folder.endswith(f".{args.compression}"):
            write_archive(texts, args.folder, args.to_format, args.compression)
        else:
            write_documents(texts, args.folder, args.to_format, args.compression)
    elif args.command == "validate":
        more = from_json_schema(json.loads(spark.read.text(args.schema, wholetext=True).first()[0])) if args.schema else None
        found = issues(t, extra=[schema_issues(t, more=more)], store=True)
        if args.to_path and args.per_file:
            write_documents(reports(found), args.to_path, "json")
        elif args.to_path:
            found.write.mode("overwrite").json(args.to_path)
        if not args.silent:
            for row in summary(t.files, found).orderBy("file_id").toLocalIterator():  # a line for each document, however many there are
                print(row.file_id, row.status, f"{row.n_issues} issues, {row.n_warnings} of them warnings", *(f"{x.tag}: {x.n}" for x in row.tags or ()), sep="\t")
    elif args.command == "extract-metadata":
        found = extract.metadata(t, args.keys)
        if args.to_format == "csv":
            extract.write_metadata_csv(found, args.to_path, not args.no_header)
        else:
            extract.write_json(found, args.to_path)
    else:
        found = extract.measurements(t, extract.matchers([extract.parse_condition(c) for c in args.where]))
        if args.to_format == "csv":
            extract.write_metabolites_csv(extract.metabolite_counts(found), args.to_path, not args.no_header)
        else:
            extract.write_json(extract.metabolite_samples(found), args.to_path)


if __name__ == "__main__":
    main()

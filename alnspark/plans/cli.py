"""Command line: encode, decode, convert, cat, set.  Inputs are never deleted.

``-`` as an input is standard input, as an output standard output (one file's bytes or lines).
Without an output, encode writes beside its input with ``SUFFIX`` added, and decode and convert
write into the working folder under the input's name without its last suffix.
"""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.text_formats import FORMATS
from ..operators.set_ops import OPERATIONS
from ..sources import container, layout
from ..sources.text import read_fastx_names, read_names, stream_lines
from ..workspace import shared_path
from . import api

SUFFIX = ".pa"
PIPE = "-"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="alnspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("encode", "convert"):
        v = verbs.add_parser(verb)
        v.add_argument("input", help="text file or folder, - for standard input")
        v.add_argument("-o", "--output")
        v.add_argument("-q", "--query", help="FASTA or FASTQ file of the reads")
        v.add_argument("-t", "--targets", help="file with one target name a line")
        v.add_argument("--from", dest="source", choices=FORMATS)
        v.add_argument("--trim-trailing", action="store_true")
        if verb == "convert":
            v.add_argument("-F", "--format", required=True, choices=FORMATS[:-1])
        else:
            v.add_argument("--sample")
            v.add_argument("--rename", action="store_true")
            v.add_argument("--strip-names", action="store_true")
            v.add_argument("--block-size", type=int)
            v.add_argument("--by", default="row_idx", choices=["row_idx", "query_id"], help="blocks in input order or by ranges of ids")
            v.add_argument("--plain-metadata", action="store_true")
    v = verbs.add_parser("decode")
    v.add_argument("input")
    v.add_argument("-o", "--output")
    v.add_argument("-F", "--format", default="tsv", choices=FORMATS[:-1])
    v = verbs.add_parser("cat")
    v.add_argument("inputs", nargs="+")
    v.add_argument("-o", "--output", default=PIPE)
    v.add_argument("--force", action="store_true", help="write bytes to standard output even if it is a terminal")
    v = verbs.add_parser("set")
    v.add_argument("operation", choices=OPERATIONS)
    v.add_argument("inputs", nargs="+")
    v.add_argument("-o", "--output", default=PIPE)
    v.add_argument("--sample", default="")
    v.add_argument("--universe", default="first", choices=["first", "all"])
    for verb in ("encode", "cat", "set"):
        verbs.choices[verb].add_argument("--folder", action="store_true", help="leave blocks in files of their own")
    return p


class Pipes:
    """Standard input and output, by way of the shared folder, where executors can read and write."""

    def __init__(self, spark: SparkSession, stdin=None, stdout=None):
        self.spark, self.stdin, self.stdout = spark, stdin or sys.stdin.buffer, stdout or sys.stdout.buffer

    def source(self, path: str) -> str:
        if path != PIPE:
            return path
        own = shared_path(self.spark, "stdin")
        system, name = container.file_system(own)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name) as out:
            shutil.copyfileobj(self.stdin, out, container.CHUNK)
        return own

    def sink(self, path: str) -> str:
        return shared_path(self.spark, "stdout") if path == PIPE else path

    def lines(self, path: str) -> None:
        for line in stream_lines(self.spark, path):
            self.stdout.write(line.encode() + b"\n")

    def bytes(self, path: str) -> None:
        system, name = container.file_system(path)
        with system.open_input_stream(name) as f:
            while chunk := f.read(container.CHUNK):
                self.stdout.write(chunk)


def output_of(a: argparse.Namespace) -> str:
    if a.output:
        return a.output
    if a.input == PIPE:
        return PIPE
    return a.input + SUFFIX if a.verb == "encode" else Path(a.input).stem


def main(args: list[str] | None = None, spark: SparkSession | None = None, stdin=None, stdout=None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("alnspark").getOrCreate()
    pipes = Pipes(spark, stdin, stdout)
    if a.verb in ("cat", "set"):
        if a.output == PIPE and a.folder:
            raise SystemExit("a folder cannot go to standard output")
        if a.verb == "cat" and a.output == PIPE and not a.force and pipes.stdout.isatty():
            raise SystemExit("will not write bytes to a terminal without --force")
        inputs, out = [pipes.source(x) for x in a.inputs], pipes.sink(a.output)
        if a.verb == "cat":
            api.cat(spark, inputs, out, folder=a.folder)
        else:
            api.merge(spark, inputs, out, a.operation, a.sample, a.universe, a.folder)
        if a.output == PIPE:
            pipes.bytes(out)
        return
    to = output_of(a)
    source, out = pipes.source(a.input), pipes.sink(to)
    if a.verb == "decode":
        api.decode(spark, source, out, a.format)
    else:
        queries = read_fastx_names(spark, a.query) if a.query else None
        targets = read_names(spark, a.targets, "target") if a.targets else None
        if a.verb == "convert":
            api.convert(spark, source, out, a.format, targets, queries, a.source, a.trim_trailing)
        else:
            api.encode(spark, source, out, targets, queries, a.sample if a.sample is not None else (a.query or ""), a.source,
                       a.rename, a.strip_names, a.block_size, layout.PLAIN if a.plain_metadata else layout.GZIP,
                       trim_trailing=a.trim_trailing, by=a.by, folder=a.folder)
    if to == PIPE:
        (pipes.bytes if a.verb == "encode" else pipes.lines)(out)


if __name__ == "__main__":
    main()

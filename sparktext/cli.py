"""Command line: build, build-multi, info, graph, search, browse and web answers.

    python -m sparktext.cli build [--backend fm|suffixarray|bifm] [--algo sais] [--occ rlbwt] ... FILE INDEX
    python -m sparktext.cli search [--limit 20] [--context 80] [--positions] INDEX PATTERN
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.options import parse_algorithm, parse_occ, parse_storage
from .operators import explain, graph, suffix
from .operators import search as ops
from .sources import catalog
from .sources.corpus import Corpus


def session() -> SparkSession:
    return SparkSession.builder.appName("sparktext").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparktext")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "build-multi"):
        b = sub.add_parser(name)
        b.add_argument("--backend", default="fm", choices=("fm", "suffixarray", "bifm"))
        b.add_argument("--algo", default="sais")
        b.add_argument("--occ", default="rlbwt")
        b.add_argument("--storage", default="memory")
        b.add_argument("--external-strategy", default="lsm")
        b.add_argument("--disk-block-size", type=int, default=4096)
        b.add_argument("paths", nargs="+", help="input files or folders, then the index folder")
    sub.add_parser("info").add_argument("index")
    g = sub.add_parser("graph")
    g.add_argument("--max-nodes", type=int, default=16)
    g.add_argument("--markdown", default="true", choices=("true", "false"))
    g.add_argument("index")
    s = sub.add_parser("search")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--context", type=int, default=80)
    s.add_argument("--positions", action="store_true")
    s.add_argument("index")
    s.add_argument("pattern")
    r = sub.add_parser("browse")
    r.add_argument("--show", type=int, default=10)
    r.add_argument("--context", type=int, default=40)
    r.add_argument("index")
    w = sub.add_parser("web", help="print the JSON body of a search (or, without --q, of the info request)")
    w.add_argument("--index", required=True)
    w.add_argument("--limit", type=int, default=20)
    w.add_argument("--context", type=int, default=80)
    w.add_argument("--min-chars", type=int, default=4)
    w.add_argument("--q")
    return p


def matches(index: catalog.Index, pattern: str, limit: int, around: int) -> tuple[list[tuple[int, str]], bool]:
    """(position, snippet) in ascending order and whether the limit cut them. Snippets use the length of
    the pattern as it is written."""
    found = index.search(pattern, limit, compat=True)
    rows = ops.snippets(index.corpus, found.positions, len(pattern.encode()), around).orderBy("pos").collect()
    return [(r["pos"], r["snippet"]) for r in rows], bool(found.summary.first()["truncated"])


def info_lines(index: catalog.Index) -> list[str]:
    r = index.info().first()
    if index.backend != "fm":
        name = {"suffixarray": "stdlib suffixarray", "bifm": "bidirectional fm-index"}[index.backend]
        return [f"backend: {name}", f"text length: {r['text_len']}"]
    return ["backend: fm-index", f"text length: {r['text_len']}", f"sa length: {r['sa_len']}", f"alphabet size: {r['alphabet_size']}", f"occ structure: {r['occ']}", f"occ storage: {r['storage']}", f"bwt runs: {r['bwt_runs']}"]


def browse(index: catalog.Index, show: int, around: int, lines, out) -> None:
    """Answer one pattern a line; a blank line ends."""
    for line in lines:
        pattern = line.rstrip("\n")
        if not pattern.strip():
            return
        try:
            found, cut = matches(index, pattern, show, around)
        except ValueError as e:
            print(e, file=out)
            continue
        for pos, snippet in found:
            print(f"{pos}: {' '.join(snippet.split())}", file=out)
        if not found:
            print("(no matches)", file=out)
        if cut:
            print(f"(truncated to {show} results)", file=out)


def main(argv: list[str] | None = None, out=None) -> int:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    spark = session()
    try:
        if a.command in ("build", "build-multi"):
            if len(a.paths) < 2 or (a.command == "build" and len(a.paths) != 2):
                raise ValueError("usage: build [flags] <input> <index>")
            storage = parse_storage(a.storage, a.external_strategy, a.disk_block_size)
            algorithm, occ = parse_algorithm(a.algo), parse_occ(a.occ)
            corpus = Corpus.from_files(spark, *a.paths[:-1])
            catalog.save(catalog.build(corpus, a.backend, algorithm, occ, storage), a.paths[-1])
            return 0
        index = catalog.load(spark, a.index)
        if a.command == "info":
            print("\n".join(info_lines(index)), file=out)
        elif a.command == "graph":
            if index.backend != "fm":
                raise ValueError("graph command requires an FM-index")
            text = graph.mermaid(suffix.one_shard(index.corpus), index.sa, a.max_nodes, "shard").first()["mermaid"]
            print(f"```mermaid\n{text}```" if a.markdown == "true" else text.rstrip("\n"), file=out)
        elif a.command == "search":
            found, cut = matches(index, a.pattern, a.limit, a.context)
            for pos, snippet in found:
                print(pos if a.positions else f"{pos}: {snippet}", file=out)
            if cut:
                print(f"warning: truncated to {a.limit} results", file=sys.stderr)
        elif a.command == "browse":
            browse(index, a.show, a.context, sys.stdin, out)
        elif a.q is None:
            print(explain.info_json(index.corpus, a.index, index.backend, a.limit, a.context, a.min_chars), file=out)
        else:
            print(explain.search_json(index.corpus, a.q, None, None, a.limit, a.context)[1], file=out)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0



if __name__ == "__main__":
    sys.exit(main())

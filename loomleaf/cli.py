"""Commands over a wiki's folder: python -m loomleaf.cli --root FOLDER COMMAND. Rows are printed as JSON lines."""

from __future__ import annotations

import argparse
import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph, merge, quality, retrieval, state
from .operators import pages as P
from .plans import jobs
from .sources import markdown
from .streaming import ingest, recheck

COMMANDS = {
    "ingest": ("source",), "ingest-folder": ("folder",), "process": ("source",), "extract": ("source",), "register": ("source",), "check": ("source",), "validate": ("--promote",), "link": (), "refine": (), "lint": (), "consolidate": (), "merge": ("primary", "secondary+"), "state": (), "health": (),
    "query": ("question", "--depth", "--top-k", "--no-expand", "--expand-only"), "pack": ("question", "--depth", "--top-k"), "agent-ingest": ("source",), "triage": (), "scaffold": ("title", "--type", "--source", "--force"),
    "draft": ("kind", "--topic", "--audience"), "quality": ("page?",), "coverage": ("source",), "find": ("--tag", "--confidence"), "provenance": ("page",), "rebuild": (), "update-graph": (), "migrate": (), "generate-instructions": (), "log": ("-n",),
    "save-answer": ("question?", "--title", "--type", "--confidence"), "extract-prompt": ("source", "--type"), "recheck": ("action", "--confidence", "--page"),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomleaf")
    top.add_argument("--root", default=".")
    top.add_argument("--now", default=None)
    top.add_argument("--rules", default=None)
    every = top.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        own = every.add_parser(name)
        for a in arguments:
            if a in ("--promote", "--no-expand", "--expand-only", "--force"):
                own.add_argument(a, action="store_true")
            elif a.startswith("-"):
                kind = int if a in ("--depth", "--top-k", "-n") else str
                own.add_argument(a, type=kind, default={"--depth": 2, "--top-k": 5, "-n": 10, "--type": "concept", "--source": "triage:missing-link"}.get(a))
            else:
                own.add_argument(a.rstrip("?+"), nargs=a[-1] if a[-1] in "?+" else None)
    return top


def _source(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(Path(path).name, Path(path).read_text(encoding="utf-8"))], "filename string, text string")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | str | list[str]:
    now = args.now or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    wiki, c = jobs.Wiki(spark, args.root, now, args.rules), args.command
    if c in ("extract", "register"):
        return wiki.register(_source(spark, args.source))
    if c in ("ingest", "process"):
        wiki.register(_source(spark, args.source))
        return wiki.rebuild()
    if c == "ingest-folder":
        ingest.ingest_folder(wiki, args.folder, f"{args.root}/tables/ingest")
        return wiki.manifest().select("filename", "source_type", "content_hash")
    if c == "check":
        return merge.ingested(_source(spark, args.source), wiki.manifest())
    if c == "validate":
        return wiki.promote() if args.promote else wiki.validation()
    if c == "link":
        return graph.missing_reverse(wiki.pages())
    if c == "refine":
        return wiki.refine().orderBy("rank", "task_type", "page")
    if c == "lint":
        return wiki.issues().orderBy("check_ord", "page")
    if c == "consolidate":
        wiki.indexes()
        return merge.by_title(wiki.pages()).unionByName(merge.by_alias(wiki.pages()))
    if c == "merge":
        return wiki.merge(spark.createDataFrame([(s, args.primary) for s in args.secondary], "secondary string, primary string"))
    if c == "state":
        return state.compact(wiki.page_state())
    if c == "health":
        return state.health(wiki.issues()).withColumn("status", state.status(F.col("errors"), F.col("warnings")))
    if c == "query":
        return retrieval.variants(args.question) if args.expand_only else wiki.ask(args.question, args.depth, args.top_k, not args.no_expand)
    if c == "pack":
        return wiki.pack(args.question, args.depth, args.top_k)["pages"].orderBy("reading")
    if c == "agent-ingest":
        text = Path(args.source).read_text(encoding="utf-8")
        near = retrieval.merge_candidates(wiki.pages(), text).agg(F.collect_list(F.struct("stem", "score")).alias("merge_candidates"))
        return state.ingest_plan(_source(spark, args.source)).crossJoin(F.broadcast(near))  # one row each
    if c == "triage":
        return state.triage(wiki.issues(), wiki.page_state()).orderBy(F.desc("score"), "id")
    if c == "scaffold":
        made = state.scaffolded(spark.createDataFrame([(args.title,)], "title string"), wiki.pages(), args.source, args.type, wiki.today, args.force)
        wiki.draft(made)
        return made
    if c == "draft":
        made = state.artifact(wiki.pack(args.topic), args.kind, args.topic, args.audience)
        return made
    if c == "quality":
        scores = wiki.quality()
        return scores.where(F.lower("stem") == args.page.lower()) if args.page else quality.wiki_quality(scores)
    if c == "coverage":
        return wiki.coverage(Path(args.source).name)
    if c == "find":
        return P.find(wiki.pages(), args.tag, args.confidence)
    if c == "provenance":
        return wiki.whole_sidecars().where(F.lower("stem") == args.page.lower())
    if c == "rebuild":
        return wiki.rebuild()
    if c == "update-graph":
        return wiki.update_graph()
    if c == "migrate":
        wiki.migrate(wiki.today)
        return wiki.pages().select("stem", "confidence", "created")
    if c == "generate-instructions":
        return jobs.instructions(wiki.rules)
    if c == "log":
        return markdown.last_log(spark, f"{args.root}/tables/log", args.n)
    if c == "save-answer":
        return wiki.save_answer(args.question, args.title, args.type, args.confidence or "LOW")
    if c == "extract-prompt":
        kind = spark.range(1).select(T.source_type(F.lit(Path(args.source).name))).first()[0]
        return jobs.extraction_prompt(wiki.rules, Path(args.source).name, kind, args.type)
    if args.action == "due":
        return recheck.due(wiki.schedule(), now, wiki.stale(), args.confidence)
    return recheck.summary(wiki.schedule()) if args.action == "summary" else wiki.recheck(args.page)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomleaf").getOrCreate()
    found = run(spark, args)
    if isinstance(found, DataFrame):
        for row in found.toJSON().toLocalIterator():
            print(row)
    else:
        print(found if isinstance(found, str) else "\n".join(found))


if __name__ == "__main__":
    main()

"""``python -m marlstone COMMAND``: list and run queries; build, collate, count, evaluate and cloze (``COMMAND --help`` tells their options)."""

from __future__ import annotations

import argparse

from marlstone import commands
from marlstone.plans import catalog, pipeline
from marlstone.session import local_session


def _names(told: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in told.split(",") if x.strip())


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    parser.add_argument("--log", help="file for the run's log")
    command = parser.add_subparsers(dest="command", required=True)
    command.add_parser("list", help="all queries")
    run = command.add_parser("run", help="a query over a folder of tables")
    run.add_argument("query", choices=sorted(catalog.queries()), metavar="QUERY")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="folder to write Parquet to; without it 20 rows are shown")
    build = command.add_parser("build", help="question and answer pairs of a month, or of all months")
    for name in ("data", "responses", "out"):
        build.add_argument(f"--{name}", required=True)
    for name in ("year", "month"):
        build.add_argument(f"--{name}", type=int)
    build.add_argument("--categories", type=_names, default=())
    build.add_argument("--subcategories", type=_names, default=())
    build.add_argument("--quota", type=int, default=pipeline.Job.quota)
    collate = command.add_parser("collate", help="a tree of pairs as one table")
    count = command.add_parser("count", help="pairs by month and topic, and those over a token limit")
    for p in (collate, count):
        p.add_argument("--root", required=True)
    collate.add_argument("--out", required=True)
    count.add_argument("--tokenizer", default="words", help="words, estimate, or the path of a rank file")
    count.add_argument("--limit", type=int, default=200_000)
    evaluate = command.add_parser("evaluate", help="accuracy of recorded results")
    evaluate.add_argument("--results", required=True)
    evaluate.add_argument("--by", type=_names, default=("model",))
    cloze = command.add_parser("cloze", help="cloze items from recorded attempts")
    for name in ("items", "attempts", "out"):
        cloze.add_argument(f"--{name}", required=True)
    cloze.add_argument("--models", default="{}", help='{"name": {"api": ..., "cutoff": "YYYY-MM-DD"}}')
    cloze.add_argument("--blanks", type=int, default=3)
    cloze.add_argument("--min-words", type=int, default=1)
    cloze.add_argument("--max-words", type=int, default=5)
    return parser


def _job(given: argparse.Namespace) -> pipeline.Job | None:
    if given.year is None and given.month is None and not (given.categories or given.subcategories):
        return None
    if given.year is None or given.month is None:
        raise ValueError("a job needs a year and a month")
    return pipeline.Job(given.year, given.month, given.categories, given.subcategories, given.quota)


def main(args: list[str] | None = None) -> None:
    given = _parser().parse_args(args)
    if given.command == "list":
        for name, f in sorted(catalog.queries().items()):
            print(name, (f.__doc__ or "").split("\n")[0], sep="\t")
        return
    # settings are checked before a session is started
    job = _job(given) if given.command == "build" else None
    settings = pipeline.Cloze(given.blanks, given.min_words, given.max_words) if given.command == "cloze" else None
    if given.command == "cloze":
        commands.Model.read(given.models)
    spark = local_session()
    with commands.run_log(spark, given.log) as log:
        if given.command == "run":
            df = catalog.queries()[given.query](spark, given.data)
            if given.out:
                df.write.mode("overwrite").parquet(given.out)
                return
        elif given.command == "build":
            df = commands.build(spark, given.data, given.responses, given.out, job)
        elif given.command == "collate":
            df = commands.collate(spark, given.root, given.out)
        elif given.command == "count":
            df = commands.count(spark, given.root, given.tokenizer, given.limit)
        elif given.command == "evaluate":
            df = commands.evaluate(spark, given.results, list(given.by))
        else:
            df = commands.cloze(spark, given.items, given.attempts, given.out, settings)
        df.show(20, truncate=60)
        log.info("%s is done", given.command)


if __name__ == "__main__":
    main()

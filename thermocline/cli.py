"""Command line: download, build, analyze, run, replica, query, list."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from thermocline import config
from thermocline.sources import download


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="thermocline", description="Climate-driven energy-demand analytics on Spark.")
    top.add_argument("--config", default="config.toml", type=Path)
    sub = top.add_subparsers(dest="command", required=True)
    get = sub.add_parser("download", help="fetch the raw files")
    get.add_argument("--refresh", action="store_true", help="fetch files that are there already, too")
    get.add_argument("--only", nargs="*", choices=["enso", "climdiv", "retail", "wholesale", "gas"], default=None)
    sub.add_parser("build", help="raw files to checked gold tables")
    sub.add_parser("analyze", help="all result tables from the gold tables")
    sub.add_parser("run", help="build, then analyze")
    made = sub.add_parser("replica", help="write synthetic raw files")
    made.add_argument("--root", default="replica", type=Path)
    made.add_argument("--seed", default=2026, type=int)
    run = sub.add_parser("query", help="run a registered query over a folder of tables and write its rows as Parquet")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("out")
    sub.add_parser("list", help="names of the registered queries")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "download":
        try:
            cfg = config.load(args.config)
        except config.ConfigError as e:
            print(e, file=sys.stderr)
            return 2
        d = cfg.download
        settings = download.Settings(d.timeout_s, d.retries, d.backoff_s, d.workers, d.user_agent)
        download.run(download.plan(cfg.sources, settings), cfg.path("raw"), settings, args.refresh, set(args.only) if args.only else None)
        return 0
    if args.command == "replica":
        from thermocline.sources import replica

        replica.write(replica.build(args.seed), args.root)
        return 0
    if args.command in ("build", "analyze", "run"):
        try:
            cfg = config.load(args.config)
        except config.ConfigError as e:
            print(e, file=sys.stderr)
            return 2
        from thermocline.plans import build
        from thermocline.session import get_session

        spark = get_session()
        if args.command != "analyze":
            build.build(spark, cfg).show(50, False)
        if args.command != "build":
            print("\n".join(build.analyze(spark, cfg, args.config)))
        return 0
    from thermocline.plans import catalogue

    if args.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if args.name not in catalogue.QUERIES:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    from thermocline.session import get_session

    catalogue.QUERIES[args.name](get_session(), args.folder).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

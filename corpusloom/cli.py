"""Command line: run, local, qc, card, shard, merge-stats."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from corpusloom.operators import screen, stats
from corpusloom.plans import builder, config
from corpusloom.session import local_session
from corpusloom.sinks import card, qc_csv


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Builds text corpora with Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("run", help="run a config")
    a.add_argument("config")
    a = sub.add_parser("local", help="a directory to JSON lines")
    a.add_argument("root")
    a.add_argument("out")
    a.add_argument("--quality", choices=screen.MODES, default="off")
    a = sub.add_parser("qc", help="score stored JSON lines")
    a.add_argument("path")
    a.add_argument("--csv")
    a.add_argument("--min-score", type=float, default=screen.MIN_SCORE)
    a = sub.add_parser("card", help="merge card fragments (JSON) into a card")
    a.add_argument("fragments", nargs="+")
    a.add_argument("--title", default="Dataset")
    a = sub.add_parser("shard", help="part a config by the targets of its first source")
    a.add_argument("config")
    a.add_argument("targets", help="a file of one target a line")
    a.add_argument("option")
    a.add_argument("n", type=int)
    a.add_argument("out")
    a = sub.add_parser("merge-stats", help="add statistics of shards (JSON)")
    a.add_argument("files", nargs="+")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "shard":
        rows = [x.strip() for x in Path(args.targets).read_text().splitlines() if x.strip()]
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        for k, c in enumerate(config.shards(config.load(args.config), 0, args.option, rows, args.n), 1):
            (out / f"shard-{k:05d}.json").write_text(json.dumps(config.to_dict(c), indent=2))
        return 0
    spark = local_session()
    if args.command == "run":
        print(json.dumps(builder.run(spark, config.load(args.config)).summary))
    elif args.command == "local":
        c = config.from_dict({"sources": [{"kind": "local_dir", "options": {"root": args.root}}], "sinks": [{"kind": "jsonl", "options": {"path": args.out}}], "quality": {"mode": args.quality}})
        print(json.dumps(builder.run(spark, c).summary))
    elif args.command == "qc":
        raw = spark.read.schema("text string, meta struct<doc_id:string,lang:string,kind:string>").json(args.path).where("text is not null and coalesce(meta.kind, '') not in ('run_header', 'run_summary', 'qc_summary')")
        rows = screen.quality(raw.select("text", "meta.lang", F.coalesce("meta.doc_id", F.sha1(F.encode("text", "UTF-8"))).alias("doc_id")), F.col("lang"))
        rows = screen.quality_decision(rows, args.min_score)
        if args.csv:
            qc_csv(rows, args.csv)
        print(json.dumps(screen.screener_counts(rows, "qc_would_drop", mode="post", value="score").first().asDict()))
    elif args.command == "card":
        rows = spark.read.json(args.fragments, schema="file string, split string, num_examples long, num_bytes long, language array<string>, license array<string>, kinds array<string>")
        print(card.render(card.merge(rows).first(), args.title))
    elif args.command == "merge-stats":
        rows = spark.read.schema("files long, attempted_files long, bytes long, records long, sink_errors long, source_errors long, middleware_errors long, would_drop_records long, by_ext map<string,long>").option("multiLine", True).json(args.files)
        print(stats.merge_runs(rows).toJSON().first())
    return 0


if __name__ == "__main__":
    sys.exit(main())

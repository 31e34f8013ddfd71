"""python -m roadglass.cli list | sync | inspect | build | profile"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .operators import events, profile
from .session import session
from .sources import registry

RAW, REPORT, OUTPUT = "data/raw", "data/interim/source-inventory.json", "data/processed/pedestrian_events.csv"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="roadglass", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    listing = commands.add_parser("list", help="list the registered sources")
    sync = commands.add_parser("sync", help="download sources and write their inventory")
    inspect = commands.add_parser("inspect", help="write the inventory of downloaded sources")
    for p in (listing, sync, inspect):
        p.add_argument("--registry", help="a registry file in place of the built-in one")
    for p in (sync, inspect):
        p.add_argument("--all", action="store_true", help="supporting and context sources too")
        p.add_argument("--report", default=REPORT)
    sync.add_argument("--force", action="store_true", help="download again what is there")
    sync.add_argument("--output-dir", default=RAW)
    inspect.add_argument("--input-dir", default=RAW)
    build = commands.add_parser("build", help="build the event table")
    build.add_argument("--raw-dir", default=RAW)
    build.add_argument("--output", default=OUTPUT)
    report = commands.add_parser("profile", help="profile a delimited file")
    report.add_argument("source")
    report.add_argument("--output")
    report.add_argument("--delimiter")
    report.add_argument("--encoding", default="utf-8-sig")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("roadglass-cli")
    if args.command == "list":
        for s in registry.registry(spark, args.registry).collect():
            print(f"{s['id']}\t{s['role']}\t{s['published']}\t{s['url']}")
    elif args.command == "sync":
        registry.sync(spark, args.output_dir, args.report, include_all=args.all, force=args.force, path=args.registry)
        print(f"Inventory written to {args.report}")
    elif args.command == "inspect":
        chosen = registry.registry(spark, args.registry)
        found = registry.inventory(spark, args.input_dir, chosen if args.all else registry.primary(chosen))
        print(f"Inventory written to {registry.write_report(found, args.report)}")
    elif args.command == "build":
        s = events.build_files(spark, args.raw_dir, args.output)
        print(f"Wrote {s['rows']} events to {s['output']} ({s['valid_coordinate_rows']} with valid coordinates).")
    else:
        payload = json.dumps(profile.profile_file(spark, args.source, args.delimiter, args.encoding), ensure_ascii=False, indent=2)
        if args.output:
            Path(args.output).parent.mkdir(parents=True, exist_ok=True)
            Path(args.output).write_text(payload + "\n", encoding="utf-8")
            print(f"Profile written to {args.output}")
        else:
            print(payload)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

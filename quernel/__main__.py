"""Command line: ``python -m quernel list`` and ``python -m quernel run NAME FOLDER [--out PATH]``."""

from __future__ import annotations

import argparse

from quernel import queries
from quernel.session import session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quernel", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="run one query over the Parquet tables of a folder")
    run.add_argument("name", choices=sorted(queries.queries()), metavar="NAME")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(queries.queries())))
        return
    df = queries.queries()[args.name](session(), args.folder)
    if args.out:
        df.write.parquet(args.out)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()

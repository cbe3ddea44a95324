"""Command line: `python -m voxscribe TEXT` writes the written form; without TEXT every line of standard input, stopping at the first error."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from voxscribe import __version__
from voxscribe.functions.temporal import ORDERS, Context
from voxscribe.plans.candidates import normalize_text


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voxscribe")
    parser.add_argument("text", nargs="?")
    parser.add_argument("--reference", type=dt.datetime.fromisoformat, help="moment that dates are read against")
    parser.add_argument("--timezone")
    parser.add_argument("--date-order", choices=ORDERS)
    parser.add_argument("--resolved", action="store_true", help="dates as ISO values")
    parser.add_argument("--version", action="version", version=__version__)
    a = parser.parse_args(args)
    if a.text is None and sys.stdin.isatty():
        parser.error("give TEXT or lines on standard input")
    context = Context(a.reference, a.timezone, None, a.date_order) if a.reference or a.date_order else None
    memo: dict = {}
    for line in [a.text] if a.text is not None else sys.stdin:
        try:
            out = normalize_text(line.rstrip("\n"), context, memo=memo)
        except Exception as e:
            print(f"voxscribe: {e}", file=sys.stderr)
            return 1
        print(out["resolved_text" if a.resolved else "text"], flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""``python -m factloom.cli [--check] [--mermaid] [--permitted a,b] module:attribute`` - looks at a flow's graph.

Exit codes: 0 fine, 1 the graph is not valid, 2 the flow cannot be found.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from factloom.errors import DefinitionError
from factloom.plans.graph import mermaid, restrict_to_permitted, validate


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("flow", help="module:attribute")
    parser.add_argument("--check", action="store_true")
    parser.add_argument("--mermaid", action="store_true")
    parser.add_argument("--permitted", help="comma-separated capabilities; all if left out")
    args = parser.parse_args(argv)
    try:
        module, _, name = args.flow.partition(":")
        flow = getattr(importlib.import_module(module), name)
        flow = flow() if callable(flow) else flow
    except DefinitionError as e:
        print(f"not valid: {e}", file=sys.stderr)
        return 1
    except (ImportError, AttributeError, ValueError) as e:
        print(f"no such flow: {e}", file=sys.stderr)
        return 2
    permitted = args.permitted.split(",") if args.permitted is not None else None
    nodes = restrict_to_permitted([*flow.operators, *flow.capabilities, *flow.aggregators], permitted)
    if args.check:
        try:
            validate(nodes, flow.types)
        except DefinitionError as e:
            print(f"not valid: {e}", file=sys.stderr)
            return 1
        print("ok")
    if args.mermaid:
        print(mermaid(nodes, flow.types), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m millrace run CONFIG [RESTART] | explain CONFIG | case FOLDER | requirements ROOT TARGET | steps | scaffold NAME TEMPLATE [FOLDER] | version"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from millrace import __version__
    from millrace.operators import requirements
    from millrace.plans import cases, pipeline, scaffold
    from millrace.plans.session import session
    from millrace.plans.steps import STEPS, load

    load()
    match args:
        case ["version"]:
            print(__version__)
        case ["steps"]:
            print(*sorted(STEPS), sep="\n")
        case ["scaffold", name, template]:
            print(scaffold.source(name, template), end="")
        case ["scaffold", name, template, folder]:
            print(scaffold.write(name, template, folder))
        case ["case", folder]:
            status = cases.run_case(session(), folder)
            print(status)
            return int(status == "FAIL")
        case ["requirements", root, target]:
            found, pins, bounds = requirements.resolve(session(), root, target)
            for df in (found, pins, bounds):
                df.show(truncate=False)
            return int(not (pins.isEmpty() and bounds.isEmpty()))
        case ["run", path, *restart] if len(restart) < 2:
            results = pipeline.run(session(), path, *restart, log_folder="logs")
            for r in results:
                print(f"{r.status:10} {r.seconds:8.2f} s  {r.name}")
            return int(any(r.status != "completed" for r in results))
        case ["explain", path]:
            spark = session()
            for target, df in pipeline.compose(spark, pipeline.read_text(spark, path)).sinks().items():
                print(target)
                df.explain("formatted")
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

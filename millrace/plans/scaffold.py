"""A new step's source from a command template.

The template is a command line: ``inputfile`` and ``outputfile`` stand for the step's paths, other
words after a ``-flag`` for parameters, and ``[ … ]`` holds an optional group.
"""

from __future__ import annotations

import shlex
from pathlib import Path

HEAD = '''"""Step {name}: runs an external program."""

from millrace.plans.steps import Context, pipe, step


@step("{name}")
def {function}(ctx: Context, df):
    program = [{program!r}]
'''


def parts(template: str) -> tuple[str, list[tuple[str, str | None, bool]]]:
    """(program, (flag or word, parameter, optional)) of a template."""
    words = shlex.split(template.replace("[", " [ ").replace("]", " ] "))
    out, optional, i = [], False, 1
    while i < len(words):
        word = words[i]
        if word in "[]":
            optional = word == "["
        elif word.startswith("-") and i + 1 < len(words) and words[i + 1] not in "[]" and not words[i + 1].startswith("-"):
            out.append((word, words[i + 1], optional))
            i += 1
        else:
            out.append((word, None, optional))
        i += 1
    return words[0], out


def source(name: str, template: str) -> str:
    """Python source of a registered step."""
    program, found = parts(template)
    body = HEAD.format(name=name, function=name.lower(), program=program)
    for word, parameter, optional in found:
        if word in ("inputfile", "outputfile") or parameter in ("inputfile", "outputfile"):
            continue  # rows come and go through the program's own input and output
        key = parameter or word
        add = f"program += [{word!r}, ctx.params[{key!r}]]" if parameter else (f"program.append({word!r})" if word.startswith("-") else f"program.append(ctx.params[{key!r}])")
        body += f"    if {key!r} in ctx.params:\n        {add}\n" if optional else f"    {add}\n"
    return body + "    return pipe(df.selectExpr(f'cast({df.columns[0]} as string) as value'), program)\n"


def write(name: str, template: str, folder: str) -> Path:
    """Puts the source where the search path finds it: folder/NAME/NAMEPlugin.py, which must not exist."""
    path = Path(folder) / name / f"{name}Plugin.py"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        f.write(source(name, template))
    return path

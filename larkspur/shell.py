"""A shell: statements end with a semicolon; what follows it on the line is dropped."""

from __future__ import annotations

import sys
from typing import TextIO

from larkspur.functions.types import EngineError
from larkspur.session import Session
from larkspur.sources.text import text_lines

PROMPT, MORE = "larkspur> ", "        > "


def run(session: Session, source: TextIO = sys.stdin, out: TextIO = sys.stdout, rows: int = 100) -> None:
    """Reads statements until EXIT, QUIT or the end: SELECT (shows up to ``rows`` rows), CREATE TABLE, LOAD t FROM file, COMPACT t."""
    held = ""
    print(PROMPT, end="", file=out, flush=True)
    for line in source:
        held += line
        if ";" not in line:
            print(MORE, end="", file=out, flush=True)
            continue
        statement, held = held.split(";", 1)[0], ""
        words = statement.split()
        try:
            if len(words) == 1 and words[0].lower() in ("exit", "quit"):
                break
            if len(words) == 4 and words[0].lower() == "load" and words[2].lower() == "from":
                print(f"{session.load(words[1], words[3])} rows loaded", file=out)
            elif len(words) == 2 and words[0].lower() == "compact":
                session.compact(words[1])
                print("table compacted", file=out)
            elif (df := session.sql(statement)) is None:
                print("table created", file=out)
            else:
                print("|".join(df.columns), file=out)
                for r in text_lines(df).limit(rows).collect():
                    print(r["value"], file=out)
        except EngineError as e:
            print(e, file=out)
        print(PROMPT, end="", file=out, flush=True)
    session.close()


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    directory = sys.argv[1] if len(sys.argv) > 1 else "tables"
    run(Session(SparkSession.builder.getOrCreate(), directory, sys.argv[2] if len(sys.argv) > 2 else "catalog.json"))

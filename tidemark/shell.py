"""An interactive shell over a table.

Commands: fill B E, get K, scan [B E], update K V, del K, flush, quit (close, quite).
Words are separated by blanks and quotes are ordinary characters. A range is text,
both ends included. After each command that worked the epoch grows by one.
"""

from __future__ import annotations

import argparse
import re
import sys
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .model import KeyRange, LeveledOptions, TableOptions, included
from .store import Table, open_table

#: Number of arguments that each command takes.
_ARITY = {"fill": (2,), "get": (1,), "scan": (0, 2), "update": (2,), "del": (1,), "flush": (0,), "quit": (0,), "close": (0,), "quite": (0,)}


@dataclass(frozen=True)
class Command:
    """A parsed line."""

    name: str
    arguments: tuple[str, ...]


def parse(line: str) -> Command:
    """A command; ValueError tells what is wrong."""
    words = line.split()
    if not words:
        raise ValueError("no command")
    name, arguments = words[0].lower(), tuple(words[1:])
    if name not in _ARITY:
        raise ValueError(f"unknown command {words[0]}")
    if len(arguments) not in _ARITY[name]:
        raise ValueError(f"{name} takes {' or '.join(map(str, _ARITY[name]))} arguments")
    if name == "fill" and not all(re.fullmatch(r"\d+", a) for a in arguments):
        raise ValueError("fill takes two whole numbers")
    return Command(name, arguments)


class Shell:
    """Runs commands on a table and prints what they give."""

    def __init__(self, table: Table, out=None):
        self.table, self.out, self.epoch = table, out or sys.stdout, 0

    def _say(self, *words) -> None:
        print(*words, file=self.out)

    def run(self, line: str) -> bool:
        """One line; False ends the session. Errors are printed and don't end it."""
        try:
            command = parse(line)
            go_on = self.handle(command)
        except ValueError as e:
            self._say("error:", e)
            return True
        self.epoch += 1
        return go_on

    def handle(self, command: Command) -> bool:
        """One command."""
        a, table = command.arguments, self.table
        if command.name == "fill":
            n = table.fill(int(a[0]), int(a[1]), self.epoch)
            self._say(f"{n} values filled with epoch {self.epoch}")
        elif command.name == "get":
            value = table.get(a[0])
            self._say(f"{a[0]} does not exist" if value is None else f"{a[0]}={value.decode(errors='replace')}")
        elif command.name == "scan":
            keys = KeyRange(included(a[0]), included(a[1])) if a else KeyRange()
            n = 0
            for row in table.scan(keys).toLocalIterator():
                self._say(f"{bytes(row['key']).decode(errors='replace')}={bytes(row['value']).decode(errors='replace')}")
                n += 1
            self._say(f"{n} keys scanned")
        elif command.name == "update":
            found = table.update(a[0], a[1])
            self._say(f"{a[0]} does not exist" if found is None else f"{a[0]}: {found[0].decode(errors='replace')} -> {a[1]}")
        elif command.name == "del":
            table.delete(a[0])
        elif command.name == "flush":
            table.flush()
        else:
            table.close()
            return False
        return True


def main(arguments: list[str] | None = None) -> None:
    """The shell's command line."""
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--path", default="tidemark.db")
    parser.add_argument("--compaction", choices=("none", "simple"), default="none")
    parser.add_argument("--enable-wal", action="store_true")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    options = TableOptions.shell(LeveledOptions() if asked.compaction == "simple" else None, asked.enable_wal)
    import os

    shell = Shell(open_table(spark, os.path.abspath(asked.path) if "://" not in asked.path else asked.path, options))
    shell.table.start_maintenance()
    while True:
        try:
            line = input("tidemark> ")
        except EOFError:
            line = "quit"
        if not shell.run(line):
            return


if __name__ == "__main__":
    main()

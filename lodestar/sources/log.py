"""A log of numbered entries in a folder. An entry is there whole or not at all, and only one writer gets a number."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lodestar.functions.storage import delete, names, put_new, read_text

DIGITS = 20


@dataclass(frozen=True)
class Log:
    spark: SparkSession
    path: str

    def numbers(self) -> list[int]:
        return [int(n[:DIGITS]) for n in names(self.spark, self.path) if len(n) == DIGITS + 5 and n.endswith(".json") and n[:DIGITS].isdigit()]

    def at(self, number: int) -> dict:
        return json.loads(read_text(self.spark, self.name(number)))

    def latest(self) -> tuple[int, dict] | None:
        found = self.numbers()
        return (found[-1], self.at(found[-1])) if found else None

    def put(self, number: int, entry: dict) -> bool:
        """False if another writer has the number."""
        return put_new(self.spark, self.name(number), json.dumps(entry))

    def forget(self, number: int) -> None:
        delete(self.spark, self.name(number))

    def name(self, number: int) -> str:
        return f"{self.path}/{number:0{DIGITS}}.json"

"""Goal boards: schema-tolerant JSON files to normalized rows, and their reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import labels as L

# File names in order of precedence, and the synonyms of every field.
NEW_FILE, LEGACY_FILE = "hedefler.json", "feature-list.json"
MISSION = ("mission", "misyon", "gorev", "görev", "plan")
SCHEMA = ("sema", "şema", "schema")
ROWS = ("features", "hedefler")
STATUS = ("status", "durum")
NAME = ("name", "title", "baslik", "başlık", "goal", "ad")
NOTE = ("evidence", "kanit", "kanıt", "notes", "not", "limitation", "reason", "neden", "engel")
NO_NAME, NO_OBJECT = "<no name>", "<not an object>"

BOARD = "path string, board_schema string, mission string, at int, id string, name string, status_word string, note string"


class BoardError(ValueError):
    """A board that is there but cannot be read."""


def first_text(row: dict, names: tuple[str, ...]) -> str | None:
    """The first of the fields that holds a string, trimmed; a blank one hides those after it."""
    for name in names:
        if isinstance(row.get(name), str):
            return row[name].strip() or None
    return None


def parse(path: str, text: str) -> list[tuple]:
    """Rows of one board; a file that is no board raises."""
    try:
        top = json.loads(text)
    except ValueError as e:
        raise BoardError(f"{path}: not JSON: {e}") from e
    if not isinstance(top, dict):
        raise BoardError(f"{path}: the top is not an object")
    listed = next((top[k] for k in ROWS if k in top), None)
    if not isinstance(listed, list):
        raise BoardError(f"{path}: no list of goals")
    head = (path, first_text(top, SCHEMA), first_text(top, MISSION))
    out = []
    for at, row in enumerate(listed, 1):
        if isinstance(row, dict):
            out.append((*head, at, first_text(row, ("id",)) or f"?{at}", first_text(row, NAME) or NO_NAME, first_text(row, STATUS), first_text(row, NOTE)))
        else:
            out.append((*head, at, f"?{at}", NO_OBJECT, None, None))
    return out or [(*head, None, None, None, None, None)]


def preferred(files: DataFrame) -> DataFrame:
    """Of each folder's board files (path, content) the one to read: the new name if it is there at all."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rank = F.when(name == NEW_FILE, 0).when(name == LEGACY_FILE, 1)
    rows = files.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("folder", folder)
    return rows.groupBy("folder").agg(F.min_by(F.struct("path", "content"), "rank").alias("x")).select("folder", "x.path", "x.content")


def goals(files: DataFrame) -> DataFrame:
    """Normalized goals with their state; unknown and missing status words are unreadable."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in BOARD.split(", ")]
        for part in parts:
            rows = [r for path, content in zip(part["path"], part["content"], strict=True) for r in parse(path, bytes(content).decode("utf-8"))]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"at": "Int32"})

    return files.select("path", "content").mapInPandas(run, BOARD).withColumn("state", F.when(F.col("at").isNotNull(), L.status_of(F.col("status_word"))))


def summary(rows: DataFrame, known_schema: str) -> DataFrame:
    """Per board: counts by state and whether it is green.

    Green asks for at least one goal, all of them done, and no schema tag other than the known one.
    """
    is_goal = F.col("at").isNotNull()
    states = [*L.STATUS_WORDS, L.UNREADABLE]
    valid = F.first("board_schema").isNull() | (F.first("board_schema") == known_schema)
    return rows.groupBy("path").agg(
        F.count_if(is_goal).alias("goals"), *[F.count_if(F.col("state") == s).alias(s) for s in states], valid.alias("schema_valid"),
        (valid & (F.count_if(is_goal) > 0) & (F.count_if(F.col("state") == "done") == F.count_if(is_goal))).alias("green"),
    )


def summary_line(counts: DataFrame) -> DataFrame:
    states = [*L.STATUS_WORDS, L.UNREADABLE]
    return counts.select("path", F.format_string("%d goals · " + " · ".join(f"%d {s}" for s in states), "goals", *states).alias("line"))


def to_json(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """One JSON document per board."""
    listed = rows.where("at IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "id", "name", "state", "status_word", "note"))).alias("list"))
    states = [*L.STATUS_WORDS, L.UNREADABLE]
    body = F.struct("schema_valid", "green", F.struct("goals", *states).alias("counts"), "list")
    return counts.join(listed, "path", "left").select("path", F.to_json(body).alias("json"))


def report(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """One text per board: head, counts, the goals with their states, and those that could not be read."""
    states = [*L.STATUS_WORDS, L.UNREADABLE]
    line = F.concat(F.lit("  "), F.rpad("state", 11, " "), F.rpad("id", 6, " "), F.lit(" "), F.col("name"))
    unread = F.when(F.col("state") == L.UNREADABLE, F.concat(F.lit("  "), F.rpad("id", 6, " "), F.lit(" status word: "), F.coalesce("status_word", F.lit("<none>"))))
    per = rows.groupBy("path").agg(
        F.first("board_schema").alias("schema"), F.first("mission").alias("mission"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", line.alias("line"), unread.alias("unread"))))).alias("list"),
    )
    shown = counts.join(per, "path")
    head = F.concat(F.lit("goal board: "), F.col("path"))
    schema = F.when(F.col("schema").isNotNull(), F.concat(F.lit("schema: "), "schema", F.when(F.col("schema_valid"), "").otherwise(" (unknown: never green)")))
    mission = F.when(F.col("mission").isNotNull(), F.concat(F.lit("mission: "), "mission"))
    told = F.concat(F.format_string("goals: %d (" + " · ".join(f"%d {s}" for s in states) + ")", "goals", *states))
    lost = F.transform(F.filter("list", lambda x: x["unread"].isNotNull()), lambda x: x["unread"])
    more = F.when(F.size(lost) > 0, F.concat(F.format_string("\nunreadable, never green: %d\n", F.size(lost)), F.concat_ws("\n", lost)))
    return shown.select("path", F.concat_ws("\n", head, schema, mission, told, F.lit(""), F.concat_ws("\n", F.transform("list", lambda x: x["line"])), more).alias("report"))

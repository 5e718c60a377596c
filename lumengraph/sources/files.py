"""Which files of a source tree are read, their languages and their texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import paths as P

# Folders that are never read, folders with a leading dot that are, and what is read.
PRUNED = "target node_modules dist build vendor third_party out coverage __pycache__ site-packages venv".split()
KEPT_DOT = (".agents", ".claude")
#: A folder that is left out below one parent alone.
PRUNED_BELOW = ("docs", "diyagramlar")
CODE = "rs ts tsx js jsx mjs cjs mts cts py go java c cpp h hpp".split()
DOCUMENTS = "docx pdf ris csl sqlite".split()
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "py": "python", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "json": "json",
}
FORMAT_VERSION = 1


def extension(path: Column) -> Column:
    return F.regexp_extract(P.file_name(path), r"\.([^.]+)$", 1)


def skipped_dir(name: Column) -> Column:
    """Folders that the walk leaves out."""
    dot = name.startswith(".") & ~name.isin(*KEPT_DOT)
    return dot | name.endswith("-out") | name.startswith("pythoncore-") | name.isin(*PRUNED)


def pruned(path: Column) -> Column:
    """Whether any folder of a relative path is left out."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    below = F.concat(F.lit("/"), path).contains(f"/{PRUNED_BELOW[0]}/{PRUNED_BELOW[1]}/")
    return F.exists(dirs, skipped_dir) | below


def supported(path: Column) -> Column:
    """Files that are read: manifests, skills, code and documents."""
    name = P.file_name(path)
    return (name == "Cargo.toml") | (F.lower(name) == "skill.md") | extension(path).isin(*CODE, *DOCUMENTS)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)])
    return F.element_at(table, extension(path))


def decoded(files: DataFrame) -> DataFrame:
    """`files` with `text`; bytes that are not UTF-8 become the replacement character."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "text": [bytes(c or b"").decode("utf-8", "replace") for c in part["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


class StaleCacheError(RuntimeError):
    """A stored graph of another format: index again."""

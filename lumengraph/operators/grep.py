"""Regex search over lines, file skeletons and call traces.

Patterns run in RE2 over Arrow batches, in time linear in the text whatever the pattern. Letters,
digits and white space (`\\w`, `\\d`, `\\s`) are those of Unicode; word ends (`\\b`) are those of ASCII. An index of
trigrams, made once, tells which texts hold all the literal strings that a pattern asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as _C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import text as T
from lumengraph.runtime import prepare

_WHOLE = re.compile(r"\\[AzZG]")
_UNSUPPORTED = re.compile(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|\\k<")
#: What the short classes stand for, outside and inside brackets.
_CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", "s": r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"}
#: Letters that a letter of another script equals when case is ignored.
_FOLDED = "kKsS"


def _unicode(pattern: str) -> str:
    """The pattern with the short classes spelled out."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        two = pattern[at : at + 2]
        if c == "\\" and len(two) == 2:
            low = two[1].lower()
            if two[1] in _CLASSES:
                out.append(_CLASSES[low] if inside else f"[{_CLASSES[low]}]")
            elif low in _CLASSES and not inside:
                out.append(f"[^{_CLASSES[low]}]")
            else:
                out.append(r"\z" if two == r"\Z" else two)
            at += 2
            continue
        if c == "[" and not inside:
            inside = True
            # A bracket that closes at once is a character of the class.
            more = re.match(r"\[\^?\]?", pattern[at:])[0]
            out.append(more)
            at += len(more)
            continue
        if c == "]":
            inside = False
        out.append(c)
        at += 1
    return "".join(out)


def checked_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for RE2; what RE2 cannot do, such as look-around and back-references, is refused."""
    if _UNSUPPORTED.search(pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern}")
    wanted = f"(?i){_unicode(pattern)}" if ignore_case else _unicode(pattern)
    try:
        pc.match_substring_regex(pa.array([""]), wanted)
    except pa.ArrowInvalid as e:
        raise ValueError(f"not a valid pattern: {pattern}: {e}") from e
    return wanted


def matching(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """`rows` whose text in `column` a checked pattern matches; a null text matches nothing."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pc.fill_null(pc.match_substring_regex(part.column(at), wanted), False))

    prepare(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


def literals(pattern: str, ignore_case: bool = False) -> list[str]:
    """Strings that every match of the pattern holds, in lower case where case is ignored."""
    found: list[str] = []

    def walk(parts, run: str) -> str:  # noqa: ANN001
        for kind, value in parts:
            if kind is _C.LITERAL and not (ignore_case and (value > 127 or chr(value) in _FOLDED)):
                run += chr(value).lower() if ignore_case else chr(value)
                continue
            if kind is _C.SUBPATTERN and not (value[1] or value[2]):
                run = walk(value[3], run)
                continue
            found.append(run)
            run = ""
            if kind in (_C.MAX_REPEAT, _C.MIN_REPEAT) and value[0]:
                found.append(walk(value[2], ""))
        return run

    try:
        found.append(walk(_parser.parse(pattern.replace(r"\z", r"\Z")), ""))
    except (re.error, ValueError):
        return []  # a form that only RE2 knows: nothing is known of its matches
    return [] if re.search(r"\(\?[a-zA-Z-]", pattern) else [x for x in dict.fromkeys(found) if x]


def trigrams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram): the distinct runs of three characters of each text, in lower case; store it to serve many searches."""
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row, text in enumerate(part.column(1)):
                codes = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                if len(codes) >= 3:
                    keys = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])
                    three = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    grams = pa.array([three[k : k + 3] for k in range(0, len(three), 3)], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.full(len(keys), row))), grams], names=["id", "gram"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, gram string")


def candidates(index: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame | None:
    """(id) of texts that hold every trigram of the pattern's literals; None where it has none, so that any text may match.

    Literals beyond ASCII are left out: lower case may change their length.
    """
    grams = {x[k : k + 3] for x in literals(pattern, ignore_case) if x.isascii() for k in range(len(x) - 2)}
    wanted = sorted({g.lower() for g in grams})
    if not wanted:
        return None
    return index.where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("id")


def grep_indexed(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """The same as `grep`, by way of an index of trigrams: other texts are not read."""
    some = candidates(index, pattern, ignore_case)
    rows = docs if some is None else docs.join(some.withColumnRenamed("id", id_col), id_col, "left_semi")
    return grep(rows, id_col, text_col, pattern, ignore_case)


def indexed_text(*columns: str) -> Column:
    """Name, path and body as one text."""
    return F.concat_ws(" ", *columns)


def grep(docs: DataFrame, id_col: str, text_col: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(id, line_no, line) of matching lines, numbered from 1 and trimmed.

    The text is tested before it is split, so that texts without a match cost one scan. A pattern with
    anchors to the whole text's ends means a line's ends and is tested on lines alone.
    """
    wanted = checked_pattern(pattern, ignore_case)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = rows if _WHOLE.search(pattern) else matching(rows, "text", f"(?m){wanted}")
    lines = some.select("id", F.posexplode(T.lines(F.col("text"))).alias("at", "raw"))
    return matching(lines, "raw", wanted).select("id", (F.col("at") + 1).cast("bigint").alias("line_no"), F.trim("raw").alias("line"))


def declarations(nodes: DataFrame, edges: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(name, kind, path, refs, ord) of symbols whose declaration line matches, with the references to each; most referred-to first."""
    shown = nodes.where(F.col("kind") != "File").select("id", "name", "kind", "path", "ord", "search_body")
    hits = matching(shown, "search_body", checked_pattern(pattern, ignore_case))
    refs = edges.join(hits.select(F.col("id").alias("target")).distinct(), "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("refs"))
    rows = hits.join(refs, "id", "left").select("name", "kind", npath(F.col("path")).alias("path"), F.coalesce("refs", F.lit(0)).alias("refs"), "ord")
    return rows.orderBy(F.desc("refs"), "ord")


def npath(path: Column) -> Column:
    """A path with forward slashes."""
    return F.translate(path, "\\", "/")


def skeleton(nodes: DataFrame, wanted: str) -> DataFrame:
    """Symbols of files whose path is or ends with `wanted` (no separator is asked for), in order."""
    target = wanted.replace("\\", "/")
    found = nodes.where(npath(F.col("path")).endswith(target))
    return found.where("kind <> 'File'").select("path", "ord", "kind", "name")


def trace(edges: DataFrame, symbol: str) -> DataFrame:
    """Callers and callees: Calls edges whose one end holds the symbol; an empty symbol matches all."""
    calls = edges.where("relation = 'Calls'")
    callers = calls.where(F.contains("target", F.lit(symbol))).select(F.lit("caller").alias("side"), F.col("source").alias("id"), F.col("target").alias("of"))
    callees = calls.where(F.contains("source", F.lit(symbol))).select(F.lit("callee").alias("side"), F.col("target").alias("id"), F.col("source").alias("of"))
    return callers.union(callees)

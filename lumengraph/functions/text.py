"""Trilingual text functions as Spark columns: folding, normalisation and the tokenizer.

Everything here stays in the JVM. Unicode composition (NFC) has no built-in function, so `nfc`
sends just the rows that may need it through Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators, white space, Arabic marks and the letters that fold together.
SEPARATORS = r"._\-/\\:()\[\]{}<>\"';,"
SPACES = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
MARKS = "[\u064b-\u0652\u0670]"
FOLD_FROM, FOLD_TO = "\u0622\u0623\u0625\u0629\u0649\u0130I\u0131", "\u0627\u0627\u0627\u0647\u064aiii"
TURKISH_FROM, TURKISH_TO = "\u0130I\u0131", "iii"
#: Anything but ranges that composition never changes: what may need it goes through Python.
UNCOMPOSED = (
    r"[^\u0000-\u02ff\u0400-\u0482\u048a-\u0590\u05d0-\u05ea\u0620-\u064a\u2010-\u2027\u20a0-\u20cf"
    r"\u3041-\u3098\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3]"
)
UNCOMPOSED_RE2 = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", UNCOMPOSED)


def nfc(df: DataFrame, column: str) -> DataFrame:
    """`df` with `column` in composed form, in one pass: Arrow finds the rows that may need it, Python sees those alone."""
    at = df.columns.index(column)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(at)
            odd = pc.fill_null(pc.match_substring_regex(texts, UNCOMPOSED_RE2), False)
            if pc.any(odd).as_py():
                composed = pa.array([unicodedata.normalize("NFC", t) for t in texts.filter(odd).to_pylist()], texts.type)
                columns = part.columns
                columns[at] = pc.replace_with_mask(texts, odd, composed)
                part = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
            yield part

    return df.mapInArrow(compose, df.schema)


def lower_each(text: Column) -> Column:
    """Lower case by character: a final sigma is a sigma like any other."""
    return F.lower(F.translate(text, "Σ", "σ"))


def fold_tr(text: Column) -> Column:
    """Turkish i forms become i, then lower case."""
    return lower_each(F.translate(text, TURKISH_FROM, TURKISH_TO))


def normalize(text: Column) -> Column:
    """Arabic marks stripped, Arabic and Turkish forms unified, lower case."""
    marks = "".join(chr(c) for c in (*range(0x64B, 0x653), 0x670))
    # What has no counterpart is deleted. The sigma of `lower_each` goes along: a translation is a pass over all characters.
    return F.lower(F.translate(text, FOLD_FROM + "Σ" + marks, FOLD_TO + "σ"))


def split_camel(text: Column) -> Column:
    """A space before an upper-case letter if a lower-case one came since the last split."""
    gap = rf"[^\p{{IsUppercase}}\p{{IsLowercase}}{SEPARATORS}{SPACES}]*"
    # The look ahead changes no match: it spares most letters the wide class, where neither it nor a capital can follow.
    return F.regexp_replace(text, rf"(\p{{IsLowercase}}(?![a-z ]){gap})(\p{{IsUppercase}})", "$1 $2")


def tokens(text: Column) -> Column:
    """Tokens of a composed text, in order, duplicates kept; those of one byte are dropped.

    Normalisation works by character and leaves separators alone, so the whole text is normalised
    once and cut afterwards.
    """
    # As in `split_camel`, no letter has to be looked for among the separators.
    parts = F.split(normalize(split_camel(F.coalesce(text, F.lit("")))), f"(?![a-z])[{SEPARATORS}{SPACES}]+")
    return F.filter(parts, lambda t: F.octet_length(t) > 1)


def spark_sql_tokens(text: str) -> str:
    """`tokens` as Spark SQL, for functions that a session defines in SQL."""
    cut = SEPARATORS.replace("'", r"\x27") + SPACES
    camel = rf"regexp_replace(coalesce({text}, ''), r'(\p{{IsLowercase}}[^\p{{IsUppercase}}\p{{IsLowercase}}{cut}]*)(\p{{IsUppercase}})', '$1 $2')"
    marks = "".join(chr(c) for c in (*range(0x64B, 0x653), 0x670))
    return f"filter(split(lower(translate(translate({camel}, '{FOLD_FROM + marks}', '{FOLD_TO}'), 'Σ', 'σ')), r'[{cut}]+'), t -> octet_length(t) > 1)"


def words_all_in(query: str, haystack: Column) -> Column:
    """Whether every word of the query is a substring of the folded text."""
    needles = F.filter(F.split(fold_tr(F.lit(query)), f"[{SPACES}]+"), lambda w: w != "")
    return F.forall(needles, lambda w: F.contains(fold_tr(haystack), w))


def lines(text: Column) -> Column:
    """Lines of a text: no empty line after a final newline, and no carriage returns before newlines."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


# The same for DuckDB, for the oracle queries.
_SQL_SPACES = "".join([r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"])
_SQL_SEPARATORS = SEPARATORS.replace("'", "''")


def sql_normalize(text: str) -> str:
    return f"lower(translate(translate(regexp_replace({text}, '{MARKS}', '', 'g'), '{FOLD_FROM}', '{FOLD_TO}'), 'Σ', 'σ'))"


def sql_fold_tr(text: str) -> str:
    return f"lower(translate(translate({text}, '{TURKISH_FROM}', '{TURKISH_TO}'), 'Σ', 'σ'))"


def sql_tokens(text: str) -> str:
    camel = rf"regexp_replace(nfc_normalize(coalesce({text}, '')), '(\p{{Ll}}[^\p{{Lu}}\p{{Ll}}{_SQL_SEPARATORS}{_SQL_SPACES}]*)(\p{{Lu}})', '\1 \2', 'g')"
    parts = f"regexp_split_to_array({camel}, '[{_SQL_SEPARATORS}{_SQL_SPACES}]+')"
    return f"list_filter(list_transform({parts}, lambda t: {sql_normalize('t')}), lambda t: strlen(t) > 1)"

"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the strings of added tokens, which count one each, and what is between them into
chunks: white space and what follows up to the next white space. No token of a byte-level vocabulary
crosses the end of a chunk, so a text's count is the sum over its chunks, and a task works each
distinct chunk out once (it remembers the first `KNOWN` of at most `LONGEST` characters, and as many
words). A chunk is cut into words by the file's own rule; a word's bytes are the symbols of a doubly linked list, and a
heap of adjacent pairs gives the one of lowest rank, leftmost first, until none is left. The word's
count is its symbols less its merges: no identifier is made. A word of n bytes takes O(n log n).

Edge cases: a null text is empty and has no token. Texts of any length are counted whole. Repeated
rows are counted each. Ids and other kept columns of any type pass through untouched; extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import arrow
from lumengraph.runtime import table

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Chunks and words that a worker remembers, each, and their greatest length in characters.
KNOWN, LONGEST = 400_000, 80
# White space of the cutting rule.
_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols undergo: the adjacent pair of lowest rank first, the leftmost of equal ones."""
    end = len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(rank, k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, k, a, b = heapq.heappop(heap)
        right = after[k]
        if right == end or symbols[k] != a or symbols[right] != b:
            continue  # one of the two has been merged away meanwhile
        merges += 1
        symbols[k], symbols[right] = a + b, ""
        after[k] = far = after[right]
        if far < end:
            before[far] = k
            if (rank := ranks.get((symbols[k], symbols[far]))) is not None:
                heapq.heappush(heap, (rank, k, symbols[k], symbols[far]))
        near = before[k]
        if near >= 0 and (rank := ranks.get((symbols[near], symbols[k]))) is not None:
            heapq.heappush(heap, (rank, near, symbols[near], symbols[k]))
    return merges


class Counter(dict):
    """Counts tokens by the vocabulary file at `path`; as a mapping, the counts of chunks seen so far."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, rule = file["model"], file["pre_tokenizer"] or {}
        plain = rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space") and not file["normalizer"]
        marks = file["added_tokens"]
        if model["type"] != "BPE" or not plain or any(m["single_word"] or m["lstrip"] or m["rstrip"] for m in marks):
            raise ValueError(f"{path} is no plain byte-level pair vocabulary")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.words: dict[str, int] = {}
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        strings = sorted((m["content"] for m in marks), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, strings))) if strings else None

    def __missing__(self, chunk: str) -> int:
        count = sum(self.word(word) for word, _ in self.cut(chunk))
        if len(self) < KNOWN and len(chunk) <= LONGEST:
            self[chunk] = count
        return count

    def word(self, word: str) -> int:
        count = self.words.get(word)
        if count is None:
            count = len(word) - merged(list(word), self.ranks)
            if len(self.words) < KNOWN and len(word) <= LONGEST:
                self.words[word] = count
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.marks.split(text) if self.marks else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, _CHUNKS.findall(part))) for part in parts)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, keep: list[str], tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """`keep` columns of `docs` with n_tokens.

    tokenizer: path of a vocabulary file on every machine; None takes the public byte-level one.
    """

    def start():  # noqa: ANN202
        import public_tokenizers

        path = tokenizer or public_tokenizers.path(TOKENIZER)
        if path not in _counters:
            _counters[path] = Counter(path)
        return lambda texts: [list(map(_counters[path].count, texts))]

    return arrow.appended(docs, keep, "n_tokens bigint", start, text)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is longer than the limit."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", size.alias("n_bytes"))
    return count_tokens(docs, ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES: dict[str, str] = {}

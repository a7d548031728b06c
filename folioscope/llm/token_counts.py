"""Token counts by byte-pair merging, without producing identifiers.

A word's symbols stand in a linked list and its adjacent pairs in a heap by
merge rank; the lowest pair is merged until none is left. The count of a word is
its number of bytes minus its merges. Each distinct word is merged once per
worker, as its count is remembered.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm import tokenizing
from folioscope.llm.common import id_text, slices

#: Counts above it are flagged.
LIMIT = 1024


@functools.lru_cache(maxsize=4)
def merge_table(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """The symbol of each byte, and (left, right) -> (rank, merged symbol)."""
    model = tokenizing.vocabulary(path)["model"]
    vocab = model["vocab"]
    of_byte = {b: vocab[c] for c, b in tokenizing.byte_symbols().items()}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[left], vocab[right]] = rank, vocab[left + right]
    return [of_byte[b] for b in range(256)], merges


def merged_length(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols are left once no adjacent pair can merge."""
    n = left = len(symbols)
    heap = []
    find = merges.get
    for i in range(n - 1):
        if found := find((symbols[i], symbols[i + 1])):
            heap.append((found[0], i, found[1]))
    heapq.heapify(heap)
    follows, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        rank, i, merged = heapq.heappop(heap)
        j = follows[i]
        if symbols[i] < 0 or j >= n:
            continue
        found = find((symbols[i], symbols[j]))
        if not found or found[0] != rank:
            continue  # one of the two has merged since
        symbols[i], symbols[j] = merged, -1
        left -= 1
        follows[i] = k = follows[j]
        if k < n:
            before[k] = i
            if found := find((merged, symbols[k])):
                heapq.heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0 and (found := find((symbols[h], merged))):
            heapq.heappush(heap, (found[0], h, found[1]))
    return left


class Counter:
    """Counts the tokens of texts; holds the tables of one worker."""

    def __init__(self, path: str):
        self.path = path
        self.of_byte, self.merges = merge_table(path)
        self.words = tokenizing.WordTable(self.count_piece, sum).words

    def count_piece(self, piece: str) -> int:
        of_byte = self.of_byte
        return merged_length([of_byte[b] for b in piece.encode()], self.merges)

    def count_whole(self, text: str) -> int:
        """Cut at the special string (one token each) and by the library's own pre-tokenizer."""
        cut, symbol = tokenizing.library(self.path).pre_tokenizer.pre_tokenize_str, tokenizing.byte_symbols()
        segments = text.split(tokenizing.END_OF_TEXT)
        total = len(segments) - 1
        for segment in segments:
            for piece, _ in cut(segment) if segment else ():
                total += merged_length([self.of_byte[symbol[c]] for c in piece], self.merges)
        return total

    def count(self, texts: list[str]) -> list[int]:
        look, out = self.words.__getitem__, []
        for text in texts:
            try:
                out.append(sum(map(look, tokenizing.split_words(text))))
            except TypeError:  # no keys, or a key that can't stand alone
                out.append(self.count_whole(text))
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row, in one pass without a shuffle.

    Null and empty texts have no bytes and no tokens; a null id is kept; repeated
    rows give repeated results; an empty table gives no rows. A very long text is
    counted whole. The special string of the tokenizer counts as one token.
    """
    tokenizer = tokenizer or tokenizing.tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for x in slices(batch):
                n = counter(tokenizer).count(x.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [x.column(0), pc.cast(pc.binary_length(x.column(1)), pa.int64()), pa.array(n, pa.int64()), pa.array([y > limit for y in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return id_text(docs, id_col, text_col).mapInArrow(count, schema)

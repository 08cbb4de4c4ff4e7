"""Token counts: heap-and-linked-list byte-pair merging, without emitting identifiers."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .tokenizing import Splitter


def merges_of(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in one word.

    The symbols form a doubly linked list; a heap holds (rank, place) of adjacent pairs. The
    lowest rank, leftmost first, is popped again and again; an entry whose pair has changed
    since it was pushed no longer has that rank and is skipped. O(n log n) for any word length.
    """
    n = len(symbols)
    sym = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    merged = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or sym[i] is None or ranks.get((sym[i], sym[j])) != rank:
            continue
        sym[i] += sym[j]
        sym[j] = None
        after[i] = k = after[j]
        merged += 1
        if k < n:
            before[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return merged


class TokenCounter:
    """Counts the tokens of texts under a byte-pair tokenizer file of the ``tokenizers`` library.

    The file's own normaliser and pre-tokenizer make the words; merging is done here. Counts of
    chunks and words are remembered, ``most`` of each at a time.
    """

    def __init__(self, path: str, most: int = 800_000, longest: int = 64):
        if not path.endswith(".json"):
            raise ValueError(f"only tokenizer files of the tokenizers library (.json) are counted: {path}")
        self.split = Splitter(path)
        model = self.split.spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token"):
            raise ValueError("only plain byte-pair models are counted")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.vocab, self.suffix, self.whole = model["vocab"], model.get("end_of_word_suffix") or "", model.get("ignore_merges")
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.most, self.longest = most, longest

    def word(self, word: str) -> int:
        if (n := self.words.get(word)) is not None:
            return n
        symbols = list(word)
        symbols[-1] += self.suffix
        n = 1 if self.whole and word in self.vocab else len(symbols) - merges_of(symbols, self.ranks)
        if len(word) <= self.longest:
            if len(self.words) >= self.most:
                self.words = {}
            self.words[word] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.word, self.split.words(text))) if text else 0

    def chunk(self, chunk: str) -> int:
        if not self.split.added or not self.split.added.search(chunk):
            return self.plain(chunk)
        total = at = 0
        for m in self.split.added.finditer(chunk):
            total += self.plain(chunk[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(chunk[at:])

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for a null or empty one."""
        total, known = 0, self.chunks
        for c in self.split.cut(text) if text else ():
            n = known.get(c)
            if n is None:
                n = self.chunk(c)
                if len(c) <= self.longest:
                    if len(known) >= self.most:
                        known.clear()
                    known[c] = n
            total += n
        return total


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Return ``id_col, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    One narrow map over the scan, no shuffle; state is a bounded memory of words per worker.
    A null text counts as empty (0 bytes, 0 tokens); null and repeated ids pass through, a row each;
    an empty table gives an empty result; other columns of ``docs`` are not read.
    ``over_limit`` is n_tokens > ``limit``.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]):
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = TokenCounter(tokenizer)
        counter = _COUNTERS[tokenizer]
        for batch in slices(batches, "t"):
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in (t or "" for t in texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    own = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

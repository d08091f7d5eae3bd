"""Token counts by byte-pair merging with a heap and a linked list.

A text becomes symbols (its characters; one that the vocabulary lacks falls back to its UTF-8 bytes), adjacent pairs
that form a piece wait in a heap by rank, the lowest rank (equal ranks: the leftmost) is merged, and the neighbours'
new pairs are pushed. The count is the initial symbols less the merges; no identifiers are made.

A text is first cut where no piece of the vocabulary can reach across: two neighbouring characters that are in no
piece side by side can never be merged. Counts of the segments are kept in a bounded memo for each worker; since
they're a function of the segment, forgetting one costs time only.

Each document is handled alone in Arrow batches: no shuffle. Defined results: a null or empty text has no tokens;
control strings such as ``<s>`` inside a text are plain text, as the library takes them by default; repeated rows are
counted one by one; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import as_text, carried, read_table, restored

LIMIT = 4096
#: Segments that a worker remembers before it forgets them all, and the length of the longest remembered.
MEMO, MEMO_CHARS = 1_000_000, 64
_MARK = "▁"


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ranks(path: str) -> dict[str, int]:
    """Rank of each ordinary piece; pieces with equal scores share one."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [(-m.get_score(i), m.id_to_piece(i)) for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
    order = {s: i for i, s in enumerate(sorted({s for s, _ in plain}))}
    return {piece: order[s] for s, piece in plain}


class Counter:
    """Counts for one vocabulary."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.memo: dict[str, int] = {}
        letters = "A-Za-zÀ-ÖØ-öø-ɏ"
        # Marks that follow a letter in no piece cut cheaply; everything else is cut by the table of pairs.
        after = {p[1] for p in self.pairs if re.match(f"[{letters}]", p[0])}
        safe = "".join(c for c in "\n\t.,;:!?\"%&#*$|+=@()" if c not in after)
        self.cheap = re.compile(f"{_MARK}*[{letters}]+(?=[{re.escape(safe)}{_MARK}]|$)|{_MARK}*[^{_MARK}\n]+|{_MARK}+|\n" if safe else f"{_MARK}*[^{_MARK}]+|{_MARK}+")

    def segments(self, segment: str) -> Iterator[str]:
        start = 0
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in self.pairs:
                yield segment[start:i]
                start = i
        yield segment[start:]

    def merged(self, s: str) -> int:
        """Tokens of a segment: initial symbols less merges."""
        rank, n = self.rank, len(s)
        if s in rank and n < 2:
            return 1
        total = n + sum(len(c.encode("utf-8", "replace")) - 1 for c in s if c not in rank)
        if n < 2:
            return total
        get, bits = rank.get, n.bit_length()
        low = (1 << bits) - 1
        end = list(range(1, n + 1))  # of the symbol that begins here; 0: merged away
        before = list(range(-1, n - 1))
        # An entry packs (rank, first character, characters) into one number, which keeps their order.
        heap = [(r << bits | i) << bits | 2 for i in range(n - 1) if (r := get(s[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry >> bits & low
            j = end[i]
            if not j or j >= n or end[j] - i != entry & low:
                continue  # one of the two has changed since
            k = end[i] = end[j]
            end[j] = 0
            total -= 1
            if k < n:
                before[k] = i
                if (r := get(s[i : end[k]])) is not None:
                    heappush(heap, (r << bits | i) << bits | end[k] - i)
            h = before[i]
            if h >= 0 and (r := get(s[h:k])) is not None:
                heappush(heap, (r << bits | h) << bits | k - h)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for seg in self.cheap.findall(_MARK + text.replace(" ", _MARK)):
            n = memo.get(seg)
            if n is None:
                n = self.merged(seg) if len(seg) <= MEMO_CHARS else sum(map(self.merged, self.segments(seg)))
                if len(seg) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[seg] = n
            total += n
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path or model_file())
        for b in batches:
            texts = [as_text(t) for t in b["t"]]
            n = pd.Series([c.count(t) for t in texts], dtype="int64")
            yield pd.DataFrame({"i": b["i"], "n_bytes": pd.Series([len(t.encode("utf-8", "replace")) for t in texts], dtype="int64"), "n_tokens": n, "over_limit": n > limit})

    flat = docs.select(carried(docs, id_col), docs[text_col].alias("t"))
    return restored(flat.mapInPandas(run, "i string, n_bytes long, n_tokens long, over_limit boolean"), docs, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))

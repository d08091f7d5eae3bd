"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z in lower case, white space made single) and hashed. A line is common on its host (the
``source`` column) if more documents there hold it than the host's limit: ``SHARE`` of the host's documents, but
``MIN_TEXTS`` at least and ``MOST_TEXTS`` at most, so that a boilerplate line of a very large host is found too.
Common lines are taken out; a document that loses more than half of its words is depleted and rejected.

Copying alone never makes a line common. Exact copies count as one document. So do near copies: documents with over
``COPY_SHARE`` of their words in lines over the limit are told apart by the first (by hash) of these lines only, which
near copies share. ``verdicts`` measures whole texts; ``cleaned`` gives the kept documents without their common lines.
A document also fails on the base rules: fewer than 50 words, or most of its words in repeated three-word windows.

Scale: texts are read once, in Arrow batches; what moves is one row (host, line, text) for each distinct line of a
document. Counting is a two-step distinct count with map-side sums. Lines over the limit go back to the documents by a
join in which hot ones, say in a third of all documents, are broadcast, and sums by row are partial before they move. For ``cleaned`` up to ``COMMON_KEYS`` common lines (8 bytes each) are shipped and the texts
stay where they are; beyond that the texts move once, to the hashes of their common lines.

Defined results: a null text has no words and fails the base rules; null hosts are one host; a text of white space
has no lines; lines without words and the other lines of a cleaned text stay as they are; repeated rows are judged one
by one and count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import carried, cut, missing, read_table, restored, spread_join, trimmed

MIN_TEXTS = 20
SHARE = 0.02
MOST_TEXTS = 200
COPY_SHARE = 0.75
#: Common lines that are shipped at most.
COMMON_KEYS = 1 << 20
#: Fixed values of the query's contract.
MIN_WORDS = 50
REPEATED_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text, exact: words are numbered."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    keys = pair[:-1] * len(ids) + a[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : k + n - 2] |= twice
    return int(hit.sum())


def line_hash(words: list[bytes]) -> int:
    """The first eight bytes of the normalised line's MD5, in their order as a signed number."""
    return int.from_bytes(hashlib.md5(b" ".join(words).lower(), usedforsecurity=False).digest()[:8], "big") - (1 << 63)


def without(text: str, hashes: set[int]) -> str:
    """The text without the lines of these hashes."""
    stays = lambda line: not (words := line.encode("utf-8", "replace").split()) or line_hash(words) not in hashes
    return "\n".join(line for line in text.split("\n") if stays(line))


def describe(text: str | None, measured: bool = True) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes and words of the distinct lines. Unless
    ``measured``, only the words and the lines."""
    if text is None:
        return 0, 0, 0, 0, 0, [], []
    raw = text.encode("utf-8", "replace")
    seen, repeated = set(), 0
    lines: dict[int, int] = {}
    total = 0
    for line in raw.split(b"\n"):
        found = line.split()
        if found:
            repeated += line in seen
            seen.add(line)
            h = line_hash(found)
            lines[h] = lines.get(h, 0) + len(found)
            total += len(found)
    if not measured:
        return total, 0, 0, 0, 0, list(lines), list(lines.values())
    chars = len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return total, chars, symbols, repeated, repeated_words(raw.split()), list(lines), list(lines.values())


def base_failed(n_words, n_repeat_words):
    """Of numbers or columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)


def depleted(n_words, removed_words):
    return 2 * removed_words > n_words


_BASE = "i string, host string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, h array<long>, w array<long>"


def _described(measured: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "h", "w"]
        for b in batches:
            out = pd.DataFrame([describe(None if missing(t) else t, measured) for t in b["t"]], columns=names)
            out.insert(0, "i", b["i"].to_numpy())
            out.insert(1, "host", b["host"].to_numpy())
            out.insert(2, "th", b["th"].to_numpy())
            yield out

    return run


def host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), host.cast("string")), F.lit("n"))


def _base(docs: DataFrame, id_col: str, text_col: str, host_col: str, measured: bool) -> DataFrame:
    rows = docs.select(
        carried(docs, id_col), docs[text_col].alias("t"), host_key(docs[host_col]).alias("host"), F.xxhash64(docs[text_col]).alias("th")
    )
    return cut(rows.mapInPandas(trimmed(_described(measured)), _BASE)).withColumn("rid", F.monotonically_increasing_id())


def _lines(base: DataFrame) -> DataFrame:
    """(rid, host, th, n_words, line, words), a row for each distinct line of a row."""
    each = base.select("rid", "host", "th", "n_words", F.explode(F.arrays_zip("h", "w")).alias("x"))
    return each.select("rid", "host", "th", "n_words", F.col("x.h").alias("line"), F.col("x.w").alias("words"))


def _n_lines(base: DataFrame) -> int:
    return base.agg(F.sum(F.size("h"))).first()[0] or 0


def common_lines(base: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE, most_texts: int = MOST_TEXTS) -> DataFrame:
    """(host, line, rows) of the common lines, with the number of rows that hold them."""
    lines = _lines(base)
    part = F.least(F.count_distinct("th") * F.lit(share), F.lit(float(most_texts)))
    limit = base.groupBy("host").agg(F.greatest(F.lit(float(min_texts)), part).alias("limit"))
    # A line found in no more than min_texts texts is under every host's limit: the host join sees few lines.
    counts = lines.groupBy("host", "line").agg(F.count_distinct("th").alias("texts"), F.count("*").alias("rows"))
    over = counts.where(F.col("texts") > min_texts).join(limit, "host").where(F.col("texts") > F.col("limit"))
    over = cut(over.select("host", "line", "limit", "rows", F.col("rows").alias("k")))
    held = spread_join(lines, over, ["host", "line"], "k", _n_lines(base))
    # Rows of documents that may be near copies, by what stands for them.
    group = held.groupBy("rid").agg(F.sum("words").alias("shared"), F.min("line").alias("first"), F.first("n_words").alias("n"))
    copies = group.where(F.col("shared") > F.lit(COPY_SHARE) * F.col("n")).select("rid", "first")
    # A text's hash and a line's hash are told apart by their signs' column.
    told = held.join(copies, "rid", "left").withColumn("own", F.coalesce("first", "th")).withColumn("copy", F.col("first").isNotNull())
    independent = told.groupBy("host", "line", "limit", "rows").agg(F.count_distinct("copy", "own").alias("texts"))
    return independent.where(F.col("texts") > F.col("limit")).select("host", "line", "rows")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_texts: int = MIN_TEXTS,
    share: float = SHARE, most_texts: int = MOST_TEXTS,
) -> DataFrame:
    """(id, host key, text hash, measures, removed_words, n_removed_lines, hashes of the removed lines or null,
    base_failed, kept), one row for each row of ``docs``."""
    base = _base(docs, id_col, text_col, host_col, True)
    common = common_lines(base, min_texts, share, most_texts)
    lost = spread_join(_lines(base), cut(common), ["host", "line"], "rows", _n_lines(base)).groupBy("rid")
    removed = lost.agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("line")).alias("removed"))
    out = base.drop("h", "w").join(removed, "rid", "left")
    for name, value in (("removed_words", F.col("removed_words")), ("n_removed_lines", F.size("removed"))):
        out = out.withColumn(name, F.when(F.col("removed").isNull(), 0).otherwise(value).cast("long"))
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return restored(out.withColumn("kept", ~F.col("base_failed") & ~depleted(F.col("n_words"), F.col("removed_words"))), docs, id_col)


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "n_removed_lines", "kept"
    )


def cleaned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_texts: int = MIN_TEXTS,
    share: float = SHARE, most_texts: int = MOST_TEXTS, common_keys: int = COMMON_KEYS,
) -> DataFrame:
    """The kept rows of ``docs`` with their columns, their texts without common lines."""
    limits = (min_texts, share, most_texts)
    common = cut(common_lines(_base(docs, id_col, text_col, host_col, False), *limits))
    if common.count() > common_keys:
        return _cleaned_by_join(docs, id_col, text_col, host_col, limits)
    found = common.select(F.xxhash64("host").bitwiseXOR(F.col("line")).alias("k")).collect()  # common_keys numbers at most
    keys = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.k for r in found], dtype=np.int64)))

    def one(text: object, host: int) -> tuple[bool, str | None]:
        n, *_, repeats, lines, words = describe(None if missing(text) else text)
        if base_failed(n, repeats):
            return False, None
        own = np.array(lines, dtype=np.int64) ^ np.int64(host)
        at = np.searchsorted(keys.value, own)
        hit = np.zeros(len(own), dtype=bool) if not len(keys.value) else keys.value[np.minimum(at, len(keys.value) - 1)] == own
        if depleted(n, int(np.array(words, dtype=np.int64)[hit].sum())):
            return False, None
        return True, without(text, {h for h, gone in zip(lines, hit, strict=True) if gone}) if hit.any() else None

    @F.pandas_udf("kept boolean, less string")
    def judged(texts: pd.Series, hosts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, h) for t, h in zip(texts, hosts, strict=True)], columns=["kept", "less"])

    names = [f"c{k}" for k in range(len(docs.columns))]
    text, host = (F.col(names[docs.columns.index(c)]) for c in (text_col, host_col))
    # Called nondeterministic, it isn't evaluated a second time for the filter.
    out = docs.toDF(*names).withColumn("_x", judged.asNondeterministic()(text, F.xxhash64(host_key(host)))).where("_x.kept")
    # Only a text that lost lines comes back from Python.
    return out.withColumn(names[docs.columns.index(text_col)], F.coalesce("_x.less", text)).select(*names).toDF(*docs.columns)


def _cleaned_by_join(docs: DataFrame, id_col: str, text_col: str, host_col: str, limits: tuple) -> DataFrame:
    """Equal rows share a verdict, so rows are met by id, host and text's hash."""
    kept = judge(docs, id_col, text_col, host_col, *limits).where("kept")
    found = kept.select(F.col(id_col).alias("k_id"), F.col("host").alias("k_host"), F.col("th").alias("k_th"), F.col("removed").alias("k_removed")).distinct()
    same = docs[id_col].eqNullSafe(F.col("k_id")) & (host_key(docs[host_col]) == F.col("k_host")) & (F.xxhash64(docs[text_col]) == F.col("k_th"))

    @F.pandas_udf("string")
    def strip(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([None if missing(t) else without(t, set(h.tolist())) for t, h in zip(texts, hashes, strict=True)], dtype=object)

    # Texts without common lines aren't sent to Python.
    less = strip(F.when(F.col("k_removed").isNotNull(), F.col(text_col)), F.col("k_removed"))
    return docs.join(found, same).withColumn(text_col, F.coalesce(less, F.col(text_col))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), p AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), tri AS (
  SELECT doc_id, pos, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS t FROM p
  WINDOW s AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri WHERE t IS NOT NULL) x WHERE n >= 2
), covered AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM twice) x GROUP BY doc_id
), raw AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), l AS (
  SELECT doc_id, host, text, line, array_to_string(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id
), lim AS (
  SELECT host, greatest(20.0, least(200.0, count(DISTINCT text) * 0.02)) AS lim FROM d GROUP BY host
), over AS (
  SELECT host, norm, lim FROM (SELECT host, norm, count(DISTINCT text) AS n FROM l GROUP BY host, norm) x JOIN lim USING (host) WHERE n > lim
), held AS (
  SELECT doc_id, host, norm, lim, any_value(text) AS text, sum(words) AS words FROM l JOIN over USING (host, norm) GROUP BY doc_id, host, norm, lim
), copies AS (
  SELECT doc_id, min(md5(norm)) AS first FROM held JOIN (SELECT doc_id, len(words) AS n FROM w) x USING (doc_id)
  GROUP BY doc_id, n HAVING sum(words) > 0.75 * n
), common AS (
  SELECT host, norm FROM held LEFT JOIN copies USING (doc_id) GROUP BY host, norm, lim
  HAVING count(DISTINCT coalesce('c' || first, 't' || md5(text))) > lim
), removed AS (
  SELECT doc_id, sum(words) AS removed_words, count(*) AS n_removed_lines FROM held JOIN common USING (host, norm) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words,
    CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, n_removed_lines,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept
FROM m
"""

"""Main text of web pages.

The text of a host tells what is its own: the words of all its pages are one stream of tokens, whose suffixes, cut to a
number of tokens, are ranked by Spark together. Outside an article, a suffix that starts on pages of different articles, or
on several pages, is a long repeated string, and what such strings cover, menus and notices without marks, is left out.
Inside an article strings may repeat, as shared paragraphs do. There a string is the host's only if half of its articles
have it. Its suffixes start at both ends of a block and where their hash says, and go on to the next such place, so that a
repeated block is covered whole; a page that is mostly covered is a copy of others and stays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import columns as C
from larder.llm import markup
from larder.llm.store import stored

#: Tokens of a repeated string, pages of a host that must have it if their articles don't differ, and the covered share from which a block is left out.
TOKENS, PAGES, COVERED = 8, 3, 0.5
#: Of the suffixes inside an article, one in so many is a place where a string starts; the share of a host's articles that have its own strings.
PLACES, ARTICLES = 16, 0.5

INSIDE = pa.struct([("string", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _inside(words: list[list[str]], of: int, tokens: int, rolling: C.Rolling, over: C.Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of an article's blocks from one chosen place to the end of the suffix at the next: hash, start and end."""
    data, offsets = C.utf8(pa.array([" ".join(w) for w in words], pa.string()))
    starts, ends, first = C.words(data, offsets)
    if len(starts) < tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = over.sums(rolling.between(rolling.sums(data), starts, ends))
    long = np.diff(first) >= tokens
    chosen = C.mix(over.windows(sums, tokens)) % np.uint64(PLACES) == 0
    for k in range(1, tokens):  # those that would go beyond their block
        at = first[1:] - k
        chosen[at[(at >= 0) & (at < len(chosen))]] = False
    heads, tails = first[:-1][long], first[1:][long] - tokens
    chosen[heads] = chosen[tails] = True
    places = np.flatnonzero(chosen)
    block = np.searchsorted(first, places, side="right")
    alone = np.isin(places, heads[heads == tails])
    goes_on = np.append(block[1:] == block[:-1], False)
    start, end = places[goes_on | alone], np.where(goes_on, np.append(places[1:], 0), places)[goes_on | alone] + tokens
    hashes = C.pair(np.full(len(start), of, np.uint64), over.between(sums, start, end))
    return hashes.view(np.int64), start, end


def parsed(pages: DataFrame, tokens: int) -> DataFrame:
    """page_id, url, row, host, article, text if the declared article is all (else null), and text, part and suffixes of blocks.

    A suffix is the hash of the first ``tokens`` tokens from a place in the page's stream of text outside its article;
    ``counts`` says how many tokens of it each block has. ``article`` is the hash of the longest block: pages that have it in
    common may be copies. ``inside`` has the strings of the article, with its host in their hash.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, over = C.Rolling(C.byte_table(41)), C.Rolling()
        names = ["page_id", "url", "row", "host", "article", "text", "blocks", "parts", "counts", "suffixes", "inside"]
        for batch, _, _ in C.slices(batches, "html"):
            articles, texts, blocks, parts, counts, suffixes, inside = [], [], [], [], [], [], []
            hosts = [host(u) for u in batch.column("url").to_pylist()]
            for page, name in zip(batch.column("html").to_pylist(), hosts):
                found = markup.blocks(page or "")
                best = max((p for _, p in found), default=markup.PLAIN)
                # An article is all of the page's text, unless a main element has more beside it.
                declared = best >= markup.MAIN and not (best == markup.ARTICLE and any(p == markup.MAIN for _, p in found))
                texts.append("\n".join(t for t, p in found if p == best) if declared else None)
                least = markup.ARTICLE if best == markup.ARTICLE else markup.MAIN
                words = [t.casefold().split() if p < least else [] for t, p in found]
                longest = max((t.casefold() for t, p in found if p == best), key=len, default="")
                articles.append(zlib.crc32(longest.encode("utf-8", "replace")))
                data, offsets = C.utf8(pa.array([" ".join(w) for w in words], pa.string()))
                starts, ends, first = C.words(data, offsets)
                sums = over.sums(rolling.between(rolling.sums(data), starts, ends))
                suffixes.append(C.mix(over.windows(sums, tokens)).view(np.int64) if len(starts) >= tokens else np.zeros(0, np.int64))
                strings = _inside([t.casefold().split() for t, p in found if p >= least], zlib.crc32(name.encode("utf-8", "replace")), tokens, rolling, over)
                inside.append([dict(zip(("string", "start", "end"), x)) for x in zip(*(a.tolist() for a in strings))])
                counts.append([] if declared else np.diff(first).tolist())
                blocks.append([] if declared else [t for t, _ in found])
                parts.append([] if declared else [p for _, p in found])
            out = [
                batch.column("page_id"), batch.column("url"), batch.column("row"), pa.array(hosts, pa.string()), pa.array(articles, pa.int64()), pa.array(texts, pa.string()),
                pa.array(blocks, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(suffixes, pa.list_(pa.int64())), pa.array(inside, pa.list_(INSIDE)),
            ]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows_ = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("row"), "html")
    return rows_.mapInArrow(rows, f"page_id {kind}, url string, row long, host string, article long, text string, blocks array<string>, parts array<long>, counts array<long>, suffixes array<long>, inside array<struct<string: long, start: long, end: long>>")


def _covered(counts: list[int], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Share of the tokens of each block that the strings from starts to ends cover."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    step = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return C.run_sums(np.cumsum(step[:-1]) > 0, bounds) / np.maximum(counts, 1)


def _host_owned(article: list[str], spans: list[dict] | None) -> list[bool]:
    """Which blocks of an article are the host's: those that its strings cover, unless they cover most of it."""
    if not spans:
        return [False] * len(article)
    counts = [len(t.casefold().split()) for t in article]
    share = _covered(counts, np.array([s["start"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64))
    if share @ np.array(counts) > COVERED * sum(counts):
        return [False] * len(article)
    return (share >= COVERED).tolist()


def _own_text(found: DataFrame, tokens: int) -> DataFrame:
    """Text of pages from their blocks, the places where repeated strings start and, inside an article, their spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, blocks, parts, counts, starts, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "blocks", "parts", "counts", "starts", "spans"))):
                if text is not None:
                    if spans:
                        article = text.split("\n")
                        text = "\n".join(t for t, out in zip(article, _host_owned(article, spans)) if not out)
                    texts.append(text)
                    continue
                at = np.array(starts or [], np.int64)
                share = _covered(counts, at, at + tokens)
                least = markup.MAIN if markup.ARTICLE in parts else markup.PLAIN
                within = markup.ARTICLE if markup.ARTICLE in parts else markup.MAIN
                owned = iter(_host_owned([t for t, p in zip(blocks, parts) if p >= within], spans))
                share = [float(next(owned)) if p >= within else s for p, s in zip(parts, share)]
                own = [t for t, p in zip(blocks, parts) if p >= least]
                kept = [t for t, p, s in zip(blocks, parts, share) if p >= least and s < COVERED]
                texts.append("\n".join(kept or own))  # a page that others repeat whole is text all the same
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = found.schema["page_id"].dataType.simpleString()
    return found.select("page_id", "url", "text", "blocks", "parts", "counts", "starts", "spans").mapInArrow(rows, f"page_id {kind}, url string, text string")


def _spans(found: DataFrame, least_pages: int) -> DataFrame:
    """For every page with any, the spans of its article that half of its host's articles have. Few, so they are stored."""
    inside = found.select("host", "row", "article", F.explode("inside").alias("s")).select("host", "row", "article", "s.*")
    several = inside.groupBy("string").agg(F.count("*").alias("n"), F.min("article").alias("a"), F.max("article").alias("z"))
    several = stored(several.filter((F.col("n") >= least_pages) & (F.col("a") < F.col("z"))).select("string"), "page-strings")
    places = stored(inside.join(several, "string"), "page-places")
    having = places.select("host", "string", "article").distinct().groupBy("host", "string").agg(F.count("*").alias("n"))
    articles = found.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("of"))
    owned = having.join(articles, "host").filter((F.col("n") >= least_pages) & (F.col("n") >= ARTICLES * F.col("of")))
    spans = places.join(owned.select("string"), "string").groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return stored(spans.withColumnRenamed("row", "r"), "page-spans")


def main_text(pages: DataFrame, tokens: int = TOKENS, least_pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null, empty and textless pages have an empty text. A null url, or one without a host, counts as one host of its own
    kind. Rows that repeat count as pages each, of one article. An empty table gives an empty table; other columns are left alone.
    """
    found = stored(parsed(pages, tokens), "page-blocks")
    places = found.select("host", "row", F.col("text").isNull().alias("unmarked"), F.posexplode("suffixes").alias("start", "suffix"))
    once = found.select("host", "article", F.explode(F.array_distinct("suffixes")).alias("suffix"))
    often = once.groupBy("host", "suffix").agg(F.count("*").alias("n"), F.min("article").alias("a"), F.max("article").alias("z")).filter((F.col("n") >= least_pages) | (F.col("a") < F.col("z"))).select(F.col("host").alias("h"), F.col("suffix").alias("s"))
    covered = places.filter("unmarked").drop("unmarked").distinct().join(often, (F.col("host") == F.col("h")) & (F.col("suffix") == F.col("s")))
    covered = covered.groupBy("row").agg(F.collect_set("start").alias("starts")).withColumnRenamed("row", "r")
    spans = _spans(found, least_pages)
    unmarked = found.filter("text is null").join(covered, F.col("row") == F.col("r"), "left").drop("r").join(spans, F.col("row") == F.col("r"), "left")
    declared = found.filter("text is not null").withColumn("starts", F.lit(None).cast("array<int>")).join(spans, F.col("row") == F.col("r"), "left")
    texts = _own_text(declared, tokens).unionByName(_own_text(unmarked, tokens))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))

"""Main text of web pages: a suffix array over the token streams of each host's whole pages, then structure."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cinderframe.session import dealt, written

#: Words that a substring repeated on different pages of a host has at least; words of one suffix array.
RUN, CHUNK_WORDS = 6, 400_000
#: Pages, and share of the host's different pages, that hold a substring of articles before it goes; share of an article that may go.
MANY, MANY_SHARE, MOST = 5, 0.05, 0.5

# Element names of HTML, fixed values.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title", "head"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
MAIN = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NESTED = BLOCK - {"p", "hr", "html", "body", "li", "dd", "dt", "td", "th", "tr"} | {"button"}
# Words in a class, id or role that name something other than the article.
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar",
    "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent",
    "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "comment", "comments", "reply", "replies",
    "disqus", "related", "recommended", "share", "sharing", "social", "widget", "pagination", "search", "contentinfo", "complementary", "dialog",
}
IN_ARTICLE = {"header"}  # names that, inside an article, belong to it

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>]|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]+")


def _hinted(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE and not (in_main and name in IN_ARTICLE):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key == "hidden":
            return True
        if key == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif name not in MAIN | {"body", "html"}:
            parts = set(NAME_PART.findall(value)) & HINTS
            if parts - IN_ARTICLE if in_main else parts:
                return True
    return False


def page_blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """Blocks of a page in order: text, whether an article or main element holds it, whether its structure names it something else.

    Character references are decoded and white space is single. What scripts, styles and other raw elements hold is no text. Unclosed elements
    end with the one around them; a page that breaks off ends what is open.
    """
    page = page or ""
    blocks: list[tuple[str, bool, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # name, starts a main element, is hinted
    parts: list[str] = []
    in_main = aside = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append((text, in_main > 0, aside > 0))

    at = 0
    while at < len(page):
        found = MARKUP.search(page, at)
        if found is None:
            parts.append(page[at:])
            break
        parts.append(page[at : found.start()])
        at = found.end()
        closing, name = found.group(1), (found.group(2) or "").lower()
        if not name:
            continue
        if name in RAW:
            if not closing and not (found.group(3) or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                if name != "head" or end:  # a head that is never closed ends with the first block
                    at = end.end() if end else len(page)
            flush()
            continue
        if name == "br":
            parts.append(" ")
        if name not in BLOCK and name not in NESTED:
            if not closing and name not in ("br", "img", "input", "meta", "link", "wbr") and _hinted(name, found.group(3), in_main > 0):
                flush()
                open_.append((name, False, True))
                aside += 1
            elif closing and any(o[0] == name for o in open_):
                flush()
                while open_:
                    last = open_.pop()
                    in_main -= last[1]
                    aside -= last[2]
                    if last[0] == name:
                        break
            continue
        flush()
        if not closing:
            hinted = _hinted(name, found.group(3), in_main > 0)
            if name in NESTED or hinted:
                open_.append((name, name in MAIN and not aside, hinted))
                in_main += open_[-1][1]
                aside += hinted
        elif any(o[0] == name for o in open_):
            while open_:
                last = open_.pop()
                in_main -= last[1]
                aside -= last[2]
                if last[0] == name:
                    break
    flush()
    return blocks


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at every place among all, by its first `depth` tokens, from prefix doubling; sorting by it gives the suffix array."""
    rank, span = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while span < depth:
        step = min(span, depth - span)
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: len(rank) - step] = rank[step:]
        pair = rank * (len(rank) + 2) + ahead + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span += step
    return rank


def _chunk_stream(frame: pd.DataFrame) -> tuple[list[list[dict]], list[list[list[str]]], np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all pages, those outside articles first, and their words; code, stream and kind of every word.

    A page is two streams, 2 * page outside and 2 * page + 1 inside its articles. Kind is 1 inside, 2 for hinted blocks, else 0.
    """
    press = zstandard.ZstdDecompressor()
    names = ("nth", "text", "main", "hinted")
    pages = [[dict(zip(names, block)) for block in json.loads(press.decompress(body))] for body in frame["body"]]
    blocks = [sorted(page, key=lambda b: b["main"]) for page in pages]
    words = [[b["text"].split() for b in page] for page in blocks]
    flat = [w for page in words for block in page for w in block]
    sizes = [len(w) for page in words for w in page]
    stream = np.repeat(np.array([2 * n + b["main"] for n, page in enumerate(blocks) for b in page], np.int64), sizes)
    kind = np.repeat(np.array([2 if b["hinted"] else int(b["main"]) for page in blocks for b in page], np.int64), sizes)
    held = np.empty(len(flat), object)
    held[:] = flat
    return blocks, words, pd.util.hash_array(held) if flat else np.zeros(0, np.uint64), stream, kind


def _grams(codes: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where RUN words of one stream begin, and 64-bit codes of these words."""
    n = len(codes) - RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(RUN):
        code = code * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    at = np.flatnonzero(stream[:n] == stream[RUN - 1 :])
    return at, code[at].view(np.int64)


def _many(pages: int) -> int:
    return max(MANY, int(np.ceil(MANY_SHARE * pages)))


def _counts(host: str, frame: pd.DataFrame) -> pd.DataFrame:
    """Distinct substrings of RUN words in a chunk of a host: how many pages hold them, and how many outside articles."""
    if not len(frame):
        return pd.DataFrame({"host": np.zeros(0, object), "gram": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "outside": np.zeros(0, np.int64), "opened": np.zeros(0, bool)})
    _, _, codes, stream, kind = _chunk_stream(frame)
    # a token of its own behind each stream, so that no suffix runs on into the next one
    places = np.arange(len(codes)) + np.cumsum(np.diff(stream, prepend=stream[:1]) != 0)
    tokens = np.full(int(places[-1]) + 1 if len(places) else 0, -1, np.int64)
    tokens[places] = np.unique(codes, return_inverse=True)[1]
    gaps = np.flatnonzero(tokens < 0)
    tokens[gaps] = len(tokens) + np.arange(len(gaps))
    at, code = _grams(codes, stream)
    rank = suffix_ranks(tokens, RUN)[places][at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((stream[at], rank))  # the chunk's suffix array, equal substrings by page
    begin = np.flatnonzero(np.diff(rank[order], prepend=-1))
    page, outside = stream[at][order] // 2, stream[at][order] % 2 == 0
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(page) != 0) | (np.diff(rank[order]) != 0)
    opened = np.concatenate([[0], np.cumsum(kind == 0)])
    opened = (opened[at + RUN] > opened[at])[order] if len(at) else np.zeros(0, bool)
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    # within a page the stream outside comes first, so a page is new outside where its first place is
    return pd.DataFrame({"host": np.full(len(begin), host, object), "gram": code[order[begin]], "n": count(new), "outside": count(new & outside), "opened": count(opened) > 0})


def _substrings(key, frame: pd.DataFrame, leads: pd.DataFrame) -> pd.DataFrame:
    """The substrings of a chunk that can matter, of the pages that stand for their content.

    The only chunk of a host knows which do. Of several chunks, one at least has its share of the pages of a substring that many hold.
    """
    frame = frame[frame["row"].isin(leads["code"])]
    found = _counts(key[0], frame)
    if not len(frame):
        return found
    chunks, many = frame["chunks"].iloc[0], _many(frame["pages"].iloc[0])
    return found[_matters(found, many) if chunks == 1 else (found["n"] >= -(-many // chunks)) | (found["outside"] > 0)]


def _counted(key, frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The substrings of one chunk of several that can matter by what any chunk holds."""
    leads, grams = (asked["code"][asked["lead"] == lead].to_numpy() for lead in (True, False))
    found = _counts(key[0], frame[frame["row"].isin(leads)] if len(grams) else frame[:0])
    return found[np.isin(found["gram"].to_numpy(), grams)]


def _matters(found, many):
    return (found["n"] >= many) | found["opened"] & (found["outside"] >= 2)


def _main_texts(key, frame: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
    """page_id, url and text of a chunk's pages: what is left when repeated words and blocks named something else have gone."""
    out = frame[["page_id", "url"]].copy()
    if not len(frame):
        out["text"] = np.zeros(0, object)
        return out
    blocks, words, codes, stream, kind = _chunk_stream(frame)
    at, code = _grams(codes, stream)
    anywhere, outside = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    if len(grams) and len(at):
        grams = grams.sort_values("gram")
        known = grams["gram"].to_numpy()
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[place] == code
        for held, column in ((anywhere, "n"), (outside, "outside")):
            pages = grams[column].to_numpy()[place[hit]]
            for k in range(RUN):
                held[at[hit] + k] = np.maximum(held[at[hit] + k], pages)
    many = _many(frame["pages"].iloc[0])
    gone = (anywhere >= many) | (stream % 2 == 0) & (outside >= 2)
    # articles that would lose most of their words are copies of each other
    article = (stream % 2 == 1) & (kind != 2)
    page = stream // 2
    lost, had = (np.bincount(page[mask], minlength=len(frame)) for mask in (article & gone, article))
    gone &= ~(article & (lost > MOST * had)[page])
    texts, done = [], 0
    for its_blocks, of_page in zip(blocks, words):
        left = []
        for block, its in zip(its_blocks, of_page):
            stays = [w for w, g in zip(its, gone[done : done + len(its)]) if not g]
            done += len(its)
            if stays and not block["hinted"]:
                left.append((block["nth"], " ".join(stays)))
        texts.append("\n".join(t for _, t in sorted(left)))
    out["text"] = texts
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    All blocks of a page enter the token streams of its host. A word goes when a substring of RUN words that covers it is held by at
    least MANY pages and MANY_SHARE of the host's different pages, inside an article or main element too; outside of them two pages
    that hold it outside are enough. An article that would lose more than MOST of its words is a copy of others, not boilerplate, and
    keeps them. Of what is left, blocks named navigation, advert, comment and the like go. Pages of equal content count as one page, so
    copies do not erase each other.

    A host's pages are dealt into chunks of about CHUNK_WORDS words, so a hot host is many tasks; their blocks move once, into a table in
    buckets, which all steps read. The least row of equal pages stands for them in the counts. Each chunk's streams are put
    behind each other and sorted as suffixes; equal neighbours are its repeated substrings. Those that may be on enough pages, as 64-bit
    codes, are counted in all chunks of their host; the counts meet in one aggregate, and what enough pages hold goes back to all chunks.

    A null or empty page has empty text; a null url belongs to a host of its own name; null and repeated ids keep their rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            bodies, kinds, words = [], [], []
            for page in batch.column(2).to_pylist():
                blocks = [(n, *block) for n, block in enumerate(page_blocks(page))]
                data = json.dumps(blocks, ensure_ascii=False).encode(errors="surrogatepass")
                bodies.append(press.compress(data))
                kinds.append(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True))
                words.append(sum(len(text.split()) for _, text, _, _ in blocks))
            columns = [*batch.columns[:2], pa.array(bodies, pa.binary()), pa.array(kinds, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "body", "kind", "words"])

    id_type = rows.schema["page_id"].dataType.simpleString()
    parsed = rows.mapInArrow(parse, f"page_id {id_type}, url string, body binary, kind long, words long")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    parsed = parsed.select("*", F.monotonically_increasing_id().alias("row"), host.alias("host"))
    parsed = written(parsed, "html-blocks")
    filled = parsed.filter("words > 0")
    kinds = written(filled.groupBy("host", "kind").agg(F.min("row").alias("row"), F.sum("words").alias("words")), "html-kinds")
    hosts = kinds.groupBy("host").agg(F.ceil(F.sum("words") / CHUNK_WORDS).alias("chunks"), F.count(F.lit(1)).alias("pages"))
    hosts = written(hosts, "html-hosts")
    chunk = F.pmod(F.xxhash64("row"), "chunks").alias("chunk")
    # ids pass as text, for pandas would make floats of numbers beside a null
    rows = filled.join(hosts, "host").select(F.col("page_id").cast("string").alias("page_id"), "url", "body", "host", "row", "pages", "chunks", chunk)
    rows = dealt(rows, "html-chunks", "host", "chunk")
    leads = kinds.join(hosts, "host").select("host", "chunks", chunk, F.col("row").alias("code"), F.lit(True).alias("lead"))
    kind = "host string, gram long, n long, outside long, opened boolean"
    each_chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    streams = rows.select("host", "chunk", "row", "body", "pages", "chunks")
    held = written(streams.groupBy("host", "chunk").cogroup(leads.groupBy("host", "chunk")).applyInPandas(_substrings, kind), "html-grams")
    wanted = held.join(hosts.filter("chunks > 1"), "host").select("host", "gram", "chunks").distinct()
    wanted = wanted.select("host", "chunks", each_chunk, F.col("gram").alias("code"), F.lit(False).alias("lead"))
    asked = leads.filter("chunks > 1").unionByName(wanted)
    counted = streams.filter("chunks > 1").groupBy("host", "chunk").cogroup(asked.groupBy("host", "chunk")).applyInPandas(_counted, kind)
    grams = counted.unionByName(held.join(hosts.filter("chunks = 1").select("host"), "host", "left_semi"))
    grams = grams.groupBy("host", "gram").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"), F.max("opened").alias("opened"))
    many = F.greatest(F.lit(MANY), F.ceil(F.col("pages") * MANY_SHARE))
    repeated = grams.filter(F.col("n") >= F.when(F.col("opened"), 2).otherwise(MANY)).join(hosts, "host")
    repeated = repeated.filter((F.col("n") >= many) | F.col("opened") & (F.col("outside") >= 2))
    repeated = repeated.select("host", "gram", "n", "outside", each_chunk)
    found = rows.select("page_id", "url", "body", "pages", "host", "chunk").groupBy("host", "chunk").cogroup(repeated.groupBy("host", "chunk"))
    found = found.applyInPandas(_main_texts, "page_id string, url string, text string")
    found = found.withColumn("page_id", F.col("page_id").cast(id_type))
    bare = parsed.filter("words = 0").select("page_id", "url", F.lit("").alias("text"))
    return found.unionByName(bare).withColumn("n_chars", F.length("text").cast("long"))

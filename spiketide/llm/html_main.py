"""Main text of web pages: runs that a host repeats, found by a suffix array, and the markup as a check.

Pages are cut into blocks, and the words of all blocks of a page are its stream.  The streams of a
host are concatenated page after page, a suffix array over them brings equal beginnings
together, and every run of RUN words or more that several distinct pages share is boilerplate.
Unique runs are what the array leaves of a page.  The markup then checks that.  Blocks inside navigation,
headers, footers, asides, forms and the like, or in elements so named by class, id or role, go even if they are unique.
Blocks inside an article (or main) element are its text, and words of it that the array took come back; but where the
array took the whole of it, and leaves at least as many words of plain blocks, it is a teaser and these are the text.
A page without an article keeps what the array leaves of its plain blocks.

A host may have any number of pages.  Arrays are built over parts of bounded size where the pages
lie, whose runs are counted over all parts by three bytes in a bucket.  That misses no repeated run, and the few that it
names are counted again by their whole hash.  Pages whose open text is nearly the same (near copies
by the Jaccard join) are one family, and a run counts the families it stands in.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spiketide.llm import jaccard
from spiketide.llm.frames import Shared, as_schema, map_batches, map_rows
from spiketide.session import stage

RUN = 8  # words; a power of two, so that doubling ends on it
PAGES = 3  # distinct pages of a host, near copies taken as one, that share boilerplate
PART_WORDS = 200_000
PRINT_BITS = 24
BUCKET_CHARS = 32_000_000  # of pages, whose prints are one bucket
LEAST_BUCKETS = 32
MAP_BITS, SLICE_BITS = 30, 20  # a broadcast bitmap and the part of it that a task makes, at most
LOW, SPREAD = (1 << 34) - 1, 0x9E3779B  # the second place of a number in a bitmap; products stay below 2**63
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

# fixed values: elements of HTML by their part in a page
RAW = "script style noscript template textarea iframe svg object canvas title"
CHROME_TAGS = frozenset("nav footer aside form header menu dialog button select label head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice gdpr popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond reply replies discussion "
    "share sharing social newsletter subscribe subscription signup login related widget toolbar pagination pager skip hidden".split()
)
#: parts of a class or id that say where a thing stands or what holds it, as in ad-slot, site-footer, comment-12
PLACE_WORDS = frozenset(
    "slot box list wrap wrapper container bar links link buttons button icons icon item items area section block unit inner outer form "
    "site global primary secondary main top bottom left right row col column panel group".split()
)
#: inside an article these alone name a part of it, like its header element
OWN_WORDS = frozenset("header notice".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_NAMES = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)
CHROME, OPEN, MAIN, WRAPPER, WRAPPED = range(5)  # the last two: chrome that may hold an article, and such an article


def chrome_words(token: str, within: int) -> set[str]:
    """Words of page furniture of a class token or id that consists of such words and places only."""
    parts = set(_NAMES.findall(token))
    found = parts & CHROME_WORDS
    if any(not (p in found or p in PLACE_WORDS or p.isdigit()) for p in parts) or within == MAIN and found <= OWN_WORDS:
        return set()
    return found


def chrome_kind(tag: str, attrs: str, within: int) -> int | None:
    """CHROME, WRAPPER (by class, id or form only), or None for an element that is no page furniture."""
    if tag == "header" and within == MAIN:
        return None  # the header of an article has its title
    if tag in CHROME_TAGS and tag != "form":
        return CHROME
    kind = WRAPPER if tag == "form" else None
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words = set().union(*(chrome_words(t, within) for t in value.split()))
            if words & {"comment", "comments"} and tag not in ("body", "html", "main") and (tag != "article" or name == "class"):
                return CHROME
            if words and tag not in ("body", "html", "article", "main"):
                kind = WRAPPER
        elif name == "role" and value in CHROME_ROLES:
            if value != "form":
                return CHROME
            kind = WRAPPER
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return CHROME
    return kind


def resolved(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Only CHROME, OPEN and MAIN: wrapped articles are the text of a page that has no other and no more open words."""
    words = [0] * 5
    for k, t in blocks:
        words[k] += t.count(" ") + 1
    wrapped = MAIN if not words[MAIN] and words[WRAPPED] >= words[OPEN] else CHROME
    return [(wrapped if k == WRAPPED else CHROME if k == WRAPPER else k, t) for k, t in blocks]


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block that has words, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []

    def flush() -> None:
        if held:
            if words := "".join(held).split():
                out.append((stack[-1][1] if stack else OPEN, " ".join(words)))
            held.clear()

    for m in _TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            held.append(html.unescape(text))
            continue
        if (tag := m["tag"]) is None:
            if m["raw"] is None:
                continue
            held.append(" ")
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t not in INLINE for t, _ in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if tag in VOID or m["attrs"].endswith("/") and tag not in ("article", "main", "div", "p", "section", "nav", "footer", "header", "aside", "form"):
            continue
        kind = stack[-1][1] if stack else OPEN
        if kind != CHROME:
            inside = kind in (MAIN, WRAPPED)
            if (found := chrome_kind(tag, m["attrs"], MAIN if inside else kind)) is not None:
                if tag in INLINE:
                    flush()
                kind = CHROME if inside else found
            elif tag in ("article", "main") or "main" in m["attrs"].lower() and re.search(r"\brole\s*=\s*[\"']?main\b", m["attrs"], re.I):
                kind = WRAPPED if kind in (WRAPPER, WRAPPED) else MAIN
        stack.append((tag, kind))
    flush()
    return resolved(out)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def stream_of(blocks: list[tuple[int, str]]) -> str:
    """The text of a page, a line for each block."""
    return "\n".join(t for _, t in blocks)


def salt_of(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host)


def key_of(stream: str, salt: int) -> int:
    """Equal streams of a host are one distinct page."""
    return xxhash.xxh3_64_intdigest(stream, salt) >> 1


@cache
def weights(power: int) -> np.ndarray:
    """Weights of the first 2**power places of a word."""
    x = np.arange(1, (1 << power) + 1, dtype="u8") * _FACTOR
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def tokens_of(stream: str, salt: int = 0) -> np.ndarray:
    """Hashes of the words, and of a mark at the end of each block; with the salt of a host they are its own."""
    data = np.frombuffer(stream.replace("\n", " \x00 ").encode(), "u1")
    space = data == 0x20
    start = np.concatenate([[0], np.flatnonzero(space) + 1])
    size = np.diff(np.concatenate([start, [len(data) + 1]]))
    place = np.arange(len(data) + 1) - np.repeat(start, size)
    weighed = np.zeros(len(data) + 1, "u8")  # each word with the space after it, which weighs nothing
    weighed[:-1] = weights(int(size.max()).bit_length())[place[:-1]] * (data + np.uint64(1)) * ~space
    x = np.add.reduceat(weighed, start)
    return (x ^ (x >> np.uint64(32))) * _FACTOR ^ np.uint64(salt)


def windows(tokens: np.ndarray) -> np.ndarray:
    """One hash for each run of RUN tokens."""
    n = len(tokens) - RUN + 1
    x = np.zeros(max(n, 0), "u8")
    for k in range(RUN):
        x = (x ^ (x >> np.uint64(31))) * _FACTOR + tokens[k : k + n] if n > 0 else x
    return x


def owned_runs(parts: list[np.ndarray], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct run of the streams' tokens with each owner of a stream it stands on, by a suffix array over all; equal runs are neighbours.

    Ranks of suffixes double their reach until it is RUN tokens; in the order
    of the ranks equal runs are neighbours, and the changes of owner among them are what is returned.
    """
    owner = np.repeat(owners, [len(p) for p in parts])
    text = np.concatenate(parts)
    end = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    rank = np.unique(text, return_inverse=True)[1].astype("i8") + 1
    reach = 1
    while reach < RUN:
        at = np.arange(len(text)) + reach
        after = np.where(at < end, rank[np.minimum(at, len(text) - 1)], 0)  # 0: the stream ends before
        rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1].astype("i8") + 1
        reach *= 2
    suffixes = np.lexsort((owner, rank))
    suffixes = suffixes[suffixes + RUN <= end[suffixes]]
    if not len(suffixes):
        return np.empty(0, "i8"), np.empty(0, "i8")
    new_run = np.concatenate([[True], np.diff(rank[suffixes]) != 0])
    first = np.flatnonzero(new_run | np.concatenate([[True], np.diff(owner[suffixes]) != 0]))
    return windows(text)[suffixes[first]].view("i8"), owner[suffixes[first]]


def first_of_each(runs: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours begins."""
    return np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.empty(0, "i8")


def repeated_runs(streams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct run of the streams, and on how many of them it stands."""
    runs, _ = owned_runs([tokens_of(s) for s in streams], np.arange(len(streams)))
    begin = first_of_each(runs)
    return runs[begin], np.diff(np.concatenate([begin, [len(runs)]]))


def unique_text(open_lines: list[int], stream: str, repeated: set[int], salt: int = 0) -> str:
    """The open lines of a stream without the words that a repeated run covers where they stand."""
    hit = windows(tokens_of(stream, salt)).view("i8")
    covered = np.zeros(len(hit) + RUN, "i4")
    for k in np.flatnonzero(np.isin(hit, np.fromiter(repeated, "i8", len(repeated)))):
        covered[k : k + RUN] = 1
    out, at, wanted = [], 0, set(open_lines)
    for number, line in enumerate(stream.split("\n")):
        words = line.split(" ")
        if number in wanted:
            left = [w for k, w in enumerate(words) if at + k >= len(covered) or not covered[at + k]]
            if left:
                out.append(" ".join(left))
        at += len(words) + 1
    return "\n".join(out)


def text_of(blocks: list[tuple[int, str]], salt: int, repeated: list[int] | None) -> str:
    """What the host's repeated runs leave of a page, checked by its markup."""
    lines = {kind: [i for i, (k, _) in enumerate(blocks) if k == kind] for kind in (OPEN, MAIN)}
    whole = {kind: "\n".join(blocks[i][1] for i in held) for kind, held in lines.items()}
    left = whole
    if repeated:
        stream, runs = stream_of(blocks), set(repeated)
        left = {kind: unique_text(held, stream, runs, salt) if held else "" for kind, held in lines.items()}
    if not lines[MAIN]:
        return left[OPEN]
    if not left[MAIN] and len(left[OPEN].split()) >= len(whole[MAIN].split()):
        return left[OPEN]
    return whole[MAIN]


def prints(pages: DataFrame, buckets: int) -> DataFrame:
    """(bucket, prints): by a suffix array of each part, PRINT_BITS of each run, as often as it has pages of the part, PAGES times at most."""
    schema = as_schema("bucket long, prints binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[str, np.ndarray]] = {}
        words = 0

        def part() -> pa.RecordBatch:
            tokens = [t for _, t in sorted(held.values(), key=lambda x: x[0])]  # host after host
            runs, _ = owned_runs(tokens, np.arange(len(tokens)))
            begin = first_of_each(runs)
            pages = np.minimum(np.diff(np.concatenate([begin, [len(runs)]])), PAGES)
            codes = np.sort(np.repeat(coded(runs[begin], buckets), pages))
            bucket = codes >> np.uint64(PRINT_BITS)
            found, at = np.unique(bucket, return_index=True)
            low = codes.astype("<u8").view("u1").reshape(-1, 8)[:, : PRINT_BITS // 8]
            rows = [low[i:j].T.tobytes() for i, j in zip(at.tolist(), [*at.tolist()[1:], len(codes)])]
            return pa.RecordBatch.from_arrays([pa.array(found.astype("i8")), pa.array(rows, pa.binary())], names=["bucket", "prints"])

        for batch in batches:
            for url, page in zip(*(c.to_pylist() for c in batch.columns)):
                stream = stream_of(blocks_of(page))
                host = host_of(url)
                salt = salt_of(host)
                key = key_of(stream, salt)
                if stream and key not in held:
                    held[key] = host, tokens_of(stream, salt)
                    words += len(held[key][1])
                if words >= PART_WORDS:
                    yield part()
                    held.clear()
                    words = 0
        if held:
            yield part()

    return map_batches(pages, run, schema)


def coded(runs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and print of each run."""
    runs = runs.view("u8")
    bits = np.uint64(PRINT_BITS)
    return (runs >> bits) % np.uint64(buckets) << bits | runs & np.uint64((1 << PRINT_BITS) - 1)


def common_codes(printed: DataFrame) -> DataFrame:
    """(code): bucket and print of the runs that may stand on PAGES pages; all that do are among them."""

    def one_bucket(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, "u1").reshape(PRINT_BITS // 8, -1).astype("i8") for p in table["prints"].to_pylist()]
        found, pages = np.unique(np.concatenate([sum(plane << 8 * k for k, plane in enumerate(p)) for p in parts]), return_counts=True)
        return pa.table({"code": found[pages >= PAGES] + (table["bucket"][0].as_py() << PRINT_BITS)})

    return printed.groupBy("bucket").applyInArrow(one_bucket, "code long")


class Bitmap:
    """Numbers that may be in a set: all of it, and few others."""

    def __init__(self, bits: int, slices: dict[int, bytes]):
        size = 1 << min(bits, SLICE_BITS)
        self.mask = np.uint64((1 << bits) - 1)
        self.held = np.concatenate([np.frombuffer(slices.get(k, bytes(size // 8)), "u1") for k in range((1 << bits) // size)])

    def has(self, numbers: np.ndarray) -> np.ndarray:
        numbers = numbers.view("u8")
        found = self.at(numbers & self.mask)
        found[found] = self.at(second_place(numbers[found]) & self.mask)
        return found

    def at(self, places: np.ndarray) -> np.ndarray:
        return (self.held[places >> np.uint64(3)] >> (places & np.uint64(7)).astype("u1") & 1).astype(bool)


def second_place(numbers: np.ndarray) -> np.ndarray:
    return (numbers & np.uint64(LOW)) * np.uint64(SPREAD) >> np.uint64(16)


def bitmap(numbers: DataFrame) -> Shared:
    """The bitmap of a column of evenly spread numbers, two of 16 bits for each up to MAP_BITS in all."""
    (column,), spark = numbers.columns, numbers.sparkSession
    bits = min(MAP_BITS, max(10, (16 * numbers.count()).bit_length()))
    size = 1 << min(bits, SLICE_BITS)

    def one_slice(table: pa.Table) -> pa.Table:
        at = table["at"].to_numpy()
        flags = np.zeros(size, "u1")
        flags[at % size] = 1
        return pa.table({"slice": pa.array([int(at[0]) // size], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    number, mask = F.col(column), F.lit((1 << bits) - 1)
    second = F.shiftright(number.bitwiseAND(F.lit(LOW)) * F.lit(SPREAD), 16)
    placed = numbers.select(F.explode(F.array(number.bitwiseAND(mask), second.bitwiseAND(mask))).alias("at")).distinct()
    slices = placed.groupBy(F.floor(F.col("at") / size).alias("slice")).applyInArrow(one_slice, "slice long, bits binary")
    return Shared(spark, (bits, {r.slice: bytes(r.bits) for r in slices.collect()}), Bitmap)


def families(streams: DataFrame) -> DataFrame:
    """(key, family): pages whose texts are near copies, or near copies of such, have one family."""
    texts = streams.filter("open <> ''").select("key", "open").distinct()
    return jaccard.similar(texts, "key", "open").select("key", F.col("component_id").alias("family")).distinct()


def met_runs(pages: DataFrame) -> DataFrame:
    """(key, run, host): runs of each distinct page that may be boilerplate.

    A page with plain blocks has one more row, without a run, with its host if it has no article.
    """
    chars = pages.agg(F.sum(F.length(pages.columns[1])).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    common = bitmap(stage(common_codes(prints(pages, buckets))))

    def start():
        codes = common.get()

        def row(url: str | None, page: str | None) -> Iterator[tuple]:
            blocks, host = blocks_of(page), host_of(url)
            stream, salt = stream_of(blocks), salt_of(host)
            key = key_of(stream, salt)
            runs = windows(tokens_of(stream, salt))
            for run in set(runs[codes.has(coded(runs, buckets))].view("i8").tolist()):
                yield key, run, None
            if plain(blocks):
                yield key, None, host if bare(blocks) else None

        return row

    return stage(map_rows(pages, "key long, run long, host string", start, rows=4096).distinct())


def plain(blocks: list[tuple[int, str]]) -> bool:
    """Whether the page has words that the markup neither takes nor gives, so that the array decides."""
    return any(k == OPEN for k, _ in blocks)


def bare(blocks: list[tuple[int, str]]) -> bool:
    return plain(blocks) and not any(k == MAIN for k, _ in blocks)


def boilerplate(pages: DataFrame, met: DataFrame) -> DataFrame:
    """(key, runs): the runs of each distinct page that PAGES or more families of pages of its host share."""
    runs = met.filter("run is not null").select("key", "run")
    hosts = met.filter("run is null and host is not null").select("host").distinct()
    owned = runs.withColumn("family", F.col("key"))
    if not hosts.isEmpty():  # elsewhere the markup brings back what versions of an article take from each other

        def start():
            def row(url: str | None, page: str | None) -> Iterator[tuple]:
                blocks, host = blocks_of(page), host_of(url)
                kind = OPEN if bare(blocks) else MAIN
                yield host, key_of(stream_of(blocks), salt_of(host)), "\n".join(t for k, t in blocks if k == kind)

            return row

        texts = stage(map_rows(pages, "host string, key long, open string", start).join(hosts, "host"))
        owned = runs.join(families(texts), "key", "left").withColumn("family", F.coalesce("family", "key"))
    shared = owned.groupBy("run").agg(F.count_distinct("family").alias("n")).filter(F.col("n") >= PAGES).select("run")
    return runs.join(shared, "run").groupBy("key").agg(F.collect_list("run").alias("runs"))  # no more than the page has words


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of each page, blocks joined by one newline.

    A null or empty page has an empty text; a null url is a host of its own;
    null ids and repeated rows stay (copies and near copies count as one page of their host); an empty
    table gives an empty one; other columns are not read.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    head = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}"
    source = pages.select(id_col, url_col, html_col)
    pages = pages.select(url_col, html_col)
    met = met_runs(pages)
    runs = stage(boilerplate(pages, met))
    repeating = bitmap(runs.select("key"))

    def opened(url: str | None, page: str | None) -> tuple[list[tuple[int, str]], int, int]:
        blocks, salt = blocks_of(page), salt_of(host_of(url))
        return blocks, salt, key_of(stream_of(blocks), salt)

    def settled():
        repeats = repeating.get()

        def row(key, url: str | None, page: str | None) -> Iterator[tuple]:
            blocks, salt, at = opened(url, page)
            if not (repeats.has(np.array([at])).any() and plain(blocks)):  # the array takes nothing, or only what the markup decides
                yield key, url, text_of(blocks, salt, None)

        return row

    def unsettled():
        repeats = repeating.get()

        def row(key, url: str | None, page: str | None) -> Iterator[tuple]:
            blocks, _, at = opened(url, page)
            if repeats.has(np.array([at])).any() and plain(blocks):
                yield key, url, at, bytes(k for k, _ in blocks), stream_of(blocks)

        return row

    def judged():
        def row(key, url: str | None, kinds: bytes, stream: str, runs: list[int] | None) -> Iterator[tuple]:
            blocks = list(zip(kinds, stream.split("\n")))
            yield key, url, text_of(blocks, salt_of(host_of(url)), runs)

        return row

    sure = map_rows(source, f"{head}, text string", settled)
    if met.filter("run is null").isEmpty():  # no page has plain blocks
        return sure
    moved = map_rows(source, f"{head}, _key long, _kinds binary, _stream string", unsettled)
    joined = moved.join(runs.select(F.col("key").alias("_key"), F.col("runs").alias("_runs")), "_key", "left")
    joined = joined.select(id_col, url_col, "_kinds", "_stream", "_runs")
    return sure.union(map_rows(joined, f"{head}, text string", judged))

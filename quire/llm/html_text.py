"""Main text of web pages: a suffix array of each host's token streams finds what its pages repeat.

A page is read into blocks of text with the elements they stand in. Blocks inside an article (or main) element are the main text and stay whole,
as whoever repeats an article repeats main text. All other blocks of every page, menus, adverts and footers among them, go into the token streams of
their host, side by side: a suffix array over the tokens with its longest common prefixes lists every run of at least `MIN_RUN` tokens (or a whole
block) that distinct pages share, and a block that such runs cover is dropped as boilerplate. What is not repeated goes by its markup: menus, headers,
footers, sidebars, forms, adverts, notices and comments are left out, other unique blocks stay.
A host's pages are dealt to shards of bounded size, so a host with very many pages is no single task. A run that stands in two shards stands on
two pages: such runs are found by keys of all runs and given to the shards that hold them, so sharding doesn't change the texts.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_slices

MIN_RUN, COVERED = 8, 0.5
#: Characters of a shard and of a task; the texts depend on neither.
SHARD_CHARS, TASK_CHARS, BROADCAST_HOSTS = 4 << 20, 64 << 20, 1 << 19

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<|[^<]+", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRS = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_SPACE = re.compile(r"\s+")

#: Elements of HTML by what they are here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
CHROME = frozenset("nav header footer aside form menu dialog script style noscript iframe template head title select button svg canvas object audio video textarea xmp noembed noframes".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of class, id and role names that mark a part which is no main text: as the last word of a name, ...
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup popup modal widget masthead pagination toolbar search complementary contentinfo".split())
#: ... as the first one (ad-slot, comment-list), ...
CHROME_FIRST = frozenset("ad ads advert advertisement cookie cookies gdpr comment comments disqus nav navbar breadcrumb breadcrumbs sidebar footer newsletter social share sponsored promo".split())
#: ... but not behind these (no-sidebar).
NOT_MARKED = frozenset("no not non without with has hide".split())
_NAME_WORD = re.compile(r"[a-z]+")


def _marked(tag: str) -> bool:
    """Whether a tag's attributes say that it is hidden or no main text. Names are judged one by one: related marks a part, related-work doesn't."""
    for name, value in _ATTRS.findall(tag):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in value.lower()):
            return True
        if name in ("class", "id", "role"):
            for one in value.strip("\"'").lower().split():
                words = _NAME_WORD.findall(one)
                if words and words[0] not in NOT_MARKED and (words[-1] in CHROME_WORDS or words[0] in CHROME_FIRST):
                    return True
    return False


OUTSIDE, MAIN_TEXT, MARKED = 0, 1, 2


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block that a reader could see, in order: MARKED where the markup says it is no main text, MAIN_TEXT inside a main element,
    else OUTSIDE. References are decoded, white space is one blank. Scripts, styles and the head are no blocks."""
    page = page or ""
    open_: list[tuple[str, bool, bool, bool]] = []  # name, chrome, main, unseen
    chrome = main = unseen = 0
    held: list[str] = []
    aside: list[str] = []  # marked text, which may stand in the middle of a block
    out: list[tuple[str, int]] = []
    raw: str | None = None

    def close() -> None:
        for parts, kind in ((held, MAIN_TEXT if main else OUTSIDE), (aside, MARKED)):
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append((text, kind))

    def pop(name: str) -> None:
        nonlocal chrome, main, unseen
        if not any(x[0] == name for x in open_):
            return
        while open_:
            last = open_.pop()
            chrome -= last[1]
            main -= last[2]
            unseen -= last[3]
            if last[0] == name:
                break

    for token in _TOKEN.findall(page):
        if raw is not None:
            if token[:2] == "</" and (m := _NAME.match(token)) and m[1].lower() == raw:
                raw = None
                pop(m[1].lower())
            continue
        if token[0] != "<" or not (m := _NAME.match(token)):
            if (token[0] != "<" or token == "<") and not unseen:
                (aside if chrome else held).append(html.unescape(token))
            continue
        name = m[1].lower()
        if token[1] == "/":
            if name in BLOCK or name in CHROME:
                close()
            pop(name)
            continue
        is_main = name in MAIN
        # an article inside an article may be a comment or an advert; the outermost one is by its name alone
        is_chrome = name in CHROME or (name not in ("html", "body") and (not is_main or main > 0) and _marked(token))
        if name in BLOCK or name in CHROME:
            close()
        if name in VOID or token.endswith("/>"):
            if name == "br" and not unseen:
                (aside if chrome else held).append(" ")
            continue
        if name == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            # an open element of the same kind ends here
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    pop(name)
                    break
                if open_[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "body"):
                    break
        is_unseen = name in RAW or name == "head"
        open_.append((name, is_chrome, is_main, is_unseen))
        chrome += is_chrome
        main += is_main
        unseen += is_unseen
        if name in RAW:
            raw = name
    close()
    return out


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of a token stream: its suffixes sorted, and how many tokens each shares with the one before it (0 for the first).

    Prefix doubling; two suffixes' common prefix is read from the ranks of all widths, from the widest down. A suffix that ends is below all others.
    """
    n = len(stream)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = [np.unique(stream, return_inverse=True)[1].astype(np.int64)]
    while ranks[-1].max() < n - 1 and (1 << (len(ranks) - 1)) < n:
        rank, width = ranks[-1], 1 << (len(ranks) - 1)
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        ranks.append(np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(ranks[-1], kind="stable")
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        padded = np.append(ranks[k], -1)
        same = np.flatnonzero((a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]))
        lcp[same + 1] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def repeated(streams: list[np.ndarray], run: int = MIN_RUN) -> list[np.ndarray]:
    """For each stream of token numbers, which tokens lie in a run of at least `run` tokens that another stream has too."""
    lengths = [len(s) for s in streams]
    if not sum(lengths):
        return [np.zeros(n, bool) for n in lengths]
    top = max(int(s.max()) for s in streams if len(s))
    # an end mark of its own after each stream: no run reaches over it
    joined = np.concatenate([np.append(s, top + 1 + k) for k, s in enumerate(streams)])
    owner = np.repeat(np.arange(len(streams)), np.array(lengths) + 1)
    order, lcp = suffix_array(joined)
    # Suffixes side by side with a common prefix of `run` tokens at least are one repeat; it counts where its suffixes are of two streams.
    group = np.cumsum(lcp < run) - 1
    low, high = np.full(group[-1] + 1, len(streams)), np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, owner[order])
    np.maximum.at(high, group, owner[order])
    starts = order[(low < high)[group]]
    edge = np.zeros(len(joined) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)  # each start of a longer run is a start itself, so its whole length is covered
    covered = np.cumsum(edge[:-1]) > 0
    cuts = np.cumsum(np.array(lengths) + 1)
    return [covered[c - n - 1 : c - 1] for c, n in zip(cuts.tolist(), lengths, strict=True)]


def stream_of(blocks: list[tuple[str, int]]) -> tuple[list[str], list[tuple[int, int] | None]]:
    """The tokens of a page's blocks outside main elements, and where in them each block stands (start, tokens); None for a block inside."""
    tokens: list[str] = []
    own: list[tuple[int, int] | None] = []
    for text, kind in blocks:
        if kind == MAIN_TEXT:
            own.append(None)
            continue
        # a block's end is a token, so a short block that pages share whole is a run as well
        words = text.split(" ")
        own.append((len(tokens), len(words)))
        tokens += words
        tokens += ["\n"] * max(1, MIN_RUN - len(words))
    return tokens, own


#: Odd factors by place in a run.
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(b"%d" % k, digest_size=8).digest()) | 1 for k in range(MIN_RUN)], np.uint64)


def run_keys(tokens: list[str], host: str) -> np.ndarray:
    """A 64-bit key of each run of MIN_RUN tokens on a host."""
    n = len(tokens) - MIN_RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    salt = host.encode("utf-8", "surrogatepass")[:64]
    known = {t: int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8, key=salt).digest()) for t in set(tokens)}
    each = np.array([known[t] for t in tokens], np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(MIN_RUN):
        out += each[k : k + n] * _FACTORS[k]
    return out.view(np.int64)


def covered_by(streams: list[list[str]], host: str, shared: np.ndarray) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run whose key is in shared."""
    out = []
    for tokens in streams:
        edge = np.zeros(len(tokens) + 1, np.int64)
        starts = np.flatnonzero(np.isin(run_keys(tokens, host), shared))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + MIN_RUN, -1)
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def main_texts(pages: list[str | None], host: str = "", shared: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """(main text, tokens in the suffix array, tokens that lie in repeated runs) of each page of one shard of one host; shared are the keys of
    runs that other shards of the host have too."""
    read = [blocks_of(p) for p in pages]
    cut = [stream_of(blocks) for blocks in read]
    numbers: dict[str, int] = {}
    every = repeated([np.array([numbers.setdefault(w, len(numbers)) for w in tokens], np.int64) for tokens, _ in cut])
    if shared is not None and len(shared):
        every = [a | b for a, b in zip(every, covered_by([tokens for tokens, _ in cut], host, shared), strict=True)]
    out = []
    for blocks, (tokens, own), covered in zip(read, cut, every, strict=True):
        unique = lambda at, covered=covered: covered[at[0] : at[0] + at[1]].mean() < COVERED
        kept = [text for (text, kind), at in zip(blocks, own, strict=True) if kind == MAIN_TEXT or (kind == OUTSIDE and unique(at))]
        out.append(("\n\n".join(kept), len(tokens), int(covered.sum())))
    return out


def _shard_runs(batches):
    """part and key of each distinct run of each page."""
    for batch in batches:
        for piece in text_slices(batch, "html"):
            keys = [np.unique(run_keys(stream_of(blocks_of(h))[0], host)) for h, host in zip(piece["html"].to_pylist(), piece["host"].to_pylist(), strict=True)]
            rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            if len(rows):
                yield pa.RecordBatch.from_arrays([piece["part"].take(pa.array(rows)), pa.array(np.concatenate(keys))], names=["part", "key"])


_OUT = "page_id long, url string, text string, n_chars long, n_tokens long, n_repeated long"


def _texts(table: pa.Table, shared: pa.Table | None = None) -> pa.Table:
    """One shard's pages with their texts; ids stay Arrow's, so that nulls beside them don't round them."""
    host = table["host"][0].as_py() if table.num_rows else ""
    found = main_texts(table["html"].to_pylist(), host, None if shared is None else shared["key"].to_numpy())
    columns = [pa.array([f[0] for f in found], pa.string()), *(pa.array(x, pa.int64()) for x in ([len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]))]
    return pa.Table.from_arrays([table["page_id"].cast(pa.int64()).combine_chunks(), table["url"].cast(pa.string()).combine_chunks(), *columns], names=["page_id", "url", "text", "n_chars", "n_tokens", "n_repeated"])


def extract_main_text(pages: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html); n_tokens of the page in the suffix array and n_repeated of them in repeated runs.

    Blocks are in page order with an empty line between them, references decoded, white space inside a block one space. A null or empty html
    gives an empty text. A null url, or one without a host, makes a host of its own of all such pages. Repeated rows each come back and other columns
    are not read; an empty table gives an empty one.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0)) + 1).alias("chars"))
    sizes = materialise(sizes.select(F.col("host").alias("h"), "chars", F.ceil(F.col("chars") / shard_chars).cast("int").alias("shards")), "hosts")
    total = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.count(F.when(F.col("shards") > 1, 1))).first()
    # Only hosts of more than one shard are looked up, by broadcast up to BROADCAST_HOSTS of them; so pages are shuffled once, by shard.
    sizes, large = sizes.where("shards > 1").select("h", "shards"), total[1]
    if large <= BROADCAST_HOSTS:
        sizes = F.broadcast(sizes)
    dealt = rows.join(sizes, F.col("host") == F.col("h"), "left").withColumn("shard", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("shards", F.lit(1))))
    dealt = dealt.withColumn("part", F.xxhash64("host", "shard")).select("page_id", "url", "html", "host", "part", "shards")
    # Tasks of bounded size, however large the table; a hot host's shards are spread over them.
    spread = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total[0] // TASK_CHARS))
    pages_of = dealt.drop("shards").repartition(spread, "part").groupBy("part")
    if not large:
        return pages_of.applyInArrow(lambda table: _texts(table), _OUT)
    runs = dealt.where("shards IS NOT NULL").select("html", "host", "part").mapInArrow(_shard_runs, "part long, key long")
    shared = runs.groupBy("key").agg(F.collect_set("part").alias("parts")).where(F.size("parts") > 1).select(F.explode("parts").alias("part"), "key")
    return pages_of.cogroup(shared.repartition(spread, "part").groupBy("part")).applyInArrow(_texts, _OUT)

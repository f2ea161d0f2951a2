"""Template deduction from equivalence classes of tokens, and extraction of what fills the slots.

A page's tokens are its tags, opening and closing, each told apart by its path from the root, and its
texts, each with the path it is found at. A token's occurrence vector says how often each page of its
host has it. Tokens of a host with one vector are an equivalence class, if they are on at least
`MIN_PAGES` pages, however many the host has. Texts whose class has no tag are values that recur, and
are left out, but for those that are fixed at their place: a text on every page that has the tag it
stands in, and for the same share of that tag's occurrences on each. A class is valid if its
tokens come in one order, time after time, and if no other class crosses it: classes nest, as a
template's parts do. The valid classes are the host's template; the texts of a page that are no token
of it fill its slots.

Vectors are never built: a token's fingerprint is a sum over pages of hash(page, count), which is
added up within tasks and then by Spark, so pages of one host needn't meet in one task. Pages
themselves are never shuffled while the templates fit `BROADCAST_ROWS`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.arrow_text import slices
from voxlake.llm.html import VOID, tidy, tokens
from voxlake.operators.components import cut
from voxlake.operators.voxels import sized

#: A share of the host's pages as a further bound is 0, since a layout of few pages would be lost among many others.
MIN_PAGES, MIN_SHARE = 3, 0.0
#: Templates of all hosts are sent to every executor if they have at most so many tokens.
BROADCAST_ROWS = 1_000_000
_FLUSH = 200_000
_IMPLIED = frozenset("p li tr td th option dt dd".split())
_BOUNDS = frozenset("ul ol table tbody thead article section div body nav dl select tr".split())
#: A path is shown by its last tags.
SHOWN = 64
#: Pages of a host that one task has together, where templates aren't broadcast.
TOGETHER = 1000


class Token(NamedTuple):
    id: int
    within: int  # what the path is told by
    path: str
    in_head: bool
    text: str  # "" for a tag


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_steps: dict[tuple[int, str], int] = {}


def _step(parent: int, tag: str) -> int:
    """The number of a path that goes on from another by a tag: all tags up to the root take part, however many."""
    found = _steps.get((parent, tag))
    if found is None:
        if len(_steps) > 100_000:
            _steps.clear()
        found = _steps[parent, tag] = _signed(xxhash.xxh3_64_intdigest(tag, parent & 0xFFFFFFFFFFFFFFFF))
    return found


class _Open(NamedTuple):
    tag: str
    id: int
    path: str
    in_head: bool


def page_tokens(html: str) -> Iterator[Token]:
    """The tokens of a page in order. Tokens are told apart by all of their path; what is shown of it are its last `SHOWN` tags at most."""
    stack = [_Open("", 0, "", False)]  # the root and each open tag
    open_count: Counter[str] = Counter()
    here = stack[0]
    for tag, text in tokens(html):
        if tag and tag != "!":
            if tag[0] == "/":
                name = tag[1:]
                if open_count[name]:
                    while True:
                        closed = stack.pop().tag
                        open_count[closed] -= 1
                        if closed == name:
                            break
                here = stack[-1]
                yield Token(_step(here.id, tag), here.id, here.path, here.in_head, "")
            else:
                if tag in _IMPLIED and open_count[tag]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            for o in stack[k:]:
                                open_count[o.tag] -= 1
                            del stack[k:]
                            break
                        if stack[k].tag in _BOUNDS:
                            break
                here = stack[-1]
                if tag in VOID:
                    yield Token(_step(here.id, tag), here.id, here.path, here.in_head, "")
                else:
                    path = f"{here.path}/{tag}" if here.path else tag
                    if len(stack) > SHOWN:
                        path = "/".join([o.tag for o in stack[1 - SHOWN :]] + [tag])
                    here = _Open(tag, _step(here.id, tag), path, here.in_head or tag == "head")
                    stack.append(here)
                    open_count[tag] += 1
                    yield Token(here.id, here.id, path, here.in_head, "")
        if text and not text.isspace():
            text = tidy(text)
            if text:
                yield Token(_signed(xxhash.xxh3_64_intdigest(text, here.id & 0xFFFFFFFFFFFFFFFF)), here.id, here.path, here.in_head, text)


def hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, within, low, high, pages, place, least, most): sums over a host's pages; low and high
    are the fingerprint's halves, place the sum of the first positions. Token 0 stands for the page itself.

    within is the tag that a text stands in, null for tags; least and most bound how many of
    that tag's occurrences there are for one of the text's on a page.
    """
    salted = pages.where("host <> ''").select("host", F.xxhash64("page_id").alias("salt"), "html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            hosts, ids = zip(*sums, strict=True) if sums else ((), ())
            columns = list(zip(*sums.values(), strict=True)) if sums else [()] * 7
            kinds = [pa.int64()] * 6 + [pa.float64()] * 2
            sums_batch = pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *map(pa.array, (ids, *columns), kinds)], ["host", "token", "low", "high", "pages", "place", "within", "least", "most"])
            sums.clear()
            return sums_batch

        for batch in batches:
            for host, salt, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first: dict[int, int] = {0: 0}
                times: Counter[int] = Counter((0,))
                places: dict[int, int] = {}
                for k, (token, within, _, _, text) in enumerate(page_tokens(html or "")):
                    times[token] += 1
                    if token not in first:
                        first[token] = k
                        if text:
                            places[token] = within
                for token, n in times.items():
                    mark = xxhash.xxh3_64_intdigest(b"%d,%d" % (salt, n))
                    within = places.get(token)
                    share = None if within is None else times[within] / n
                    s = sums.get((host, token))
                    if s is None:
                        sums[host, token] = [mark & 0xFFFFFFFF, mark >> 32, 1, first[token], within, share, share]
                    else:
                        s[0] += mark & 0xFFFFFFFF
                        s[1] += mark >> 32
                        s[2] += 1
                        s[3] += first[token]
                        if share is not None:
                            s[5], s[6] = min(s[5], share), max(s[6], share)
                if len(sums) > _FLUSH:
                    yield out()
        yield out()

    rows = salted.mapInArrow(count, "host string, token long, low long, high long, pages long, place long, within long, least double, most double")
    sums = [F.sum(c).alias(c) for c in ("low", "high", "pages", "place")]
    return rows.groupBy("host", "token").agg(F.max("within").alias("within"), *sums, F.min("least").alias("least"), F.max("most").alias("most"))


def classes(found: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(host, token, class, rank, size) of the tokens that are frequent enough and no recurring values; rank is by mean first position."""
    from pyspark.sql import Window as W

    found = cut(found.where((F.col("token") == 0) | (F.col("pages") >= min_pages)))
    hosts = found.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    tags = found.where("within is null").select("host", F.col("token").alias("within"), F.col("pages").alias("tag_pages"))
    frequent = found.where("token <> 0").where(F.col("pages") >= min_pages).join(hosts, "host").where(F.col("pages") >= F.lit(min_share) * F.col("all_pages"))
    own = W.partitionBy("host", "class")
    fixed = (F.col("pages") == F.col("tag_pages")) & (F.col("least") == F.col("most"))
    held = (
        frequent.join(tags, ["host", "within"], "left")
        .select("host", "token", F.xxhash64("low", "high", "pages").alias("class"), (F.col("place") / F.col("pages")).alias("at"), F.col("within").isNull().alias("tag"), fixed.alias("fixed"))
        .withColumn("tagged", F.max("tag").over(own))
        .where("tagged or fixed")
    )
    return held.select(
        "host", "token", "class", (F.row_number().over(own.orderBy("at", "token")) - 1).alias("rank"), F.count("*").over(own).alias("size")
    )


Template = dict[int, tuple[int, int, int]]


def crossing(sequence: list[tuple[int, int, int]]) -> set[int]:
    """Classes in a page's (class, rank, size) that are out of order or crossed by another."""
    bad: set[int] = set()
    stack: list[list[int]] = []
    for c, rank, size in sequence:
        if size == 1:
            continue
        if stack and stack[-1][0] == c:
            if rank == stack[-1][1]:
                stack[-1][1] += 1
                if stack[-1][1] == size:
                    stack.pop()
            else:
                bad.add(c)
        elif any(s[0] == c for s in stack):
            while stack[-1][0] != c:
                bad.add(stack.pop()[0])
            if rank == stack[-1][1]:
                stack[-1][1] += 1
                if stack[-1][1] == size:
                    stack.pop()
            else:
                bad.add(c)
        elif rank == 0:
            stack.append([c, 1])
        else:
            bad.add(c)
    return bad | {s[0] for s in stack}


def _with_templates(pages: DataFrame, template: DataFrame, rows: int, work: Callable[[pa.RecordBatch, list[Template]], pa.RecordBatch], schema: str, together: int = TOGETHER) -> DataFrame:
    """Apply work to batches of pages (page_id, host, html) and each page's Template.

    Templates are broadcast where they are at most BROADCAST_ROWS; else each task has a share of one host's pages, with that
    host's template.
    """
    if rows <= BROADCAST_ROWS:
        table = template.toArrow()
        held: dict[str, Template] = {}
        for host, token, c, rank, size in zip(*(table.column(n).to_pylist() for n in ("host", "token", "class", "rank", "size")), strict=True):
            held.setdefault(host, {})[token] = (c, rank, size)
        shared = pages.sparkSession.sparkContext.broadcast(held)

        def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            templates = shared.value
            for big in batches:
                for batch in slices(big, "html", 4 << 20):
                    yield work(batch, [templates.get(h, {}) for h in batch.column(1).to_pylist()])

        return pages.mapInArrow(by_host, schema)
    # a host's template goes once to each share of its pages
    shares = pages.groupBy("host").agg(F.ceil(F.count("*") / together).alias("shares"))
    salted = pages.join(sized(shares), "host").withColumn("share", F.pmod(F.xxhash64("page_id"), F.col("shares"))).select("page_id", "host", "html", "share")
    own = template.select("host", "token", "class", "rank", "size").join(shares, "host").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

    def by_share(these: pa.Table, table: pa.Table) -> pa.Table:
        names = [f.partition(" ")[0] for f in schema.split(", ")]
        if not these.num_rows:
            return pa.table({n: [] for n in names})
        t = dict(zip(table.column("token").to_pylist(), zip(*(table.column(n).to_pylist() for n in ("class", "rank", "size")), strict=True), strict=True))
        done = [work(batch, [t] * batch.num_rows) for big in these.select(["page_id", "host", "html"]).to_batches() for batch in slices(big, "html", 4 << 20)]
        return pa.Table.from_batches(done)

    return salted.groupBy("host", "share").cogroup(own.groupBy("host", "share")).applyInArrow(by_share, schema)


def _invalid(batch: pa.RecordBatch, templates: list[Template]) -> pa.RecordBatch:
    bad: set[tuple[str, int]] = set()
    for host, html, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), templates, strict=True):
        if t:
            bad |= {(host, c) for c in crossing([t[k.id] for k in page_tokens(html or "") if k.id in t])}
    hosts, found = zip(*bad, strict=True) if bad else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64())], ["host", "class"])


def _fill(batch: pa.RecordBatch, templates: list[Template]) -> pa.RecordBatch:
    texts, slots, known = [], [], []
    for html, t in zip(batch.column(2).to_pylist(), templates, strict=True):
        own, n = [], 0
        seen = []
        for token in page_tokens(html or ""):
            if token.id in t:
                n += 1
            elif token.text:
                own.append({"path": token.path, "text": token.text})
                if not token.in_head:
                    seen.append(token.text)
        slots.append(own)
        texts.append("\n".join(seen))
        known.append(n)
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(slots, kind), pa.array(known, pa.int32())], ["page_id", "host", "text", "slots", "template_tokens"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, host, text, slots, template_tokens) of every row of pages.

    slots are the (path, text) that aren't in the host's template, in order; text joins those outside
    the head by line breaks; template_tokens counts the page's tokens that are. A page whose URL is null
    or has no host gets host "" and no template, as one of a host with fewer than min_pages pages. A null
    or empty page has no slots and text "". Rows that repeat count as pages of their own. An empty table gives no rows. Very long and
    very deep pages are read as a whole; a slot's path shows its last SHOWN tags. Tokens with one mean position are ranked by their
    number, and pages are compared by all tokens, so ties change nothing. Other columns, whatever their names, are left out.
    """
    rows = hosted(pages, id_col, url_col, html_col)
    found = cut(classes(vectors(rows), min_pages, min_share))
    n = found.count()
    bad = _with_templates(rows.where("host <> ''"), found, n, _invalid, "host string, class long").distinct()
    valid = cut(found.join(bad, ["host", "class"], "left_anti").select("host", "token", "class", "rank", "size"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return _with_templates(rows, valid, n, _fill, f"page_id {kind}, host string, text string, slots array<struct<path:string,text:string>>, template_tokens int")

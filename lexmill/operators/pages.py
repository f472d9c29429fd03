"""Page blocks and URLs."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bound_batches

#: Elements whose text is never content, and elements that end a block.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "video", "audio", "head", "button"}
BLOCK = set("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.buf: list[str] = []
        self.silent = 0
        self.headings: list[str] = []
        self.strong: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.buf).split())
        self.buf = []
        if text and (not self.out or self.out[-1] != text):
            self.out.append(text)
            if self.strong is not None and "".join("".join(self.strong).split()) == "".join(text.split()) and 2 <= len(text) <= 40 and text not in self.headings:
                self.headings.append(text)
        self.strong = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        if tag in SILENT or hidden and tag not in VOID:
            self.silent += 1
        if tag in BLOCK and not self.silent:
            self.flush()
        if tag in ("strong", "b", "h2", "h3") and self.strong is None and not "".join(self.buf).strip():
            self.strong = []

    def handle_endtag(self, tag):
        if self.silent:
            self.silent -= tag in SILENT or tag in BLOCK
            return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            self.buf.append(data)
            if self.strong is not None:
                self.strong.append(data)


def page_blocks(html: str | None) -> tuple[list[str], list[str]]:
    """(visible text blocks without adjacent repeats, blocks that look like subheadings). Null and empty pages have none."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out, p.headings


def block_rows(pages: DataFrame) -> DataFrame:
    """page_id, blocks, subheadings of each page; in batches of bounded bytes, no shuffle."""

    def run(batches):
        for b in batches:
            got = [page_blocks(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "blocks": [g[0] for g in got], "subheadings": [g[1] for g in got]})

    bound_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, blocks array<string>, subheadings array<string>")


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, port, path and query by pattern; empty where a part is missing."""
    part = lambda p: F.regexp_extract(url, p, 1)
    return {"scheme": F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*)://")), "host": F.lower(part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)")), "port": part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:([0-9]+)"), "path": part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"), "query": part(r"\?([^#]*)")}


def canonical_url(url: Column, host: Column | None = None) -> Column:
    """(url, code): the URL without query and fragment, or the code of what is wrong with it."""
    p = url_parts(url)
    code = F.when(~p["scheme"].isin("http", "https"), "invalid_url")
    if host is not None:
        code = code.when(p["host"] != host, "unsupported_domain")
    code = code.when((p["port"] != "") & ~p["port"].isin("80", "443"), "invalid_url").when(p["query"] != "", "query_not_allowed")
    return F.struct(F.when(code.isNull(), F.concat(p["scheme"], F.lit("://"), p["host"], p["path"])).alias("url"), code.alias("code"))


def drop_parameter(url: Column, name: str) -> Column:
    """The URL without one query parameter and without a fragment."""
    p = url_parts(url)
    rest = F.array_join(F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~x.startswith(name + "=")), "&")
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))


def template(html: Column, marks: dict[str, str]) -> Column:
    """The first template whose mark a page holds."""
    out = F
    for name, mark in marks.items():
        out = out.when(F.contains(html, F.lit(mark)), name)
    return out.otherwise("unknown")

"""Page extraction from HTML, robots rules and sitemaps."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "noscript", "template", "svg"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "main", "aside"}


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.meta, self.out, self.links, self.headings = base, {}, [], [], []
        self.title = self.canonical = self.lang = ""
        self.article, self.hidden, self.inside, self.heading, self.seen = False, 0, "", None, set()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "title":
            self.inside = "title"
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"].strip())
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.canonical = urljoin(self.base, a.get("href", ""))
        elif tag == "a" and a.get("href"):
            url = urljoin(self.base, a["href"]).split("#")[0]
            if url.startswith(("http://", "https://")) and url not in self.seen:
                self.seen.add(url)
                self.links.append(url)
        elif tag == "article":
            self.article = True
        if tag in ("h1", "h2", "h3"):
            self.heading = []
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.inside = ""
        if tag in ("h1", "h2", "h3") and self.heading is not None:
            text = " ".join("".join(self.heading).split())
            if text:
                self.headings.append(text)
            self.heading = None
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.inside == "title":
            self.title += data
        elif not self.hidden:
            self.out.append(data)
            if self.heading is not None:
                self.heading.append(data)


def extract(url: str, html: str, max_keywords: int | None = None, max_headings: int | None = None, max_text: int | None = None) -> dict:
    """Fields of a page, whole unless limits are given; broken markup gives what could be read."""
    p = _Page(url)
    p.feed(html or "")
    p.close()
    m = p.meta
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    keywords = [k.strip() for k in re.split(r"[,;]", m.get("keywords", "")) if k.strip()][:max_keywords]
    return {
        "title": " ".join(p.title.split()) or m.get("og:title", ""), "text": "\n".join(x for x in lines if x)[:max_text], "description": m.get("description") or m.get("og:description") or "",
        "links": p.links, "lang": p.lang or None, "canonical": p.canonical or None, "author": m.get("author") or m.get("article:author"), "keywords": keywords, "headings": p.headings[:max_headings],
        "site_name": m.get("og:site_name"), "og_title": m.get("og:title"), "og_type": m.get("og:type"), "published_at": m.get("article:published_time") or m.get("date"), "has_article": p.article or m.get("og:type") == "article",
    }


_SCHEMA = "title string, text string, description string, links array<string>, lang string, canonical string, author string, keywords array<string>, headings array<string>, site_name string, og_title string, og_type string, published_at string, has_article boolean"


def extract_column(url: Column, html: Column) -> Column:
    @F.pandas_udf(_SCHEMA)
    def run(u: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(a or "", b or "") for a, b in zip(u, h, strict=True)], columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return run(url, html)


def sitemap_locations(xml: Column, most: int | None = None) -> Column:
    """All addresses of a sitemap, or its first most ones."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return found if most is None else F.slice(found, 1, most)


def sitemaps(urls: DataFrame, size: int = 1000) -> DataFrame:
    """(site_name, part, xml) of distinct (site_name, url): a site's addresses are dealt by hash to as many parts of about size as they need."""
    counted = urls.groupBy(F.col("site_name").alias("site")).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    dealt = urls.join(counted, F.col("site_name").eqNullSafe(F.col("site"))).withColumn("part", F.pmod(F.xxhash64("url"), F.col("parts")))
    entries = F.collect_list(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")))
    return dealt.groupBy("site_name", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(entries, ""), F.lit("</urlset>")).alias("xml"))


def robots_rules(text: str, agent: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """(prefix, allowed) rules for an agent, its own group before the group of *, and the sitemaps of the groups that apply."""
    groups, sitemaps, current, own = {"*": [], "agent": []}, [], None, False
    for raw in text.splitlines():
        key, _, value = raw.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            name = value.lower()
            current = "*" if name == "*" else "agent" if name.replace("*", "") in agent.lower() else None
            own |= current == "agent"
        elif current and key in ("allow", "disallow") and value:
            groups[current].append((value, key == "allow"))
        elif current and key == "sitemap":
            sitemaps.append(value)
    return groups["agent"] if own else groups["*"], sitemaps


def robots_allowed(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The longest rule that begins the path decides; of equal ones disallow; without a rule a path is allowed."""
    out = F.lit(True)
    for prefix, allow in sorted(rules, key=lambda r: (len(r[0]), not r[1])):
        out = F.when(path.startswith(prefix), F.lit(allow)).otherwise(out)
    return out


def path_allowed(path: Column, allow: list[str] = (), deny: list[str] = ()) -> Column:
    """One of the allowed prefixes (if any), and no denied prefix or pattern; a pattern that is no expression is searched as text."""
    out = F.lit(True)
    if allow:
        out = F.lit(False)
        for p in allow:
            out = out | path.startswith(p)
    for p in deny:
        if p.startswith("/") and "*" not in p:
            hit = path.startswith(p)
        else:
            try:
                re.compile(p)
                hit = path.rlike(p)
            except re.error:
                hit = path.contains(p)
        out = out & ~hit
    return out


def host_allowed(url: Column, hosts: list[str]) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)).isin([h.lower() for h in hosts])



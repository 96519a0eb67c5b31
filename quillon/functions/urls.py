"""URL functions: parts, absolute links, keyword rules, short forms."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of two labels under which names are registered; callers may give a longer set.
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp or.jp co.kr com.br com.cn com.tr co.in co.za com.mx".split())


def domain_info(url: str, suffixes: frozenset[str] = SUFFIXES) -> tuple[str, str] | None:
    """(registered domain, subdomain without www); None for a URL without scheme."""
    if "://" not in (url or ""):
        return None
    host = (urlsplit(url).hostname or "").rstrip(".")
    if not host:
        return None
    labels = host.split(".")
    if labels[-1].isdigit() or len(labels) == 1:
        return host, ""
    keep = 3 if ".".join(labels[-2:]) in suffixes else 2
    sub = labels[:-keep]
    return ".".join(labels[-keep:]), ".".join(sub[1:] if sub[:1] == ["www"] else sub)


def domain_allowed(url: str, allowed: list[str], subdomains: bool = False) -> bool:
    """Whether a crawl may visit the URL; relative ones pass, ``*.domain`` or ``subdomains`` admit subdomains."""
    info = domain_info(url)
    if info is None:
        return True
    domain, sub = info
    full = f"{sub}.{domain}" if sub else domain
    for a in allowed:
        wild = a.startswith("*.")
        name = a[2:] if wild else a
        base = domain_info(f"http://{name}")
        name = f"{base[1]}.{base[0]}" if base and base[1] else base[0] if base else name
        if full == name or ((wild or subdomains) and full.endswith("." + name)):
            return True
    return False


def absolute(base: str, link: str) -> str:
    """The link as seen from the page, by RFC 3986."""
    return urljoin(base, link)


def base_structure(url: str) -> str:
    """Scheme, host and folder of a URL."""
    s = urlsplit(url)
    return f"{s.scheme}://{s.netloc}{s.path.rpartition('/')[0]}/"


def parse_keywords(rule: str) -> tuple[list[str], list[str]]:
    """(wanted, unwanted) words of a rule like ``news europe -economy``."""
    words = rule.split()
    return [w for w in words if not w.startswith("-")], [w[1:] for w in words if w.startswith("-") and len(w) > 1]


def keyword_check(url: Column, rule: str) -> Column:
    """Whether the wanted words occur as often as there are of them, and no unwanted one does."""
    wanted, unwanted = parse_keywords(rule)
    ok = F.lit(True)
    if wanted:
        hits, rest = F.lit(0), url
        for w in wanted:
            short = F.replace(rest, F.lit(w), F.lit(""))
            hits = hits + ((F.length(rest) - F.length(short)) / len(w)).cast("int")
            rest = short
        ok = hits >= len(wanted)
    for w in unwanted:
        ok = ok & ~url.contains(w)
    return ok


def remove_domain(url: Column) -> Column:
    """Path, query and fragment."""
    return F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", "")


def compact_link(url: Column, longest: int = 80) -> Column:
    """A long URL as host, last part of its path, and query, cut to ``longest``."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.lit(""))
    short = F.concat(host, F.lit("/.../"), last, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    short = F.when(F.length(short) > longest, F.concat(F.substring(short, 1, longest), F.lit("..."))).otherwise(short)
    return F.when((F.length(url) > longest) & (path != ""), short).otherwise(url)


def url_key(url: Column) -> Column:
    """MD5 under which a page is known."""
    return F.md5(F.encode(url, "utf-8"))


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in ("domain", "subdomain")]))
def domain_info_udf(s: pd.Series) -> pd.DataFrame:
    """domain_info of each URL."""
    return pd.DataFrame([domain_info(u) or (None, None) for u in s], columns=["domain", "subdomain"])


@F.pandas_udf(T.StringType())
def absolute_udf(base: pd.Series, link: pd.Series) -> pd.Series:
    """absolute of each pair."""
    return pd.Series([None if b is None or x is None else absolute(b, x) for b, x in zip(base, link)])

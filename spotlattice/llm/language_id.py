"""Language identification of web pages by fusing Bayesian evidence.

Four pieces of evidence meet as log odds: the likelihood of the page's text (hashed byte trigrams, learned from every
document with a declared language), the language its markup declares, its address (top-level suffix and language segment),
and a prior of its host.  How far markup and address can be trusted is counted over all pages against the language that the
text alone suggests; a host's prior is smoothed towards its domain's and that towards the whole table's (Dirichlet), all by
grouped aggregation, with the page's own vote taken out.

Defined results: a null page has no text and rests on the other evidence; a null or odd address has the empty host; without
any labelled document the language is null and the confidence 0; ties go to the first language by name; repeated rows are
judged each; other columns are not read.  Markup is stripped in one forward scan, so a page of unclosed tags takes no longer
than another.
"""

from __future__ import annotations

import html as html_
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shared_table

#: Buckets of the trigram model; strength of each smoothing step; tempering of the text's log likelihood; rows of evidence broadcast at most.
BUCKETS, HOST_WEIGHT, DOMAIN_WEIGHT, TEMPER, MAX_CODES = 1 << 15, 4.0, 8.0, 0.25, 10_000
#: Languages whose counts a task holds before it hands them on.
HELD = 32
_SKIPPED = re.compile(rb"(?i)<(script|style)\b")
_ENDS = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style")}
_HTML, _LANG = re.compile(rb"(?i)<html\b"), re.compile(rb"(?i)\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})")
#: Numeric references longer than any code point's.
_HUGE = re.compile(r"&#[xX]?[0-9a-fA-F]{9,};?")
_URL = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)(?::\d+)?(?:/([a-z]{2})(?=[/?#]|$))?")


def trigrams(text: bytes) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased text."""
    x = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    return ((x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]) * np.uint32(2654435761) >> np.uint32(17)


def page_text(page: bytes | None) -> bytes:
    """The text outside tags, comments, scripts and styles.  What is never closed is looked for once."""
    page, out, at = page or b"", [], 0
    missing: set[bytes] = set()

    def close(name: bytes, start: int) -> int:
        """Where the thing that starts here ends; -1 where it never does."""
        if name in missing:
            return -1
        if name in _ENDS:
            found = _ENDS[name].search(page, start)
            end = found.end() if found else -1
        else:
            end = page.find(name, start)
            end = end + len(name) if end >= 0 else -1
        if end < 0:
            missing.add(name)
        return end

    while (start := page.find(b"<", at)) >= 0:
        end, skipped = -1, _SKIPPED.match(page, start)
        if skipped:
            end = close(skipped[1].lower(), skipped.end())
        elif page.startswith(b"<!--", start):
            end = close(b"-->", start + 4)
        if end < 0:
            end = close(b">", start + 1)
        if end < 0:
            break
        out += (page[at:start], b" ")
        at = end
    text = b"".join([*out, page[at:]]).decode("utf-8", "replace")
    return html_.unescape(_HUGE.sub(" ", text)).encode()


def declared(page: bytes | None) -> str:
    """The language that the markup declares, or an empty string."""
    page, at = page or b"", 0
    while found := _HTML.search(page, at):
        end = page.find(b">", found.end())
        end = len(page) if end < 0 else end
        if said := _LANG.search(page, found.end(), end):
            return said[1].decode().lower()
        at = end
    return ""


def _count(batches):
    """(lang, bucket, n): a task's own counts, one row a bucket, handed on whenever HELD languages are held."""
    total: dict[str, np.ndarray] = {}

    def counts():
        for lang, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])], ["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in total and len(total) >= HELD:
                yield from counts()
            have = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            have += np.bincount(trigrams(text or b""), minlength=BUCKETS)
    yield from counts()


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the log likelihood of each bucket in each.  The driver gets (languages x BUCKETS) sums at most."""
    labelled = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("binary"))
    rows = map_texts(labelled, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.full((len(langs), BUCKETS), 0.5)
    np.add.at(table, (np.searchsorted(langs, rows["lang"].to_pylist()), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def _read(langs: list[str], table: np.ndarray):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = _URL.match(url or "")
                host = (m[1] or "").lower() if m else ""
                text = page_text(page)
                ll = TEMPER * table[:, trigrams(text)].sum(1) if text.strip() else np.zeros(len(langs))
                top = langs[int(ll.argmax())] if text.strip() else None
                for column, x in zip(out, (host, ".".join(host.split(".")[-3:]), host.rpartition(".")[2] + "/" + (m[2] or "" if m else "").lower(), declared(page), (ll - ll.max()).tolist(), top), strict=True):
                    column.append(x)
            kinds = [pa.string()] * 4 + [pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], ["page_id", "host", "domain", "address", "declared", "ll", "top"])

    return run


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, declared, text_lang) of every page."""
    langs, table = train(docs)
    raw = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].cast("binary").alias("html"))
    if not langs:
        return raw.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("text_lang"))
    read = shared_table(map_texts(raw, _read(langs, table), "page_id long, host string, domain string, address string, declared string, ll array<double>, top string"))
    votes = lambda: F.array(*[F.sum(F.when(F.col("top") == x, 1.0).otherwise(0.0)) for x in langs])
    k = len(langs)
    every = [x or 0.0 for x in read.agg(votes().alias("v")).first()["v"]]
    total = sum(every)
    base = [(x + 1) / (total + k) for x in every]
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    smooth = lambda own, above, weight: F.zip_with(own, above, lambda n, p: n + weight * p)
    share = lambda xs: F.transform(xs, lambda x: x / F.aggregate(xs, F.lit(0.0), lambda a, y: a + y))
    domains = shared_table(read.groupBy("domain").agg(votes().alias("v")).select("domain", share(smooth(F.col("v"), lit(base), DOMAIN_WEIGHT)).alias("p")))
    seen_hosts = shared_table(read.groupBy("host", "domain").agg(votes().alias("v")))
    hosts = shared_table(seen_hosts.join(domains, "domain").select("host", "v", "p"))  # stored, so that a hot host's rows are split

    def trust(column: str) -> DataFrame:
        """log P(value | language) of every value; broadcast up to MAX_CODES of them, else joined by a shuffle that AQE splits."""
        seen = read.where(F.col(column) != "").groupBy(column).agg(votes().alias("v"))
        rows = F.zip_with("v", lit([x + 1 for x in every]), lambda n, all_: F.log((n + 0.05) / all_))
        seen = shared_table(seen.select(column, rows.alias(f"e_{column}")))
        return F.broadcast(seen) if seen.count() <= MAX_CODES else seen.hint("merge")

    zero = lit([0.0] * k)
    met = read.join(hosts, "host", "left").join(trust("declared"), "declared", "left").join(trust("address"), "address", "left")
    own = F.array(*[F.when(F.col("top") == x, 1.0).otherwise(0.0) for x in langs])
    prior = F.transform(smooth(F.zip_with("v", own, lambda n, o: n - o), F.col("p"), HOST_WEIGHT), lambda x: F.log(x))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = plus(plus(F.col("ll"), prior), plus(F.coalesce("e_declared", zero), F.coalesce("e_address", zero)))
    odds = met.select("page_id", "declared", "top", logs.alias("s")).select("*", F.array_max("s").alias("m"))
    odds = odds.select("*", F.expr("aggregate(s, 0D, (a, x) -> a + exp(x - m))").alias("z"))
    return odds.select("page_id", F.element_at(F.array(*map(F.lit, langs)), F.array_position("s", F.col("m")).cast("int")).alias("lang"), (1 / F.col("z")).alias("confidence"), F.expr("nullif(declared, '')").alias("declared"), F.col("top").alias("text_lang"))


def query(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return identify(pages, docs)

"""URL filter: rules by host and path, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where neither neighbour is a letter or digit. One strict term rejects, or SOFT_HITS different soft ones.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tables import arrow

# Vocabulary: fixed values.
STRICT = ("adult", "casino", "cialis", "escort", "hentai", "jackpot", "porn", "pornhub", "sexcam", "viagra", "warez", "xxx")
SOFT = ("bet", "bonus", "cheap", "cracked", "dating", "deals", "farm", "free", "hot", "keygen", "loan", "pharma", "pills", "poker", "sex", "slots", "spam", "torrent", "win")
SOFT_HITS = 2
# (verdict, host, path): fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """(strict hits, different soft terms) of a URL, upper-case ASCII letters taken as lower-case ones."""
    if not url or not (strict or soft):
        return 0, 0
    text = url.translate(LOWER)
    hard, mild = 0, set()
    for end, (kind, term) in automaton(strict, soft).iter(text):
        before, after = end - len(term), end + 1
        if (before < 0 or text[before] not in WORD) and (after >= len(text) or text[after] not in WORD):
            if kind == 2:
                hard += 1
            else:
                mild.add(term)
    return hard, len(mild)


LOWER = {i: i + 32 for i in range(65, 91)}
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules=RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_terms) of each row.

    The longest rule (host and path together) whose host is the URL's or a parent domain, and with whose path the URL's
    path begins, decides; else the vocabulary. A null URL is allowed.
    """
    host, path = host_and_path(F.col(url_col))
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == domain) | F.endswith(F.col("host"), F.lit("." + domain))) & F.startswith(F.col("path"), F.lit(start))
        best, verdict = F.when(fits, domain + start).otherwise(best), F.when(fits, kind).otherwise(verdict)

    def run(batch):
        found = [hits(u, strict, soft) for u in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64())],
                                          ["page_id", "url", "strict_hits", "soft_terms"])

    rows = arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), run, "page_id long, url string, strict_hits long, soft_terms long")
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_terms") >= SOFT_HITS), "block").otherwise("allow")
    out = rows.withColumn("host", host).withColumn("path", path).withColumn("rule", best)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_terms")

"""URL filter: rules first, then a ratio of two character language models.

Two smoothed variable-order Markov models, of URLs that rules allow and of URLs that rules block, predict
each byte from up to ORDER bytes before it; a context that was never seen leaves the prediction to the next
shorter one. The score is the difference of the two log-likelihoods per byte; the threshold is the one that
separates best on rule-judged URLs that were not counted. N-grams are counted over all other
rule-judged URLs, and every count is used: the counts stay a table. URLs are dealt to blocks of bounded size,
each block asks the table for its distinct n-grams and contexts, and is scored with what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import _MASK, eight, lay, octets, packs
from tillroll.session import settle

ALLOW, BLOCK = "allow", "block"
RULES = (
    (ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/"),
)
#: Bytes of context at most.
ORDER = 4
#: Bytes of the texts, about, that are scored together.
BLOCK_BYTES = 1 << 16
#: Weight of the next shorter context's prediction, in counts.
SMOOTHING = 2.0
#: One rule-judged URL in so many is kept for the threshold.
HELD_OUT = 5
#: Scores are put in bins of this width for the threshold.
BIN = 0.01
START, END = b"\x02" * ORDER, b"\x03"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def text_of(url: Column) -> Column:
    """What the models read: the whole url without its scheme, its host in lower case; without ://, all of it."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(url.contains("://"), F.concat(host_of(url), rest)).otherwise(url), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path) that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        site, _, rest = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _grams(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The text of each predicted byte; and for context sizes 0 to ORDER the keys of context plus
    byte, and of the context. Keys hold their bytes (5 at most), the size and the kind."""
    buf, bounds = lay([START + t + END for t in texts])
    sizes = np.diff(bounds) - 1 - ORDER  # without start and the space behind
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[:-1] + ORDER, sizes)
    view = eight(buf)
    grams, contexts = [], []
    for j in range(ORDER + 1):
        tag = np.uint64(j << 48)
        grams.append((view[at - j] & _MASK[j + 1]) | tag)
        contexts.append((view[at - j] & _MASK[j]) | tag | np.uint64(1 << 56))
    return owner, grams, contexts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        allowed = np.array(batch.column("allowed").to_pylist(), dtype=bool)
        for first, pack in packs(octets(batch.column("text"))):
            owner, grams, contexts = _grams(pack)
            keys, ok = np.concatenate(grams + contexts), np.tile(allowed[first + owner], 2 * ORDER + 2)
            key, place = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key.view(np.int64)),
                "allowed": pa.array(np.bincount(place, ok, minlength=len(key)).astype(np.int64)),
                "blocked": pa.array(np.bincount(place, ~ok, minlength=len(key)).astype(np.int64)),
            })


@dataclass
class Model:
    keys: np.ndarray
    counts: np.ndarray  # allowed and blocked, by key

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((2, len(keys)))
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.counts[:, i], 0)

    def ratios(self, texts: list[bytes]) -> np.ndarray:
        """Per text the log-likelihood ratio, allowed to blocked, divided by the bytes predicted."""
        owner, grams, contexts = _grams(texts)
        p = np.full((2, len(owner)), 1 / 256)
        for g, c in zip(grams, contexts):
            p = (self.of(g) + SMOOTHING * p) / (self.of(c) + SMOOTHING)
        n = np.bincount(owner, minlength=len(texts))
        return np.bincount(owner, np.log(p[0]) - np.log(p[1]), minlength=len(texts)) / n


def fit(judged: DataFrame) -> DataFrame:
    """(key, allowed, blocked): all counts of the models, from (text, allowed boolean), pre-summed in tasks."""
    return judged.mapInArrow(_count, "key bigint, allowed bigint, blocked bigint").groupBy("key").agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")
    )


def _needed(rows: pa.Table) -> pa.Table:
    """The distinct keys by which a block's texts are scored."""
    keys = []
    for _, pack in packs(octets(rows.column("text").combine_chunks())):
        _, grams, contexts = _grams(pack)
        keys.append(np.unique(np.concatenate(grams + contexts)))
    key = np.unique(np.concatenate(keys))
    return pa.table({"block": pa.array(np.full(len(key), rows.column("block")[0].as_py(), dtype=np.int64)), "key": pa.array(key.view(np.int64))})


def _ratio(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's rows with their ratios, by the counts of its keys. A key that was not found was never seen."""
    counts = counts.sort_by("key")
    model = Model(
        counts.column("key").to_numpy().view(np.uint64), np.array([counts.column(c).to_numpy() for c in ("allowed", "blocked")], float)
    )
    out = [model.ratios(pack) for _, pack in packs(octets(rows.column("text").combine_chunks()))]
    return rows.select(["page_id", "host", "path", "rule"]).append_column("ratio", pa.array(np.concatenate(out) if out else np.empty(0)))


def score(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, ratio) for ``rows`` (the same, text, place) by the ``counts`` of ``fit``. Place is
    a number dealt evenly from 0 on, by which rows go to blocks; ratios do not depend on it."""
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    rows = rows.withColumn("block", F.pmod("place", F.lit(size // BLOCK_BYTES + 1)).cast("bigint")).drop("place")
    needed = rows.select("block", "text").groupBy("block").applyInArrow(_needed, "block bigint, key bigint")
    found = needed.join(counts, "key").select("block", "key", "allowed", "blocked")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _ratio, "page_id bigint, host string, path string, rule string, ratio double"
    )


def threshold(scored: DataFrame) -> float:
    """The cut of ``ratio`` with the best mean of the two classes' shares on the right side, from
    (allowed boolean, ratio), in the middle of the gap if there is one; 0 if a class is missing."""
    bins = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "ratio")) / BIN).alias("bin")
    rows = scored.groupBy(bins).agg(
        F.sum(F.col("allowed").cast("int")).alias("good"), F.sum((~F.col("allowed")).cast("int")).alias("bad")
    ).collect()  # at most 40 / BIN + 1 rows
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    rows = sorted(rows, key=lambda r: r["bin"])
    best, cut, g, b = 1.0, rows[0]["bin"], good, 0
    for r, after in zip(rows, rows[1:] + rows[-1:]):
        g, b = g - r["good"], b + r["bad"]
        if g / good + b / bad > best:
            best, cut = g / good + b / bad, (r["bin"] + 1 + max(after["bin"], r["bin"] + 1)) / 2
    return cut * BIN


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Returns (page_id, host, path, rule, verdict, ratio) for every row of ``pages`` (page_id bigint, url).

    The longest rule that fits decides; ``ratio`` decides the others, by the whole url but its scheme. Null urls, and
    those without ://, have an empty host and path and no rule; null is judged by an empty text. Rules are a short list, part of
    the plan. Repeated rows are counted and returned each; other columns are ignored. Without rule-judged
    URLs every ratio is 0 and all is allowed.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), text_of(url).alias("text"))
    parts = parts.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = settle(parts.withColumn("place", F.floor(F.rand(1) * (1 << 40))))
    allowed = (verdict_of(F.col("rule"), rules) == ALLOW).alias("allowed")
    aside = F.pmod(F.xxhash64(F.concat("host", "path")), F.lit(HELD_OUT)) == 0
    counts = settle(fit(rows.where(F.col("rule").isNotNull() & ~aside).select("text", allowed)))
    scored = settle(score(rows, counts))
    cut = threshold(scored.where(F.col("rule").isNotNull() & aside).select(allowed, "ratio"))
    by_ratio = F.when(F.col("ratio") >= cut, F.lit(ALLOW)).otherwise(F.lit(BLOCK))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), by_ratio).alias("verdict"), "ratio"
    )

"""URL filters: a few host and path rules, gradient-boosted trees for the rest.

A rule (``host/path``) fits its host and all subdomains if the url's path starts
with the rule's; of several the longest holds.  Urls that a rule decides are the
labelled urls: boosted trees learn from all of them and judge the others by their
lexical features (lengths, depth, digit ratio, byte entropy, parameter, hyphen and
dot counts) and by statistics of the host's last one and two labels (how often they
occur, and the smoothed log odds of block among labelled urls).

Host, path and rules are DataFrame expressions; features come from one vectorised
pass over url bytes; suffix statistics are grouped counts joined back, which the
plan broadcasts only while they are small; training and scoring are Spark MLlib's.

Defined cases: a null url and one without ``://`` have empty host and path, no rule,
and are judged by their features; empty and very long urls likewise; repeated rows
each give a row; extra columns are not read; an empty table gives an empty result.
Without labelled urls of both verdicts, all others get the one seen, or allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingpath.llm.common import SLICE_BYTES, lower_ascii, staged
from pingpath.llm.wordtable import as_strings, slices, words

#: (verdict, rule): the production rules (fixed values).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]

_DIGIT, _LETTER, _ANY = (np.zeros(256, dtype=bool) for _ in range(3))
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True
_ANY[:] = True


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.lit(""))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    return (pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("_host", host)
            .withColumn("path", F.regexp_extract(F.substring(F.col("_rest"), F.length("_host") + 1, F.length("_rest")), r"^[^?#]*", 0))
            .withColumn("host", lower_ascii(F.col("_host"))).drop("_rest", "_host"))


def _first_fitting(rules: list[tuple[str, str]], value) -> Column:
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        cases.append(F.when(fits & F.col("path").startswith(slash + path), F.lit(value(verdict, rule))))
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _byte_features(urls: pa.Array) -> np.ndarray:
    """One row of lexical features for each url."""
    w = words(as_strings(urls), _ANY)
    n = w.n_docs
    size = np.diff(w.offsets)
    owner = np.repeat(np.arange(n), size)
    grid = np.bincount(owner * 256 + w.buf, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(size, 1)[:, None]
    share = grid / total
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    count = lambda c: grid[:, ord(c)]
    return np.column_stack([size, np.maximum(count("/") - 2, 0), grid[:, _DIGIT].sum(axis=1) / total[:, 0],
                            grid[:, _LETTER].sum(axis=1) / total[:, 0], entropy, count("="), count("&"), count("?"),
                            count("#"), count("-"), count("."), count("_") + count("%")])


def _features(pages: DataFrame) -> DataFrame:
    keep = [c for c in pages.columns if c != "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url", SLICE_BYTES, 1 << 12):
                x = _byte_features(part.column("url"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists], [*keep, "lexical"])

    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.mapInArrow(run, f"{schema}, lexical array<double>")


def _suffix(n: int) -> Column:
    return F.substring_index("host", ".", -n)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, trees: int = 20, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict and the probability of block, one row per page row."""
    ruled = (with_parts(pages.select("page_id", "url"))
             .withColumn("rule", _first_fitting(rules, lambda v, r: r))
             .withColumn("given", _first_fitting(rules, lambda v, r: v)))
    base = staged(_features(ruled.withColumn("suffix1", _suffix(1)).withColumn("suffix2", _suffix(2))), "url-features")
    block = F.when(F.col("given") == "block", 1).when(F.col("given") == "allow", 0)
    joined = base
    for s in ("suffix1", "suffix2"):
        stats = base.groupBy(F.col(s).alias("_" + s)).agg(
            F.log1p(F.count("*").cast("double")).alias(s + "_n"),
            F.log((F.sum(F.coalesce(block, F.lit(0))) + 1.0) / (F.sum(F.coalesce(1 - block, F.lit(0))) + 1.0)).alias(s + "_odds"))
        joined = joined.join(stats, joined[s] == stats["_" + s], "left").drop("_" + s)
    x = array_to_vector(F.concat("lexical", F.array("suffix1_n", "suffix1_odds", "suffix2_n", "suffix2_odds")))
    rows = joined.select("page_id", "host", "path", "rule", "given", block.cast("double").alias("label"), x.alias("features"))
    labelled = rows.where(F.col("label").isNotNull())
    seen = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(seen) == 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(labelled.select("label", "features"))
        rows = model.transform(rows).withColumn("guess", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    else:
        rows = rows.withColumn("guess", F.lit("block" if 1.0 in seen else "allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("given", "guess").alias("verdict"),
                       F.col("guess").alias("model_verdict"))

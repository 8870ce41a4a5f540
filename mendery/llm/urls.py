"""URL filters: rules on host and path; where none fits, host words and path tokens are scored by a
multinomial naive Bayes model.

Names run words together, so letter runs of hosts and paths are split by unigram Viterbi. The unigrams are
the words of all pages; each distinct letter run is split once, and the counts of its substrings come to it
by a join, so no dictionary is held in memory. The model is fitted on all pages that a rule decides. Words
that the rules themselves name are left out of it, as they would only repeat the rules.

Pages are grouped by their bag of letter runs before anything is scored: a host with a third of all pages is
a handful of bags.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import map_rows, table
from mendery.session import settle_table

# host, path, verdict
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Words up to this many letters are looked up as substrings of a run, longer ones by their first so many letters.
HEAD = 20
SMOOTHING = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = re.compile(rb"<script.*?</script>|<style.*?</style>|<[^>]*>", re.DOTALL | re.IGNORECASE)
_RUN = re.compile(rb"[a-z]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    body = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    slash = F.instr(body, "/")
    host = F.when(slash > 0, F.substr(body, F.lit(1), slash - 1)).otherwise(body)
    path = F.when(slash > 0, F.substr(body, slash)).otherwise(F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def rule_words(rules=RULES) -> list[str]:
    return sorted({w for h, p, _ in rules for w in re.findall("[a-z]+", h + p)})


def word_counts(pages: DataFrame) -> DataFrame:
    """How often each word, of any length, stands in the text of all pages."""

    def make():
        def rows(htmls):
            counts: Counter[bytes] = Counter()
            for html in htmls:
                if html:
                    counts.update(_RUN.findall(_TAG.sub(b" ", html).lower()))
            return list(counts.items())

        return rows

    counted = map_rows(pages.select("html"), "word string, n bigint", make)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def split_run(run: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most probable words of a letter run: unigram Viterbi. ``counts`` has (start, length) of the substrings
    that are words. An unknown substring costs ten times more with each letter; of equal splits the one with
    the longer last words wins."""
    n, step, logs = len(run), math.log(10), math.log(max(total, 1))
    best = [(0.0, 0)] + [(-math.inf, 0)] * n
    ending: dict[int, list[tuple[int, int]]] = {}
    for (start, size), seen in sorted(counts.items()):
        ending.setdefault(start + size, []).append((start, seen))
    # where an unknown word that goes on to any later letter had best begin: its cost grows alike from all starts
    unknown, begins = -math.inf, 0
    for end in range(1, n + 1):
        if best[end - 1][0] + (end - 1) * step > unknown:
            unknown, begins = best[end - 1][0] + (end - 1) * step, end - 1
        ways = [(unknown - end * step - step - logs, begins)]
        ways += [(best[start][0] + math.log(seen) - logs, start) for start, seen in ending.get(end, ())]
        best[end] = max(ways, key=lambda w: (w[0], -w[1]))
    words, end = [], n
    while end:
        start = best[end][1]
        words.append(run[start:end])
        end = start
    return words[::-1]


def split_runs(runs: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(run, words) for distinct letter runs. A run's substrings look their counts up by a join; what comes
    back together is one run's words. Of words longer than HEAD, those are compared whose first letters stand in
    the run, so a long run has HEAD substrings a letter and not one for each pair of its letters."""
    total = unigrams.agg(F.sum("n").alias("n")).first()["n"] or 0
    at = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start")
    pieces = (
        runs.select("run", at)
        .select(
            "run",
            "start",
            F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("run") - F.col("start") + 1))).alias("size"),
        )
        .select("run", "start", "size", F.substr("run", "start", "size").alias("word"))
    )
    short = pieces.join(unigrams, "word").select("run", "start", "size", "n")
    words = unigrams.filter(F.length("word") > HEAD).select(F.substr("word", F.lit(1), F.lit(HEAD)).alias("head"), "word", "n")
    heads = runs.filter(F.length("run") > HEAD).select("run", at).select("run", "start", F.substr("run", "start", F.lit(HEAD)).alias("head"))
    long = heads.join(words, "head").filter(F.substr("run", "start", F.length("word")) == F.col("word"))
    known = short.unionByName(long.select("run", "start", F.length("word").alias("size"), "n")).groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("found"))

    def make():
        def rows(names, found):
            out = []
            for name, pieces in zip(names, found, strict=True):
                run = name.decode()
                counts = {(p["start"] - 1, p["size"]): p["n"] for p in pieces or ()}
                out.append((run, split_run(run, counts, total)))
            return out

        return rows

    return map_rows(runs.join(known, "run", "left").select("run", "found"), "run string, words array<string>", make)


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and for pages without a rule the score (log odds
    of block against allow).

    A null url, or one without ``://``, has no host, path or rule. A page without a rule is blocked if its
    score is above 0; it is allowed if it has no words or if the rules decide no page of both kinds. Repeated
    rows give repeated results, an empty table none, other columns are not looked at, and text of any length
    is read whole.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    runs = F.array_sort(F.regexp_extract_all(F.translate(F.concat("host", F.lit(" "), "path"), _UPPER, _LOWER), F.lit("([a-z]+)"), F.lit(1)))
    judged = judged.select("*", rule.alias("rule"), verdict.alias("ruled"), F.array_join(runs, " ").alias("bag"))

    bags = judged.groupBy("bag").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    single = bags.select(F.explode(F.split("bag", " ")).alias("run"), "bag", "allowed", "blocked").filter("run <> ''")
    # written, so that the texts are read once whatever is computed from them
    unigrams = settle_table(word_counts(pages), "unigrams")
    words = split_runs(single.select("run").distinct(), unigrams)
    tokens = (
        single.join(words, "run")
        .select("bag", "allowed", "blocked", F.explode("words").alias("token"))
        .filter(~F.col("token").isin(rule_words(rules)))
        .groupBy("bag", "token")
        .agg(F.count("*").alias("n"), F.first("allowed").alias("allowed"), F.first("blocked").alias("blocked"))
    )
    classes = bags.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    seen = tokens.groupBy("token").agg(
        F.sum(F.col("n") * F.col("allowed")).alias("a"), F.sum(F.col("n") * F.col("blocked")).alias("b")
    )
    sums = seen.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if((F.col("a") + F.col("b")) > 0).alias("v")).first()
    usable = bool(classes["a"] and classes["b"])
    prior = math.log(classes["b"] / classes["a"]) if usable else 0.0
    base_a = (sums["a"] or 0) + SMOOTHING * max(sums["v"] or 0, 1)
    base_b = (sums["b"] or 0) + SMOOTHING * max(sums["v"] or 0, 1)
    odds = seen.filter("a + b > 0").select(
        F.col("token"),
        (F.log((F.col("b") + SMOOTHING) / F.lit(base_b)) - F.log((F.col("a") + SMOOTHING) / F.lit(base_a))).alias("odds"),
    )
    scored = (
        tokens.join(odds, "token")
        .groupBy("bag")
        .agg(F.round(F.sum(F.col("n") * F.col("odds")) + F.lit(prior), 9).alias("score"))
        .withColumnRenamed("bag", "of")
    )
    # bags of ruled pages need no score; keys of the others are few, and a hot one is split by Spark's skew join
    out = judged.join(scored, (F.col("bag") == F.col("of")) & F.col("ruled").isNull(), "left")
    by_method = F.when(F.lit(usable) & (F.col("score") > 0), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "score")


def op4_segmented_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return judge_pages(table(spark, folder, "pages"))

"""Header titles against the declared schema, on distinct titles only."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from gridwork.config import JobConfig
from gridwork.functions.labels import (
    TitleBound,
    can_score,
    compact,
    first_title,
    fold_label,
    folded,
    similarity,
    title_candidates,
)
from gridwork.session import computed_once

# Outcomes of a title and the words that say which part of it was compared.
EXACT, SIMILAR, AMBIGUOUS, UNMATCHED, CONFLICT = "TAM", "SEZGİSEL", "BELİRSİZ", "EŞLEŞMEDİ", "ÇAKIŞMA"
WHOLE_TEXT = "TÜM METİN"


def leading_lines_text(count: Column) -> Column:
    return F.format_string("İLK %d DOLU SATIR", count)


def tall_header_text(height: Column) -> Column:
    return F.format_string("%d EXCEL SATIRI; HÜCRE İÇİ AYIKLAMA", height)


@lru_cache(maxsize=16)
def title_bound(cfg: JobConfig) -> TitleBound:
    """Bound at the lowest threshold any declared column has."""
    aliases = [fold_label(a) for spec in cfg.schema for a in (spec.name, *spec.aliases)]
    return TitleBound(aliases, min(cfg.threshold_of(spec) for spec in cfg.schema))


def _alias_array(cfg: JobConfig) -> Column:
    """The alias dimension. Its size is that of the declared schema, so it travels as a literal."""
    rows = []
    for spec in cfg.schema:
        for alias in map(fold_label, (spec.name, *spec.aliases)):
            tight = alias.replace(" ", "")
            rows.append(
                {
                    "target": spec.name,
                    "alias": alias,
                    "tight": tight,
                    "letters": "".join(sorted(set(tight))),
                    "size": len(alias),
                    "tight_size": len(tight),
                    "threshold": float(cfg.threshold_of(spec)),
                }
            )
    shape = "target:string,alias:string,tight:string,letters:string,size:int,tight_size:int,threshold:double"
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{shape}>>")


def score_titles(titles: DataFrame, cfg: JobConfig, full: bool) -> DataFrame:
    """Decision for every distinct ``raw`` title.

    With ``full`` all scores are exact, as the audit needs them. Without it, aliases that cannot
    change the decision are left out before scoring, and titles with no alias left are absent.
    """
    mode = cfg.text_mode
    candidates = F.posexplode(title_candidates(F.col("raw"), mode, cfg.max_prefix_lines))
    # Few titles make many costly pairs, so they are not drawn together into few tasks.
    spread = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = titles.select("raw").distinct().repartition(spread)
    prefixes = distinct.select("raw", candidates.alias("prefix", "text"))
    prefixes = prefixes.withColumn("norm", folded(F.col("text")))
    aliases = _alias_array(cfg)
    if not full:
        # Below this score an alias neither wins nor comes close enough to make the winner ambiguous.
        floor = min(cfg.threshold_of(spec) for spec in cfg.schema) - cfg.margin
        prefixes = prefixes.withColumn("tight", computed_once(compact(F.col("norm"))))
        norm, tight = F.col("norm"), F.col("tight")
        aliases = F.filter(aliases, lambda a: can_score(norm, tight, a, cfg.short_limit, floor))
    pairs = prefixes.select("raw", "prefix", "norm", F.explode(aliases).alias("a"))
    scored = pairs.select(
        "raw",
        "prefix",
        F.col("a.target").alias("target"),
        F.col("a.threshold").alias("threshold"),
        similarity(F.col("norm"), F.col("a.alias"), cfg.short_limit).alias("score"),
    )
    # Per title: prefixes x declared aliases, so the list is bounded by the schema.
    entry = F.struct((-F.col("score")).alias("loss"), "target", "prefix", "threshold")
    return _decide(scored.groupBy("raw").agg(F.collect_list(entry).alias("entries")), cfg)


def _decide(scored: DataFrame, cfg: JobConfig) -> DataFrame:
    mode = cfg.text_mode
    entries = F.col("entries")
    candidates = title_candidates(F.col("raw"), mode, cfg.max_prefix_lines)
    exact = F.array_max(F.transform(F.filter(entries, lambda e: e["loss"] == -100), lambda e: e["prefix"]))
    opening = F.filter(entries, lambda e: e["prefix"] == 0)
    best_opening = F.array_min(opening)
    weak = F.coalesce(-best_opening["loss"] < best_opening["threshold"], F.lit(True))
    pool = (
        F.when(F.col("exact").isNotNull(), F.filter(entries, lambda e: e["prefix"] == F.col("exact")))
        .when(weak & (F.size("candidates") > 1), entries)
        .otherwise(opening)
    )
    chosen = (
        scored.withColumn("exact", exact)
        .withColumn("candidates", candidates)
        .withColumn("pool", pool)
        .withColumn("best", F.array_min("pool"))
        .withColumn("runner", F.array_min(F.filter("pool", lambda e: e["target"] != F.col("best")["target"])))
    )
    score = F.coalesce(-F.col("best.loss"), F.lit(0.0))
    gap = score - F.coalesce(-F.col("runner.loss"), F.lit(0.0))
    reached = F.col("best").isNotNull() & (score >= F.col("best.threshold"))
    matched = reached & (gap >= cfg.margin)
    prefix = F.coalesce(F.col("best.prefix"), F.lit(0))
    scored_label = F.get("candidates", prefix)
    whole = F.lit(WHOLE_TEXT)
    strategy = whole if mode == "full" else leading_lines_text(F.when(matched, prefix).otherwise(0) + 1)
    return chosen.select(
        "raw",
        F.when(matched, scored_label).otherwise(first_title(F.col("raw"), mode)).alias("label"),
        F.when(matched, F.col("best.target")).alias("target"),
        F.bround(score, 2).alias("score"),
        F.when(matched, F.when(score == 100, EXACT).otherwise(SIMILAR))
        .when(reached, AMBIGUOUS)
        .otherwise(UNMATCHED)
        .alias("state"),
        F.coalesce(F.col("runner.target"), F.lit("")).alias("runner_up"),
        F.bround(gap, 2).alias("margin"),
        strategy.alias("strategy"),
        scored_label.alias("scored_label"),
    )


def winners(hits: Column) -> Column:
    """One column per target out of ``array<struct<col, target, score, ...>>``: highest score,
    then leftmost. Gives ``array<struct<loss, col, target>>``."""
    targets = F.array_distinct(
        F.transform(F.filter(hits, lambda h: h["target"].isNotNull()), lambda h: h["target"])
    )
    return F.transform(
        targets,
        lambda t: F.array_min(
            F.transform(
                F.filter(hits, lambda h: h["target"] == t),
                lambda h: F.struct((-h["score"]).alias("loss"), h["col"].alias("col"), h["target"].alias("target")),
            )
        ),
    )

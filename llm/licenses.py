"""License scans by ordered signature rules, in built-in functions only.

Texts become words; a keyword filter picks the texts and the rules worth trying; every match of a rule is
a detection with its interval of words. A detection that lies inside another is dropped unless its own
priority is higher. No row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm.common import ascii_lower, table, text_or_empty
from llm.license_rules import BASE, RULES, Rule

#: What separates words, before and after A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text: str | Column) -> Column:
    """Every word between two blanks of its own: ' word ', one after the other, case as it was."""
    marked = F.concat(F.lit("!"), text_or_empty(text), F.lit("!"))
    doubled = F.regexp_replace(marked, SEPARATOR, "  ")
    return F.substr(doubled, F.lit(2), F.length(doubled) - 2)


def words_in(units: Column) -> Column:
    return F.expr("0L") + ((F.length(units) - F.length(F.replace(units, F.lit(" "), F.lit("")))) / 2).cast("long")


def _places(match: Column) -> Column:
    """All places of one rule as detections, counted along what stands between them."""
    rule, hits, between = match["rule"], match["hits"], match["between"]

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + words_in(F.get(between, i))
        end = start + words_in(F.get(hits, i))
        found = F.struct(
            start.alias("start"), (-end).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["number"].alias("number"), rule["label"].alias("label")
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    nothing = F.array().cast("array<struct<start:long,minus_end:long,minus_priority:int,number:int,label:string>>")
    begin = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), begin, step, lambda s: s["found"])


def _detections(words: Column, rules: list[Rule]) -> Column:
    """Detections of all rules whose keyword occurs, outer intervals first. Each step is an array of its
    own, so that no text is searched twice for the same rule."""
    structs = [
        F.struct(F.lit(i).alias("number"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(f" {r.keyword}").alias("keyword"), F.lit(r.pattern).alias("pattern"))
        for i, r in enumerate(rules)
    ]
    tried = F.filter(F.array(*structs), lambda r: F.contains(words, r["keyword"]))
    hits = F.transform(tried, lambda r: F.struct(r.alias("rule"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("hits")))
    matched = F.filter(hits, lambda m: F.size(m["hits"]) > 0)
    split = F.transform(matched, lambda m: F.struct(m["rule"].alias("rule"), m["hits"].alias("hits"), F.split(words, m["rule"]["pattern"], -1).alias("between")))
    return F.array_sort(F.flatten(F.transform(split, _places)))


def gate_pattern(rules: list[Rule]) -> str:
    """Finds any keyword at the beginning of a word; sorted by first letters, so that most words need
    few comparisons."""
    keywords = sorted({r.keyword for r in rules})
    kept = [k for k in keywords if not any(k != other and k.startswith(other) for other in keywords)]
    first = sorted({k[0] for k in kept})
    return " (?:" + "|".join(f"{c}(?:{'|'.join(k[1:] for k in kept if k[0] == c)})" for c in first) + ")"


def _settled(detections: Column) -> Column:
    """One pass over sorted detections: which stay, and how many words they cover. ``ends[p]`` is how far
    earlier detections of priority p or more reach; those begin no later, so reaching the end is containing."""

    def step(state: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        kept = F.get(state["ends"], priority) < end
        ends = F.transform(state["ends"], lambda e, p: F.when(p <= priority, F.greatest(e, end)).otherwise(e))
        fresh = F.greatest(end - F.greatest(d["start"], state["reach"]), F.lit(0).cast("long"))
        return F.struct(
            ends.alias("ends"),
            F.when(kept, F.concat(state["kept"], F.array(d["label"]))).otherwise(state["kept"]).alias("kept"),
            F.when(kept, state["covered"] + fresh).otherwise(state["covered"]).alias("covered"),
            F.when(kept, F.greatest(state["reach"], end)).otherwise(state["reach"]).alias("reach"),
        )

    begin = F.struct(
        F.array_repeat(F.lit(-1).cast("long"), BASE + 1).alias("ends"), F.array().cast("array<string>").alias("kept"),
        F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("reach"),
    )
    return F.aggregate(detections, begin, step)


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Adds a struct ``licenses`` to every row (an input column of that name gives way): n_words, n_base,
    first_word, last_word, base_labels, labels and score (the share of words inside kept detections). A
    null or empty text has no words, no labels (empty strings) and the score 0. Repeated rows are scanned
    alike; other columns stay."""
    rules = rules or RULES
    units = docs.select(F.struct(*docs.columns).alias("row"), spaced(text).alias("units"))
    # The gate's lower case may turn a rare letter into k or i, which lets a text more through, none less.
    gate = F.lower("units").rlike(gate_pattern(rules))
    # A column of its own: inside the rules' lambdas the text would be lower-cased for each rule again.
    lower = units.withColumn("lower", F.when(gate, ascii_lower(F.col("units"))))
    found = lower.withColumn("found", F.when(F.col("lower").isNotNull(), _detections(F.col("lower"), rules)))
    base = F.filter("found", lambda d: d["minus_priority"] == -BASE)
    starts = F.transform(base, lambda d: d["start"])
    names = F.array_sort(F.array_distinct(F.transform(base, lambda d: d["label"])))
    judged = found.select(
        "row", words_in(F.col("units")).alias("n"), starts.alias("starts"), names.alias("base"), F.when(F.size("found") > 0, _settled(F.col("found"))).alias("all")
    )
    none = F.array().cast("array<string>")
    every = F.array_union(F.coalesce("base", none), F.coalesce(F.col("all.kept"), none))
    licenses = F.struct(
        F.col("n").alias("n_words"),
        F.coalesce(F.when(F.col("starts").isNotNull(), F.size("starts")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join(F.coalesce("base", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("all").isNotNull(), F.col("all.covered") / F.col("n")).otherwise(F.lit(0.0)).alias("score"),
    )
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "licenses"]
    return judged.select(*kept, licenses.alias("licenses"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the rules find."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")


def _sql_rules() -> str:
    return ",\n    ".join(f"({i}, '{r.label}', {r.priority}, ' {r.keyword}', '{r.pattern}')" for i, r in enumerate(RULES))


OP6_SQL = f"""
WITH rules(number, label, priority, keyword, pattern) AS (VALUES
    {_sql_rules()}),
doubled AS (
  SELECT doc_id, regexp_replace('!' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '!',
                                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g') AS t
  FROM documents),
words AS (
  SELECT row_number() OVER () AS row_no, doc_id, substr(t, 2, length(t) - 2) AS w, (length(t) - 2 - length(replace(t, ' ', '')) ) // 2 AS n_words
  FROM doubled),
matched AS (
  SELECT row_no, number, label, priority,
         regexp_extract_all(w, pattern) AS hits, string_split_regex(w, pattern) AS between
  FROM words JOIN rules ON contains(w, keyword) WHERE regexp_matches(w, pattern)),
units AS (
  SELECT row_no, number, label, priority,
         list_transform(hits, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS h,
         list_transform(between, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS b
  FROM matched),
found AS (
  SELECT row_no, number, label, priority,
         list_sum(b[1:i]) + coalesce(list_sum(h[1:i - 1]), 0) AS first, list_sum(b[1:i]) + list_sum(h[1:i]) AS until
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM units)),
kept AS (
  SELECT * FROM found x WHERE NOT EXISTS (
    SELECT 1 FROM found y WHERE y.row_no = x.row_no AND y.first <= x.first AND y.until >= x.until AND y.priority >= x.priority
      AND (y.first < x.first OR y.until > x.until OR y.priority > x.priority OR y.number < x.number))),
covered AS (
  SELECT row_no, sum(greatest(until - greatest(first, reach), 0)) AS n FROM (
    SELECT *, coalesce(max(until) OVER (PARTITION BY row_no ORDER BY first, until DESC, priority DESC, number
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM kept)
  GROUP BY row_no),
base AS (
  SELECT row_no, count(*) AS n, min(first) AS first, max(first) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM found WHERE priority = {BASE} GROUP BY row_no),
every AS (
  SELECT row_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row_no, label FROM kept UNION SELECT row_no, label FROM found WHERE priority = {BASE}) GROUP BY row_no)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first::BIGINT AS first_word, base.last::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN covered.n IS NULL THEN 0.0 ELSE covered.n / n_words END::DOUBLE AS score
FROM words LEFT JOIN base USING (row_no) LEFT JOIN every USING (row_no) LEFT JOIN covered USING (row_no)
"""

"""Quality rules by host, in DataFrame functions alone.

Each text is measured and tried against rules.  Failures are counted by host (the source), each host's rate is shrunk towards
the mean of all hosts by a beta prior that is fitted to the hosts themselves, and the host's verdicts go back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, cut, words

#: Rules that mark a document (SQL over the measures), and from which shrunk rate of its host on a mark rejects.  The first is the
#: base rule: it rejects by itself, and on a host beyond its rate all documents go.
RULES = {
    "base_failed": ("n_words < 10 OR 100 * n_repeat_words > 20 * n_words", 0.5),
    "many_symbols": ("10 * n_symbols > n_words", 0.25),
    "many_dup_lines": ("10 * n_dup_lines > 3 * n_lines", 0.25),
}
SYMBOLS = "#*$%&|<>"
#: Limits of the prior's weight in documents.
PRIOR = (1.0, 1e6)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        marked = _bound(
            F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
        )
        places = F.array_sort(F.transform(marked, lambda x: x["i"]))
        return _bound(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, x: a + x))

    def some(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(5))))
        return F.when(F.size(w) > 5, _bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)

    return _bound(ws, some)  # else a filter that is pushed down would split the text anew for each word


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of whole texts (null: like empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumn("_words", words(F.col(text_col))).withColumn("_lines", lines)
    return split.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def host_rates(marked: DataFrame, host: str = "host", rules: dict[str, tuple[str, float]] = RULES) -> DataFrame:
    """Table (host, documents, <rule>_rate): each host's failure rate under each rule, shrunk by the rule's empirical beta prior.

    The prior's mean is the rate over all documents.  Its weight follows from how the hosts' rates spread about it, without what
    drawing few documents from a host spreads them anyway: with S = sum n (r - m)^2 over hosts of n documents, H hosts and N
    documents, the share of variance between hosts is (S / (m (1 - m)) - (H - 1)) / (N - (H - 1) - sum n^2 / N), and the weight is
    1 / share - 1, within PRIOR.  Without a share (hosts of one document each, say) the weight is the greatest.
    """
    counts = marked.groupBy(host).agg(F.count("*").alias("documents"), *(F.sum(F.col(r).cast("long")).alias(r) for r in rules))
    counts = cut(counts, "hosts")
    n = F.col("documents").cast("double")
    total = counts.agg(F.sum("documents").alias("documents"), F.count("*").alias("hosts"), F.sum(n * n).alias("squares"), *(F.sum(r).alias(r) for r in rules)).head()
    mean = {r: (total[r] or 0) / (total.documents or 1) for r in rules}
    spread = counts.agg(*(F.sum(n * F.pow(F.col(r) / n - F.lit(mean[r]), 2)).alias(r) for r in rules)).head()
    out = []
    for r in rules:
        m, weight = mean[r], PRIOR[1]
        room = total.documents - (total.hosts - 1) - total.squares / total.documents if total.documents else 0.0
        if 0 < m < 1 and room > 0 and (share := (spread[r] / (m * (1 - m)) - (total.hosts - 1)) / room) > 0:
            weight = min(max(1 / share - 1, PRIOR[0]), PRIOR[1])
        out.append(((F.col(r) + F.lit(weight * m)) / (F.col("documents") + F.lit(weight))).alias(f"{r}_rate"))
    return counts.select(host, "documents", *out)


def _marked(docs: DataFrame, text_col: str, source_col: str, rules: dict[str, tuple[str, float]]) -> DataFrame:
    measured = measures(docs.withColumn("_host", F.col(source_col).cast("string")), text_col)
    return measured.select("*", *(F.expr(rule).alias(r) for r, (rule, _) in rules.items()))


def _verdict(marked: DataFrame, hosts: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    base, *soft = rules
    hosts = hosts.withColumnRenamed("_host", "_h").withColumnRenamed("documents", "host_documents")
    joined = marked.join(checked(cut(hosts, "host_rates")), F.col("_host").eqNullSafe(F.col("_h")))
    bad = F.col(base) | (F.col(f"{base}_rate") > rules[base][1])
    for r in soft:
        bad = bad | (F.col(r) & (F.col(f"{r}_rate") > rules[r][1]))
    return joined.withColumn("kept", ~bad)


def apply_host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rules: dict[str, tuple[str, float]] = RULES) -> DataFrame:
    """A row for each document: its id, the measures, the rules it fails, its host's size and shrunk rates, and kept.

    A document that fails the base rule goes; so does every document of a host whose shrunk base rate is over its limit, and one
    that another rule marks on a host whose shrunk rate under that rule is over the rule's limit.  Null and empty texts have no
    words and fail; a null source is a host; null ids and repeated rows come back as they are.  Other columns are ignored.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    marked = cut(_marked(picked, "_text", "_source", rules).drop("_text", "_source"), "measures")
    return _verdict(marked, host_rates(marked, "_host", rules), rules).drop("_host", "_h")


def keep_by_host_rules(docs: DataFrame, text_col: str = "text", source_col: str = "source", rules: dict[str, tuple[str, float]] = RULES) -> DataFrame:
    """The documents that ``apply_host_rules`` keeps, with their own columns; they are written once with their marks, so that no
    text is measured twice or shuffled."""
    own = [f"_own{i}" for i in range(len(docs.columns))]
    safe = docs.toDF(*own)
    text, source = own[docs.columns.index(text_col)], own[docs.columns.index(source_col)]
    marked = cut(_marked(safe, text, source, rules).select(*own, "_host", *rules), "marked")
    return _verdict(marked, host_rates(marked, "_host", rules), rules).where("kept").select(*own).toDF(*docs.columns)


def rules_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the query over a table or subquery of documents."""
    each = lambda f: ", ".join(f.format(r) for r in RULES)
    share = "CASE WHEN m_{0} > 0 AND m_{0} < 1 AND room > 0 THEN (v_{0} / (m_{0} * (1 - m_{0})) - (hosts - 1)) / room ELSE 0 END AS p_{0}"
    weight = "CASE WHEN p_{0} > 0 THEN least(greatest(1 / p_{0} - 1, 1.0), 1e6) ELSE 1e6 END AS w_{0}"
    base, *soft = RULES
    bad = f"{base} OR r_{base} > {RULES[base][1]}" + "".join(f" OR ({r} AND r_{r} > {RULES[r][1]})" for r in soft)
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM {documents} AS given),
s AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM s WHERE len(ws) > 5),
x AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS k FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT doc_id, unnest(list(i)) AS i, count(*) AS n FROM x WHERE k IS NOT NULL GROUP BY doc_id, k HAVING count(*) > 1),
z AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM y WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM s LEFT JOIN z USING (doc_id)),
d AS (SELECT *, {', '.join(f'({rule}) AS {r}' for r, (rule, _) in RULES.items())} FROM m),
h AS (SELECT source, count(*) AS documents, {each('count(*) FILTER ({0}) AS f_{0}')} FROM d GROUP BY source),
g AS (SELECT count(*) AS hosts, sum(documents) - (count(*) - 1) - sum(documents::DOUBLE * documents) / sum(documents) AS room, {each('sum(f_{0}) / sum(documents) AS m_{0}')} FROM h),
v AS (SELECT {each('sum(documents * pow(f_{0} / documents - m_{0}, 2)) AS v_{0}')} FROM h, g),
p AS (SELECT g.*, {each(share)} FROM g, v),
w AS (SELECT *, {each(weight)} FROM p),
r AS (SELECT source, documents, {each('(f_{0} + w_{0} * m_{0}) / (documents + w_{0}) AS r_{0}')} FROM h, w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT ({bad}) AS kept,
  documents AS host_documents, {each('round(r_{0}, 9) AS {0}_rate')}
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

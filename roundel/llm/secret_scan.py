"""Secret scans with built-in expressions only: three fixed kinds and sliding-window entropy.

The fixed kinds are patterns. The entropy kind looks at candidate strings, each by its character
class: a window of fixed width slides over the candidate, counts of its characters change by the one
that enters and the one that leaves, and with them sum(n * log2 n), from which the window's Shannon
entropy follows. The span runs from the first window at or over the class's limit to the end of the
last one. Candidates on the allow list, and spans that touch a fixed kind's span, are left out.
All is one pass over each text, without a shuffle; a row depends on itself alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, unused

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Character class: pattern of a candidate, window, bits that a window needs, what a candidate must also contain.
CLASSES = (
    ("[0-9A-F]{32,}", 32, 3.0, "[A-F]"),
    ("[A-Za-z0-9+/_-]{24,}", 24, 3.9, "(?s)(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"),
)
#: More of them, for redaction alone: lower-case letters and digits, and base32. The query's SQL has only CLASSES.
MORE_CLASSES = (
    ("[a-z0-9]{24,}", 24, 3.4, "(?s)(?=.*[0-9])(?=.*[a-z])"),
    ("[A-Z2-7]{24,}", 24, 3.3, "(?s)(?=.*[2-7])(?=.*[A-Z])"),
)
#: Candidates that hold one of these are no secrets: counting sequences, stand-ins, inline images.
ALLOW = ("0123456789", "abcdefghij", "ABCDEFGHIJ", "EXAMPLE", "example", "xxxxxxxx", "XXXXXXXX", "iVBORw0KGgo", "R0lGODlh")

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _located(text: Column, pattern: str, value: int, least: int, kind: int) -> Column:
    """Spans of the pattern's matches whose group `value` has `least` characters; positions are sums of the lengths of gaps and matches."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["all"])
        new = F.when(F.length(x["value"]) >= least, F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))).otherwise(_none())
        return F.struct(stop.alias("at"), F.concat(acc["out"], new).alias("out"))

    located = F.filter(parts, lambda x: x["all"].isNotNull())
    return F.aggregate(located, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda acc: acc["out"])


def _plogp(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(0.0)


def _entropy_span(letters: Column, start: Column, width: int, bits: float) -> Column:
    """(start, stop) of the windows over the letters at or over the limit; -1 without one."""
    high = lambda total: F.lit(math.log2(width)) - total / width >= bits - 1e-9

    def code(i: Column) -> Column:
        return F.ascii(F.get(letters, i - 1))

    def step(acc: Column, i: Column) -> Column:
        enters, leaves = code(i), F.when(i > width, code(F.greatest(i - width, F.lit(1)))).otherwise(-1)
        count = lambda c: F.get(acc["counts"], c)
        gain = _plogp(count(enters) + 1) - _plogp(count(enters))
        loss = F.when(leaves >= 0, _plogp(count(leaves)) - _plogp(count(leaves) - 1)).otherwise(0.0)
        seen = (i > width) & high(acc["total"])  # the window that ended one character earlier
        return F.struct(
            F.transform(acc["counts"], lambda n, c: n + F.when(c == enters, 1).otherwise(0) - F.when(c == leaves, 1).otherwise(0)).alias("counts"),
            F.when(enters == leaves, acc["total"]).otherwise(acc["total"] + gain - loss).alias("total"),
            F.when(seen & (acc["first"] < 0), i - 1 - width).otherwise(acc["first"]).alias("first"),
            F.when(seen, i - 1).otherwise(acc["last"]).alias("last"),
        )

    def end(acc: Column) -> Column:
        seen, n = high(acc["total"]), F.size(letters)
        return F.struct((start + F.when(seen & (acc["first"] < 0), n - width).otherwise(acc["first"])).alias("start"), F.when(seen, start + n).when(acc["first"] < 0, -1).otherwise(start + acc["last"]).alias("stop"))

    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.size(letters)), zero, step, end)


def _entropy(text: Column, pattern: str, width: int, bits: float, needs: str, allow: tuple[str, ...]) -> Column:
    def spans(x: Column) -> Column:
        word = F.substring(text, x["start"] + 1, x["stop"] - x["start"])
        known = F.lit(False)
        for a in allow:
            known = known | word.contains(a)
        found = F.transform(F.transform(F.array(F.split(word, "")), lambda letters: _entropy_span(letters, x["start"], width, bits)), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["stop"].alias("stop")))
        return F.when(word.rlike(needs) & ~known, F.filter(found, lambda s: s["stop"] >= 0)).otherwise(_none())

    return F.flatten(F.transform(_located(text, pattern, 0, width, 3), spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW, whole: bool = False, found: str = "found") -> DataFrame:
    """Docs with the column `found` (or of another name): spans (start, kind, stop) in code points, by start and then kind, the end exclusive.

    A null or empty text has none. Rows are judged one by one, so repeated rows get equal results and
    an empty table stays empty. Long texts are scanned whole. All columns of docs stay, whatever their
    names; only one called as `found` says is replaced. With `whole`, MORE_CLASSES are looked for too and entropy spans stay where they overlap others, as redaction needs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    small = F.lower(text)
    named = F.lit(False)
    for w in WORDS:
        named = named | small.contains(w)
    base = F.concat(
        F.when(named, _located(text, ASSIGN, 2, MIN_VALUE, 0)).otherwise(_none()),
        F.when(text.contains("AKIA"), _located(text, ACCESS, 0, MIN_ACCESS, 1)).otherwise(_none()),
        F.when(text.rlike(f"[0-9a-f]{{{MIN_HEX}}}"), _located(text, f"[0-9a-f]{{{MIN_HEX},}}", 0, MIN_HEX, 2)).otherwise(_none()),
    )
    more = [F.when(text.rlike(pattern), _entropy(text, pattern, width, bits, needs, allow)).otherwise(_none()) for pattern, width, bits, needs in (*CLASSES, *(MORE_CLASSES if whole else ()))]
    if whole:
        return docs.withColumn(found, F.array_sort(F.array_distinct(F.concat(base, *more))))
    fixed = unused([*docs.columns, found], "fixed")
    added = unused([*docs.columns, found], "added")
    out = docs.withColumns({fixed: base, added: F.array_sort(F.concat(*more))})
    # the classes overlap: of two entropy spans that touch, the earlier stays
    touch = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    apart = F.aggregate(added, _none(), lambda acc, s: F.when(F.exists(acc, lambda b: touch(s, b)), acc).otherwise(F.concat(acc, F.array(s))))
    new = F.filter(apart, lambda s: ~F.exists(fixed, lambda b: touch(s, b)))
    return out.withColumn(found, F.array_sort(F.concat(fixed, new))).drop(fixed, added)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [SECRET]; overlapping spans become one."""
    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        cut = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(cut))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(F.concat_ws("", F.transform(acc["out"], lambda p: F.concat(p, F.lit("[SECRET]")))), F.substring(text, acc["at"] + 1, F.length(text))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql_spans(source: str, text: str, key: str, pattern: str, kind: int, least: int, group: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    return f"""(SELECT {key}, {kind} AS kind, s AS start, s + len(m) AS stop, m FROM (
  SELECT {key}, m, v, sum(len(g) + len(m)) OVER (PARTITION BY {key} ORDER BY i) - len(m) AS s FROM (
    SELECT {key}, unnest(range(1, len(ms) + 1)) AS i, unnest(gs[1:len(ms)]) AS g, unnest(ms) AS m, unnest(vs) AS v FROM (
      SELECT {key}, string_split_regex({text}, '{quoted}') AS gs, regexp_extract_all({text}, '{quoted}') AS ms, regexp_extract_all({text}, '{quoted}', {group}) AS vs FROM {source}))) WHERE len(v) >= {least})"""


def _sql_entropy(pattern: str, width: int, bits: float, tests: str) -> str:
    allow = " AND ".join(f"NOT contains(m, '{a}')" for a in ALLOW)
    return f"""(SELECT doc_id, 3 AS kind, c + min(p) - 1 AS start, c + max(p) - 1 + {width} AS stop, '' AS m FROM (
  SELECT doc_id, c, p, log2({width}) - sum(n * log2(n)) / {width} AS h FROM (
    SELECT doc_id, c, p, substr(m, p + q, 1) AS ch, count(*) AS n FROM (
      SELECT doc_id, c, m, p, unnest(range(0, {width})) AS q FROM (
        SELECT doc_id, start AS c, m, unnest(range(1, len(m) - {width} + 2)) AS p FROM {_sql_spans('d', 'text', 'doc_id', pattern, 3, width)} WHERE {tests} AND {allow})) GROUP BY ALL) GROUP BY ALL)
  WHERE h >= {bits} - 1e-9 GROUP BY doc_id, c)"""


SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS MATERIALIZED (SELECT doc_id, kind, start::BIGINT AS start, stop::BIGINT AS stop FROM {_sql_spans('d', 'text', 'doc_id', ASSIGN, 0, MIN_VALUE, 2)}
  UNION ALL SELECT doc_id, kind, start, stop FROM {_sql_spans('d', 'text', 'doc_id', ACCESS, 1, MIN_ACCESS)}
  UNION ALL SELECT doc_id, kind, start, stop FROM {_sql_spans('d', 'text', 'doc_id', HEX, 2, MIN_HEX)}),
u AS MATERIALIZED (SELECT doc_id, 0 AS cls, start::BIGINT AS start, stop::BIGINT AS stop FROM {_sql_entropy(CLASSES[0][0], CLASSES[0][1], CLASSES[0][2], "regexp_matches(m, '[A-F]')")}
  UNION ALL SELECT doc_id, 1, start, stop FROM {_sql_entropy(CLASSES[1][0], CLASSES[1][1], CLASSES[1][2], "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')")}),
x AS (SELECT DISTINCT doc_id, 3 AS kind, start, stop FROM u
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = u.doc_id AND b.start < u.stop AND u.start < b.stop)
  AND NOT EXISTS (SELECT 1 FROM u o WHERE o.doc_id = u.doc_id AND (o.start < u.start OR o.start = u.start AND o.stop < u.stop) AND u.start < o.stop)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM x),
t AS (SELECT doc_id, kind, start, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS s FROM a),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

"""Secret scans: strong matches always, weak ones where the parts of a credential lie together.

A credential has an identifier (who), a secret (the proof) and an endpoint (where). Assignments, access key ids and hexadecimal
runs are reported wherever they stand. A login, a bare token or an address alone means nothing; each is reported only if parts
that complete it lie within REACH in the same scope, a stretch of text without an empty line. The interval join that finds them is
a range frame over each scope's parts in order, so no pairs are made.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import save, table


def _any_case(word: str) -> str:
    """A pattern for the word in capitals, lower case or both, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _setting(words: str, value: str) -> str:
    """A pattern for one of the words (by bars), a colon or equals sign, and the value as group 2; quotes may be about."""
    return rf"""({"|".join(map(_any_case, words.split("|")))})["']?\x20*[:=]\x20*["']?({value})"""


ASSIGN = _setting("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+")
LOGIN = _setting("username|user|login|account|client_?id|key_?id", "[A-Za-z0-9@._+-]+")

#: Kinds in the order of equal starts: a pattern; a test of the match that must hold too (None: no other); and words of which a
#: text with a match has one, in lower case (none: nothing is known), because they are found faster. No match has a line end.
KINDS = {
    "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, ["password", "passwd", "secret", "token", "api"]),
    "access": (r"AKIA[A-Z0-9]{14,}", None, ["akia"]),
    "hex": (r"[0-9a-f]{16,}", None, []),
    "login": (LOGIN, lambda m: F.length(F.regexp_extract(m, LOGIN, 2)) >= 3, ["user", "login", "account", "client", "key"]),
    "bare": (r"[A-Za-z0-9+/]{20,}={0,2}", lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"), []),
    "endpoint": (r"""(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+""", None, ["://"]),
}
#: Kinds that are reported wherever they stand.
BASE = ["assign", "access", "hex"]
#: Between scopes.
BREAK = r"\n[\x20\t\r]*\n"
#: Code points between the starts of parts that belong together, at most.
REACH = 400

_PART = "array<struct<kind: int, number: int, gap: int, length: int, holds: boolean>>"


def _matches(kind: str, only: Column | None = None) -> Column:
    """All leftmost matches in `text` that do not overlap: how far each is from the one before, its length and its test.

    Only texts that pass `only` are looked at.
    """
    pattern, holds, hints = KINDS.get(kind, (BREAK, None, []))
    text, number = F.col("text"), [*KINDS, "break"].index(kind)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))  # each text is read once for each
    both = F.filter(both, lambda x: x["m"].isNotNull())  # the last gap has no match behind it

    def part(x: Column, i: Column) -> Column:
        good = holds(x["m"]) if holds else F.lit(True)
        return F.struct(F.lit(number).alias("kind"), i.alias("number"), x["gap"].alias("gap"), F.length(x["m"]).alias("length"), good.alias("holds"))

    there = text.rlike(pattern)
    if hints:
        there = reduce(or_, [F.contains("lowered", F.lit(h)) for h in hints]) & there
    return F.when(there if only is None else only & there, F.transform(both, part)).otherwise(F.array().cast(_PART)).cast(_PART)


def spans(docs: DataFrame, carried: tuple = ("doc_id",), reach: int = REACH) -> DataFrame:
    """The carried columns of docs (text, ...), slim ones, with `spans`: an array of (start, kind, end) in order.

    Places are in code points, ends are exclusive, and `kind` is the place of the name in KINDS. A null text counts as empty and,
    like any text without parts, has an empty array; repeated rows are rows of their own; an empty table stays empty. Texts are
    searched whole where they are read; from there only places move, in one shuffle by row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*carried).alias("row"), F.monotonically_increasing_id().alias("key"), text.alias("text"), F.lower(text).alias("lowered"))
    first = [*BASE, "login"]
    rows = rows.select("*", *[_matches(k).alias(k) for k in first])
    has = lambda kind: F.exists(kind, lambda p: p["holds"])
    rows = rows.withColumn("identified", has("access") | has("login"))
    rows = rows.select("*", *[_matches(k, F.col("identified")).alias(k) for k in ("bare", "endpoint")])
    proven, weak = has("assign") | has("hex") | has("bare"), has("login") | has("bare") | has("endpoint")
    rows = rows.withColumn("useful", F.col("identified") & proven & weak)
    weak = F.concat("login", "bare", "endpoint", _matches("break"))
    parts = F.concat(*BASE, F.when(F.col("useful"), weak).otherwise(F.array().cast(_PART))).alias("parts")
    rows = save(rows.select("row", "key", parts), "secret-parts")
    placed = rows.select("row", "key", F.explode_outer("parts").alias("part")).select("row", "key", "part.*").repartition("key")
    upto = Window.partitionBy("key", "kind").orderBy("number")
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(upto)
    placed = placed.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    number = {kind: i for i, kind in enumerate([*KINDS, "break"])}
    of = lambda *kinds: F.col("holds") & F.col("kind").isin([number[k] for k in kinds])
    before = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.when(of("assign", "endpoint"), F.col("end"))).over(before) > F.col("start")
    scope = F.count(F.when(of("break"), 1)).over(before)
    placed = placed.withColumn("scope", scope).withColumn("holds", F.col("holds") & ~(of("bare") & F.coalesce(covered, F.lit(False))))
    near = Window.partitionBy("key", "scope").orderBy("start").rangeBetween(-reach, reach)
    has = lambda *kinds: F.max(of(*kinds)).over(near)
    placed = placed.select("*", has("access").alias("known"), has("assign", "hex").alias("proven"), has("login").alias("named"), has("bare").alias("token"), has("endpoint").alias("address"))
    linked = (
        F.when(of("login"), F.col("proven") | (F.col("token") & F.col("address")))
        .when(of("bare"), F.col("known") | (F.col("named") & F.col("address")))
        .when(of("endpoint"), (F.col("known") | F.col("named")) & (F.col("proven") | F.col("token")))
        .otherwise(of(*BASE))
    )
    listed = F.sort_array(F.collect_list(F.when(linked, F.struct("start", "kind", "end")))).alias("spans")
    return placed.groupBy("key").agg(F.first("row").alias("row"), listed).select("row.*", "spans")


def listed(found: Column) -> Column:
    """kind:start:end of each span, by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans; null texts, ties and repeated rows are as in `spans`."""
    found = spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    tests = {
        "assign": f"length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= 12",
        "login": f"length(regexp_extract(m, {quoted(LOGIN)}, 2)) >= 3",
        "bare": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')",
    }
    patterns = [*((kind, pattern) for kind, (pattern, _, _) in KINDS.items()), ("break", BREAK)]
    found = "\nUNION ALL\n".join(
        f"  SELECT r, {i} AS kind, generate_subscripts(ms, 1) AS number, unnest(ms) AS m, unnest(gs[1 : len(ms)]) AS gap FROM (SELECT r, regexp_extract_all(text, {quoted(p)}, 0) AS ms, string_split_regex(text, {quoted(p)}) AS gs FROM d)"
        for i, (_, p) in enumerate(patterns)
    )
    holds = " ".join(f"WHEN {i} THEN {tests[kind]}" for i, (kind, _) in enumerate(patterns) if kind in tests)
    names = " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (
{found}),
p AS (
  SELECT r, kind, number, CASE kind {holds} ELSE true END AS holds, length(m) AS n, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY number) AS BIGINT) AS stop
  FROM f),
q AS (
  SELECT r, kind, stop - n AS start, stop, holds, count(CASE WHEN holds AND kind = 6 THEN 1 END) OVER b AS scope,
         coalesce(max(CASE WHEN holds AND kind IN (0, 5) THEN stop END) OVER b > stop - n, false) AS covered
  FROM p WINDOW b AS (PARTITION BY r ORDER BY stop - n, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT r, kind, start, stop, scope FROM q WHERE holds AND kind < 6 AND NOT (kind = 4 AND covered)),
n AS (
  SELECT *, max(CAST(kind = 1 AS INT)) OVER w AS known, max(CAST(kind IN (0, 2) AS INT)) OVER w AS proven, max(CAST(kind = 3 AS INT)) OVER w AS named,
         max(CAST(kind = 4 AS INT)) OVER w AS token, max(CAST(kind = 5 AS INT)) OVER w AS address
  FROM l WINDOW w AS (PARTITION BY r, scope ORDER BY start RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING)),
k AS (
  SELECT r, kind, start, concat(CASE kind {names} END, ':', start, ':', stop) AS span
  FROM n
  WHERE CASE kind WHEN 3 THEN proven + token * address WHEN 4 THEN known + named * address WHEN 5 THEN (known + named) * (proven + token) ELSE 1 END > 0)
SELECT any_value(d.doc_id) AS doc_id, count(CASE WHEN kind = 0 THEN 1 END) AS n_assign, count(CASE WHEN kind = 1 THEN 1 END) AS n_access, count(CASE WHEN kind = 2 THEN 1 END) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN k USING (r) GROUP BY d.r
"""


OP12_SQL = _sql()

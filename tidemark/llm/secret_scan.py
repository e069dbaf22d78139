"""Secret scans: named patterns, and sliding-window entropy over candidate strings, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the scan: the base patterns, each with the least length of what must be long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that have 32 or more characters
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

WINDOW = 20
#: Least bits a character in some window, by the class of the candidate's characters.
ENTROPY = {"hex": 3.05, "alnum": 3.55, "base64": 3.65}
#: A candidate that one of these matches is no secret: UUIDs, letters only, digits only, rows of one sign, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z_=/+-]*$",
    r"^[0-9_=/+-]*$",
    r"(?i)example|placeholder|changeme|xxxxxx",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<s:bigint,k:int,e:bigint,kind:string,m:string>>"


def found(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Start and end in code points of every leftmost match: the pieces between matches give the offsets."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), hits.alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(SPAN).alias("out"))
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), F.lit(order).alias("k"), e.alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))
        return F.struct(e.alias("at"), F.concat(F.coalesce(acc["out"], empty), F.when(x["m"].isNotNull(), one).otherwise(empty)).cast(SPAN).alias("out"))

    spans = F.aggregate(zipped, start, step, lambda a: F.coalesce(a["out"], empty))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def least_sum(m: Column, window: int) -> Column:
    """Least sum of c * log2(c) over the counts c of a window's characters; counts change by one in and one out."""
    g = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(m, i, F.lit(1)))
    n = len(ALPHABET)
    counts = F.aggregate(F.sequence(F.lit(1), F.lit(window)), F.array_repeat(F.lit(0), n), lambda a, i: F.transform(a, lambda c, j: c + (j + 1 == code(i)).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, c: s + g(c))
    first = F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), total(c).alias("s"), total(c).alias("best")))[0]

    def step(acc: Column, i: Column) -> Column:
        old, new = code(i - window), code(i)
        a, b = F.element_at(acc["c"], old), F.element_at(acc["c"], new)
        s = F.when(old == new, acc["s"]).otherwise(acc["s"] - g(a) + g(a - 1) - g(b) + g(b + 1))
        c = F.transform(acc["c"], lambda x, j: x + (j + 1 == new).cast("int") - (j + 1 == old).cast("int"))
        return F.struct(c.alias("c"), s.alias("s"), F.least(acc["best"], s).alias("best"))

    rest = F.when(F.length(m) > window, F.sequence(F.lit(window + 1), F.length(m))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, first, step, lambda a: a["best"])


def window_entropy(m: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of any window of m, rounded to 9 places."""
    import math

    return F.round(F.lit(math.log2(window)) - least_sum(m, window) / F.lit(float(window)), 9)


def scan_secrets(docs: DataFrame, text_col: str = "text", window: int = WINDOW, allow: tuple[str, ...] = ALLOW, out_col: str = "secret_spans") -> DataFrame:
    """Adds out_col: an array of (start, kind's order, end, kind, match), in code points with an exclusive end, in order.

    Kinds: assign, access and hex by pattern, each scanned from the left on its own, matches that are too short
    dropped; entropy for strings of 20 or more characters of [A-Za-z0-9+/_=-] in which some window of 20 has the
    entropy that its class of characters (hexadecimal, alphanumeric, other) asks for, unless the allow-list matches
    the string or a pattern's span overlaps it. Null and empty texts have no spans. A column of docs named out_col
    is replaced, all others stay; rows are judged one by one, so ties, repeated rows and empty tables need no rule.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    assign = F.filter(found(text, ASSIGN, "assign", 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
    access = F.filter(found(text, ACCESS, "access", 1), lambda x: F.length(x["m"]) >= 16)
    d = docs.drop(out_col).withColumn("__base", F.concat(assign, access, found(text, HEX, "hex", 2)))
    d = d.withColumn("__cand", F.filter(found(text, CANDIDATE, "entropy", 3), lambda x: ~_allowed(x["m"], allow)))
    kept = F.filter("__cand", lambda x: ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    kept = F.filter(kept, lambda x: window_entropy(x["m"], window) >= _threshold(x["m"]))
    return d.withColumn(out_col, F.when(F.size("__cand") > 0, F.array_sort(F.concat("__base", kept))).otherwise(F.array_sort("__base"))).drop("__base", "__cand")


def _allowed(m: Column, allow: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in allow:
        out = out | F.regexp_like(m, F.lit(pattern))
    return out


def _threshold(m: Column) -> Column:
    return F.when(m.rlike("^[0-9a-fA-F]+$"), ENTROPY["hex"]).when(m.rlike("^[0-9A-Za-z]+$"), ENTROPY["alnum"]).otherwise(ENTROPY["base64"])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by a mark, spans that overlap by one; same columns and rows. Null stays null."""
    d = scan_secrets(docs, text_col, out_col="__spans")
    text = F.col(f"`{text_col}`")
    # Parts up to each span, skipping what an earlier span has covered; then the rest.
    init = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.when(x["s"] >= a["at"], F.concat(F.substring(text, a["at"].cast("int") + 1, (x["s"] - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    new = F.aggregate("__spans", init, step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    return d.withColumn(text_col, F.when(F.size("__spans") > 0, new).otherwise(text)).select(docs.columns)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest and all spans of every document."""
    d = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda x: x["k"] < 3)
    n = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    return d.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def _sql_spans(name: str, src: str, pattern: str, kind: str, order: int) -> str:
    return f"""{name} AS (SELECT doc_id, rid, m[i] AS m, {order} AS k, '{kind}' AS kind,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, rid, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM {src})))"""


_LETTERS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]")
_SQL_ASSIGN = rf"""({_LETTERS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALLOW_SQL = " OR ".join(f"regexp_matches(m, '{a}')" for a in ALLOW)
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
{_sql_spans("a", "d", _SQL_ASSIGN, "assign", 0)},
{_sql_spans("c", "d", ACCESS, "access", 1)},
{_sql_spans("h", "d", HEX, "hex", 2)},
{_sql_spans("e", "d", CANDIDATE, "entropy", 3)},
base AS (SELECT rid, k, kind, s, s + length(m) AS t FROM a WHERE length(regexp_extract(m, '{_SQL_ASSIGN}', 2)) >= 8
  UNION ALL SELECT rid, k, kind, s, s + length(m) FROM c WHERE length(m) >= 16
  UNION ALL SELECT rid, k, kind, s, s + length(m) FROM h),
cand AS (SELECT rid, k, kind, s, s + length(m) AS t, m FROM e WHERE NOT ({_ALLOW_SQL})),
ent AS (SELECT * FROM cand WHERE NOT EXISTS (FROM base b WHERE b.rid = cand.rid AND b.s < cand.t AND cand.s < b.t)
  AND round(list_max(list_transform(range(1, length(m) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy'))), 9)
    >= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {ENTROPY["hex"]} WHEN regexp_matches(m, '^[0-9A-Za-z]+$') THEN {ENTROPY["alnum"]} ELSE {ENTROPY["base64"]} END),
every AS (SELECT rid, k, kind, s, t FROM base UNION ALL SELECT rid, k, kind, s, t FROM ent),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || s::BIGINT || ':' || t::BIGINT, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || s::BIGINT || ':' || t::BIGINT, ',' ORDER BY s, k) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

"""URL filter: rules of hosts and paths, and for other URLs gradient-boosted trees on lexical features; DataFrame functions only.

Trees are learned from URLs that have a verdict. Their features are whole numbers below 64, so learning needs the sums of
gradients by node, feature and value only: one grouped aggregation a level of a tree. All sums are of whole numbers, so
neither partitions nor their order change a tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, written

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TREES, DEPTH, BINS, RATE, LAMBDA, LEAF = 10, 2, 64, 0.3, 1_000_000, 10
MAX_LABELLED, LEAST_LABELLED, FOLDS = 100_000, 20, 5
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "host_length", "hyphens", "tld_share", "domain_share", "host_share", "ending_share")
SUFFIXES = ("tld", "domain", "host", "ending")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (between the first `://` and the first of / ? #, A-Z lower-cased) and path (from there to ? or #); both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits, the first of equals; null where none does.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the code points, in eighths of a bit: lengths of runs of the sorted code points, in millionths."""
    weight = lambda n: F.floor(n * F.log2(n.cast("double")) * 1_000_000 + 0.5)
    start = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    sorted_points = F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))  # whole code points, which a split isn't
    closed = lambda a: a["s"] + F.when(a["n"] > 1, weight(a["n"])).otherwise(0)
    summed = F.aggregate(
        sorted_points, start,
        lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), F.when(a["c"] == c, a["s"]).otherwise(closed(a)).alias("s")),
        closed,
    )
    n = F.greatest(F.length(text), F.lit(1)).cast("long")
    return F.floor((weight(n) - summed) * 8 / (n * 1_000_000))


def lexical(df: DataFrame, url_col: str, host_col: str, path_col: str) -> DataFrame:
    """Adds the eight lexical features, each below BINS, and the four suffixes. A null url counts as empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    count = lambda col, chars: F.length(col) - F.length(F.translate(col, chars, ""))
    path, host = F.col(path_col), F.col(host_col)
    features = {
        "length": F.floor(F.length(url) / 4), "depth": count(path, "/"), "digits": F.floor(count(url, "0123456789") * 63 / F.greatest(F.length(url), F.lit(1))), "entropy": _entropy(url),
        "params": count(url, "&=?"), "labels": count(host, "."), "host_length": F.length(host), "hyphens": count(host, "-"),
    }
    df = df.withColumns({k: F.least(v, F.lit(BINS - 1)).cast("int") for k, v in features.items()})
    last = F.substring_index(path, "/", -1)
    ending = F.when(F.instr(last, ".") > 0, F.substring_index(last, ".", -1)).when(last == "", F.lit("/")).otherwise(F.lit(""))
    return df.withColumns({"tld": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "host": host, "ending": ending})


def suffix_shares(sample: DataFrame) -> DataFrame:
    """level, suffix, fold, share: the smoothed share of blocked URLs with that suffix in all other folds, and in all (fold -1).

    Only of suffixes with LEAST_LABELLED labelled URLs: at most len(SUFFIXES) * rows of the sample / LEAST_LABELLED of them.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("level"), F.col(s).alias("suffix")) for s in SUFFIXES]))
    c = sample.select("y", "fold", each.alias("x")).groupBy("x.level", "x.suffix").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), *[f(F.when(F.col("fold") == k, v)).alias(f"{a}{k}") for k in range(FOLDS) for a, f, v in (("n", F.count, F.lit(1)), ("p", F.sum, F.col("y")))])
    c = c.filter(F.col("n") >= LEAST_LABELLED)
    folds = [F.struct(F.lit(-1).alias("fold"), F.col("n").alias("n"), F.col("pos").alias("pos"))]
    folds += [F.struct(F.lit(k).alias("fold"), (F.col("n") - F.col(f"n{k}")).alias("n"), (F.col("pos") - F.coalesce(F.col(f"p{k}"), F.lit(0))).alias("pos")) for k in range(FOLDS)]
    c = c.select("level", "suffix", F.explode(F.array(*folds)).alias("f"))
    return c.select("level", "suffix", "f.fold", F.floor((F.col("f.pos") + 1) * (BINS - 1) / (F.col("f.n") + 2)).cast("int").alias("share"))


def with_shares(df: DataFrame, shares: DataFrame, fold: Column) -> DataFrame:
    """Adds the four shares, half where a suffix has none. `shares` has a proven bound, so it is broadcast."""
    for s in SUFFIXES:
        one = shares.filter(F.col("level") == s).select(F.col("suffix").alias(f"__of_{s}"), F.col("fold").alias(f"__fold_{s}"), F.col("share").alias(f"{s}_share"))
        df = df.join(F.broadcast(one), (F.col(s) == F.col(f"__of_{s}")) & (F.col(f"__fold_{s}") == fold), "left").drop(f"__of_{s}", f"__fold_{s}")
        df = df.withColumn(f"{s}_share", F.coalesce(f"{s}_share", F.lit((BINS - 1) // 2)))
    return df


def _leaf(tree: list, node: int, depth: int, values: dict) -> Column:
    """The tree below a node as nested conditions; a node without a cut sends all rows to its left."""
    if depth == DEPTH:
        return F.lit(values.get(node, 0)).cast("long")
    cut = tree[depth].get(node)
    left = _leaf(tree, 2 * node, depth + 1, values)
    return left if cut is None else F.when(F.col(cut[0]) <= cut[1], left).otherwise(_leaf(tree, 2 * node + 1, depth + 1, values))


def boost(vectors: DataFrame, trees: int = TREES) -> Column:
    """Boosted trees for vectors (n, pos and the FEATURES) as one column: log odds of pos, in millionths.

    A round's trees are cut level by level, for all nodes at once, where the sum of squared gradients by curvature gains
    most (ties: first feature, least value); both sides need LEAF rows. Each level reads the vectors once and brings at
    most nodes * features * BINS sums to the driver.
    """
    score = F.lit(0).cast("long")
    odds = lambda s: F.floor(F.lit(1_000_000) / (F.exp(-s / 1_000_000) + 1) + 0.5)
    for _ in range(trees):
        p = odds(score)
        v = vectors.withColumn("g", F.col("pos") * 1_000_000 - F.col("n") * p).withColumn("h", F.col("n") * F.floor(p * (1_000_000 - p) / 1_000_000))
        node, tree, sums = F.lit(0), [], {}
        for _ in range(DEPTH):
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(name).alias("b")) for k, name in enumerate(FEATURES)]))
            rows = v.select(node.alias("node"), "n", "g", "h", each.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("n"), F.sum("g"), F.sum("h")).collect()
            by: dict[int, dict[int, list]] = {}
            for k, f, b, *nums in rows:
                by.setdefault(k, {}).setdefault(f, []).append((b, *nums))
            tree.append({k: c for k, fs in by.items() if (c := _best_cut(fs))})
            cut, at = tree[-1], node
            node = at * 2
            for k, (name, b) in cut.items():
                node = F.when(at == k, F.lit(2 * k) + (F.col(name) > b).cast("int")).otherwise(node)
        sums = {k: (g, h) for k, g, h in v.groupBy(node.alias("node")).agg(F.sum("g"), F.sum("h")).collect()}
        score = score + _leaf(tree, 0, 0, {k: math.floor(RATE * 1_000_000 * float(g) / (float(h) + LAMBDA)) for k, (g, h) in sums.items()})
    return score


def _best_cut(features: dict[int, list]) -> tuple[str, int] | None:
    found = (0.0, None)
    for f in sorted(features):
        rows = sorted(features[f])
        n, g, h = (sum(r[k] for r in rows) for k in (1, 2, 3))
        ln = lg = lh = 0
        for b, rn, rg, rh in rows:
            ln, lg, lh = ln + rn, lg + rg, lh + rh
            if min(ln, n - ln) >= LEAF:
                gain = float(lg) * float(lg) / float(lh + LAMBDA) + float(g - lg) * float(g - lg) / float(h - lh + LAMBDA) - float(g) * float(g) / float(h + LAMBDA)
                if gain > found[0]:
                    found = (gain, (FEATURES[f], b))
    return found[1]


def bounded(urls: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """About `most` of the rows (url, ...) at most: those whose md5 is below the share that fits. One count, no sort."""
    n = urls.count()
    h = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long")
    return urls if n <= most else urls.filter(h < F.lit(most * (1 << 32) // n))


def fit_urls(labelled: DataFrame, most: int = MAX_LABELLED, trees: int = TREES) -> tuple[DataFrame, Column]:
    """(shares of suffixes, score column) from labelled (url string, y: 1 block, 0 allow).

    Repeated URLs count once (of different labels the greatest), null ones not at all; more than `most` are a sample of
    about that size by hash. Shares of the rows that trees are learned from leave out a row's own fold. Without labels
    the score is 0.
    """
    d = labelled.filter(F.col("url").isNotNull() & F.col("y").isNotNull()).groupBy("url").agg(F.max("y").alias("y"))
    d = bounded(d, most)
    host, path = url_parts(F.col("url"))
    fold = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 9, 4), 16, 10).cast("int") % FOLDS
    sample = written(lexical(d.select("url", F.col("y").cast("long").alias("y"), fold.alias("fold"), host.alias("h"), path.alias("p")), "url", "h", "p").drop("url", "h", "p"), "url-sample")
    shares = written(suffix_shares(sample), "url-shares")
    vectors = with_shares(sample, shares, F.col("fold")).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    vectors = written(vectors, "url-vectors")
    score = boost(vectors, trees)
    forget(labelled.sparkSession, sample, vectors)
    return shares, score


def judge_urls(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, most: int = MAX_LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and score of every row: the rule's verdict, else block where the score is above 0.

    labelled (url, y) teaches the trees; by default it is the URLs that a rule judges. The score is the log odds of a block
    in millionths. Null urls, and those without `://`, have an empty host and path, fit no rule, and are judged by their
    features. Repeated rows share their verdict; an empty table gives an empty one; other columns aren't read. A url
    of any length is read whole; every feature of at least 63 falls into the last value.
    """
    host, path = url_parts(F.col(url_col))
    d = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host.alias("__host"), path.alias("__path"))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    d = d.withColumn("__rule", rule).withColumn("__verdict", verdict)
    if labelled is None:
        labelled = d.filter(F.col("__verdict").isNotNull()).select(F.col("__url").alias("url"), (F.col("__verdict") == "block").cast("int").alias("y"))
    shares, score = fit_urls(labelled, most)
    d = with_shares(lexical(d, "__url", "__host", "__path"), shares, F.lit(-1)).withColumn("__score", score)
    by_score = F.when(F.col("__score") > 0, "block").otherwise("allow")
    return d.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", by_score).alias("verdict"), F.col("__score").alias("score"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same in SQL: trees are tables of cuts, and vectors of all pages go along with no weight."""
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    count = lambda col, chars: f"(length({col}) - length(translate({col}, '{chars}', '')))"
    part = lambda n: f"CASE WHEN len(string_split(host, '.')) <= {n} THEN host ELSE array_to_string(string_split(host, '.')[-{n}:], '.') END"
    least = lambda x: f"least({x}, {BINS - 1})::INT"
    shares = lambda fold: ", ".join(f"coalesce((SELECT share FROM shares z WHERE z.level = '{s}' AND z.suffix = q.{s} AND z.fold = {fold}), {(BINS - 1) // 2})" for s in SUFFIXES)
    plain = ", ".join(FEATURES[: -len(SUFFIXES)])
    sql = [
        f"""u AS (SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages)""",
        f"""hp AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)""",
        f"""ru AS (SELECT *, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in cases)} END AS rule, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in cases)} END AS verdict FROM hp)""",
        """each AS (SELECT coalesce(url, '') AS url, host, path, max((verdict = 'block')::INT) AS y FROM ru GROUP BY coalesce(url, ''), host, path)""",
        """points AS (SELECT url, unnest(string_split(url, '')) AS c FROM each WHERE url <> '')""",
        """runs AS (SELECT url, sum(floor(k * log2(k) * 1000000 + 0.5))::BIGINT AS s FROM (SELECT url, c, count(*) AS k FROM points GROUP BY url, c) GROUP BY url)""",
        f"""lex AS (SELECT each.url, y, CASE WHEN y IS NOT NULL THEN ('0x' || substr(md5(each.url), 9, 4))::INT % {FOLDS} END AS fold, CASE WHEN y IS NOT NULL THEN ('0x' || substr(md5(each.url), 1, 8))::BIGINT END AS mark,
          {least("length(each.url) // 4")} AS length, {least(count("path", "/"))} AS depth, {least(f"floor({count('each.url', '0123456789')} * 63 / greatest(length(each.url), 1))")} AS digits,
          {least("floor((floor(greatest(length(each.url), 1) * log2(greatest(length(each.url), 1)) * 1000000 + 0.5) - coalesce(s, 0)) * 8 / (greatest(length(each.url), 1) * 1000000))")} AS entropy,
          {least(count("each.url", "&=?"))} AS params, {least(count("host", "."))} AS labels, {least("length(host)")} AS host_length, {least(count("host", "-"))} AS hyphens,
          {part(1)} AS tld, {part(2)} AS "domain", host, string_split(path, '/')[-1] AS last FROM each LEFT JOIN runs USING (url))""",
        """feat AS (SELECT *, CASE WHEN contains(last, '.') THEN string_split(last, '.')[-1] WHEN last = '' THEN '/' ELSE '' END AS ending FROM lex)""",
        f"""sample AS (SELECT * FROM feat WHERE y IS NOT NULL AND url <> '' AND ((SELECT count(*) FROM feat WHERE y IS NOT NULL) <= {MAX_LABELLED} OR mark < {MAX_LABELLED} * 4294967296 // (SELECT count(*) FROM feat WHERE y IS NOT NULL)))""",
        f"""suffixes AS ({" UNION ALL ".join(f"SELECT '{s}' AS level, {'"domain"' if s == 'domain' else s} AS suffix, fold, y FROM sample" for s in SUFFIXES)})""",
        f"""shares AS MATERIALIZED (SELECT level, suffix, k AS fold, floor((coalesce(sum(y) FILTER (fold <> k), 0) + 1) * {BINS - 1} / (count(*) FILTER (fold <> k) + 2))::INT AS share
          FROM suffixes, range(-1, {FOLDS}) f(k) GROUP BY level, suffix, k HAVING count(*) >= {LEAST_LABELLED})""",
        f"""seen AS (SELECT [{plain}, {shares("q.fold")}] AS x, 1 AS n, y FROM sample q UNION ALL SELECT [{plain}, {shares("-1")}], 0, 0 FROM feat q)""",
        """s0 AS MATERIALIZED (SELECT x, sum(n)::BIGINT AS n, sum(y)::BIGINT AS pos, 0::BIGINT AS s FROM seen GROUP BY x)""",
    ]
    for t in range(TREES):
        sql.append(f"""g{t}_0 AS MATERIALIZED (SELECT x, n, pos, s, 0 AS node, pos * 1000000 - n * p AS g, n * floor(p * (1000000 - p) / 1000000)::BIGINT AS h
          FROM (SELECT *, floor(1000000 / (exp(-s / 1000000) + 1) + 0.5)::BIGINT AS p FROM s{t}))""")
        for k in range(DEPTH):
            sql.append(f"""c{t}_{k} AS (SELECT node, f, b, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER a AS an, sum(g) OVER a AS ag, sum(h) OVER a AS ah
              FROM (SELECT node, f, x[f + 1] AS b, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM g{t}_{k}, range({len(FEATURES)}) r(f) GROUP BY ALL) WINDOW w AS (PARTITION BY node, f ORDER BY b), a AS (PARTITION BY node, f))""")
            gain = f"lg::DOUBLE * lg::DOUBLE / (lh + {LAMBDA})::DOUBLE + (ag - lg)::DOUBLE * (ag - lg)::DOUBLE / (ah - lh + {LAMBDA})::DOUBLE - ag::DOUBLE * ag::DOUBLE / (ah + {LAMBDA})::DOUBLE"
            sql.append(f"""k{t}_{k} AS MATERIALIZED (SELECT node, f, b FROM (SELECT node, f, b, {gain} AS gain FROM c{t}_{k} WHERE ln >= {LEAF} AND an - ln >= {LEAF}) WHERE gain > 0
              QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)""")
            sql.append(f"""g{t}_{k + 1} AS MATERIALIZED (SELECT g.* REPLACE (2 * g.node + coalesce((x[f + 1] > b)::INT, 0) AS node) FROM g{t}_{k} g LEFT JOIN k{t}_{k} k ON k.node = g.node)""")
        sql.append(f"""s{t + 1} AS MATERIALIZED (SELECT x, n, pos, s + floor({RATE} * 1000000 * g::DOUBLE / (h + {LAMBDA})::DOUBLE)::BIGINT AS s
          FROM (SELECT x, n, pos, s, sum(g) OVER w AS g, sum(h) OVER w AS h FROM g{t}_{DEPTH} WINDOW w AS (PARTITION BY node)))""")
    sql.append(f"scored AS (SELECT q.url, s.s AS score FROM (SELECT url, [{plain}, {shares('-1')}] AS x FROM feat q) q JOIN s{TREES} s USING (x))")
    return "WITH " + ",\n".join(sql) + """
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM ru JOIN scored ON scored.url = coalesce(ru.url, '')"""


ORACLE = _oracle()

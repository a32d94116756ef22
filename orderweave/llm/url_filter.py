"""URL filter: rules first, then the ratio of two character language models.

What the rules allow and block trains two smoothed variable-order Markov models, one of accepted and one of rejected URLs;
what no rule fits is judged by the difference of its log-likelihoods for each character against a calibrated mark.

* Contexts are as long as they were seen: a model of order k mixes each order's counts with the next lower order's
  probability (Witten-Bell), down to a uniform one; a context that a class never had leaves the lower order's as it is.
* All distinct URLs that a rule fits are counted, but for those held out (3 in 16, by a digest of the URL).
* The held-out ones calibrate: the mark is that which best tells them apart (balanced accuracy), in steps of 1/64; ties go
  to the mark nearest to 0, then to the lower one. Without held-out URLs of both kinds the mark is 0.

A URL's text is what follows its first `://`, with the host in lower case. Texts that rows share are counted and judged
once, so a hot URL is met before anything is shuffled. Models are tables of grams that grow with the input and are joined,
never gathered: their lower orders follow from grams already counted, and a log-ratio belongs to a gram of full length.
Log-ratios are kept in millionths, so that sums don't depend on the order of rows.

Cases: a null URL, or one without `://`, has an empty host, path and text, which no rule fits and the models judge; a null
id is kept as it is; repeated rows are judged alike, each in a row of its own; a very long URL is a row for each of its
characters; if no rule fits any URL, all texts score 0 and are allowed; an empty table gives none; other columns of the
input aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.llm.shared import kept

ORDER = 4
STEPS = 64
MILLION = 1_000_000
_ALL = 0x110000  # characters that there are, for the uniform probability
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule); a rule is a host, all of whose subdomains it fits, and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and text of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.call_function("substring", url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(rest, "(?s)^[^/?#]*(.*)$", 1))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if there is none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(text: Column, order: int) -> Column:
    """For each character of a text, and for its end, that character after the `order` before it."""
    padded = F.concat(F.array(*[F.lit(_START)] * order), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.array(F.lit(_END)))

    def each(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - order - 1), lambda i: F.concat(*(F.get(chars, i + j) for j in range(order + 1))))

    return F.get(F.transform(F.array(padded), each), F.lit(0))  # so that a text is taken apart once, not for each of its places


def log_ratios(counted: DataFrame, order: int) -> DataFrame:
    """gram, ratio (millionths) for each of the grams of counted (gram, a, b), which are order + 1 long; a, b: how often each class has it.

    Every order's table follows from the next higher one's, so it has each suffix that is asked for, if with counts of 0.
    """
    tables = [counted]
    for _ in range(order):
        tables.append(tables[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    low = None
    for table in reversed(tables):
        context = W.partitionBy(F.expr("left(gram, length(gram) - 1)"))
        sides = [F.struct(F.col(c).alias("n"), F.sum(c).over(context).alias("all"), F.sum((F.col(c) > 0).cast("long")).over(context).alias("kinds")).alias(c) for c in "ab"]
        table = table.select("gram", *sides)
        if low is None:
            table = table.withColumns({"pa": F.lit(1 / _ALL), "pb": F.lit(1 / _ALL)})
        else:
            table = table.join(low.withColumnRenamed("gram", "tail"), F.expr("substring(gram, 2)") == F.col("tail"))
        mixed = [F.when(F.col(c)["all"] > 0, (F.col(c)["n"] + F.col(c)["kinds"] * F.col(f"p{c}")) / (F.col(c)["all"] + F.col(c)["kinds"])).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in "ab"]
        low = table.select("gram", *mixed)
    return low.select("gram", F.round((F.ln("pa") - F.ln("pb")) * MILLION).cast("long").alias("ratio"))


def mark(bins: DataFrame) -> int:
    """The step from which on a text is allowed, from bins (step, a, b) of held-out texts, of which there are few thousand at most."""
    every, below = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    known = bins.groupBy("step").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sides = known.select("step", *(F.sum(c).over(every).alias(f"all_{c}") for c in "ab"), *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"less_{c}") for c in "ab"))
    told = sides.where("all_a > 0 and all_b > 0").select("step", F.expr("(all_a - less_a) * cast(all_b as double) + less_b * cast(all_a as double)").alias("right"))
    best = told.orderBy(F.col("right").desc(), F.abs("step"), "step").first()
    return best["step"] if best else 0


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """Columns id_col, host, path, rule, verdict, score (null where a rule fits): a row for each row of pages."""
    host, path, text = parts(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), text.alias("text"))
    rows = rows.withColumns(dict(zip(("rule", "says"), fitting(F.col("host"), F.col("path"), rules), strict=True)))
    held = F.substring(F.md5("text"), 1, 1).isin("0", "1", "2")
    texts = kept(rows.groupBy("text").agg(F.first("says").alias("says")).select("text", "says", held.alias("held"), F.monotonically_increasing_id().alias("of")))
    places = texts.select("of", "says", "held", F.explode(grams(F.col("text"), order)).alias("gram"))
    counts = [F.sum((~F.col("held") & F.col("says").eqNullSafe(says)).cast("long")).alias(c) for says, c in (("allow", "a"), ("block", "b"))]
    ratios = kept(log_ratios(kept(places.groupBy("gram").agg(*counts)), order))
    asked = places.where("says is null or held").select("of", "gram")
    scores = asked.join(ratios, "gram").groupBy("of").agg((F.sum("ratio") / F.count(F.lit(1)) / MILLION).alias("score"))
    judged = kept(texts.where("says is null or held").join(scores, "of").select("text", "says", "score", F.greatest(F.lit(-2048), F.least(F.lit(2047), F.floor(F.col("score") * STEPS))).alias("step")))
    bins = judged.where("says is not null").select("step", (F.col("says") == "allow").cast("long").alias("a"), (F.col("says") == "block").cast("long").alias("b"))
    least = mark(bins.union(bins.sparkSession.createDataFrame([(0, 0, 0)], bins.schema)))
    new = judged.where("says is null").select("text", F.when(F.col("step") >= least, "allow").otherwise("block").alias("verdict"), "score")
    told = rows.where("says is not null").withColumns({"verdict": F.col("says"), "score": F.lit(None).cast("double")})
    out = ["_id", "host", "path", "rule", "verdict", "score"]
    return told.select(out).union(rows.where("says is null").join(new, "text").select(out)).withColumnRenamed("_id", id_col)


def op13(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")


def _sql() -> str:
    """The same in SQL, with a table for each order."""
    fits = "\n".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{rest}') THEN {{'rule': '{text}', 'says': '{says}'}}"
        for says, text, n, rest in ((says, text, *text.split("/", 1)) for says, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
    )
    tables = f"""t{ORDER} AS (SELECT gram, sum(CASE WHEN NOT held AND says = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN NOT held AND says = 'block' THEN 1 ELSE 0 END) AS b FROM places GROUP BY 1),"""
    for j in range(ORDER - 1, -1, -1):
        tables += f"\nt{j} AS (SELECT substring(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM t{j + 1} GROUP BY 1),"
    for j in range(ORDER + 1):
        low = f"JOIN p{j - 1} l ON l.gram = substring(t.gram, 2)" if j else f"CROSS JOIN (SELECT 1 / {_ALL}::DOUBLE AS pa, 1 / {_ALL}::DOUBLE AS pb) l"
        mixed = ", ".join(f"CASE WHEN all_{c} > 0 THEN ({c} + kinds_{c} * p{c}) / (all_{c} + kinds_{c}) ELSE p{c} END AS p{c}" for c in "ab")
        sums = ", ".join(f"CAST({c} AS DOUBLE) AS {c}, CAST(sum({c}) OVER w AS DOUBLE) AS all_{c}, CAST(sum(CASE WHEN {c} > 0 THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS kinds_{c}" for c in "ab")
        tables += f"\np{j} AS (SELECT t.gram, {mixed} FROM (SELECT gram, {sums} FROM t{j} WINDOW w AS (PARTITION BY left(gram, length(gram) - 1))) t {low}),"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS more FROM u),
f AS (SELECT page_id, host, path, host || more AS text, CASE {fits} END AS fit FROM h),
texts AS (SELECT DISTINCT text, fit.says AS says, left(md5(text), 1) IN ('0', '1', '2') AS held FROM f),
padded AS (SELECT *, repeat(chr(2), {ORDER}) || text || chr(3) AS t FROM texts),
places AS (SELECT text, says, held, substring(t, i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(t) - {ORDER} + 1)) AS i FROM padded)),
{tables}
scores AS (SELECT text, says, CAST(sum(CAST(round((ln(pa) - ln(pb)) * {MILLION}) AS BIGINT)) AS DOUBLE) / count(*) / {MILLION} AS score FROM places JOIN p{ORDER} USING (gram) WHERE says IS NULL OR held GROUP BY 1, 2),
judged AS (SELECT text, says, greatest(-2048, least(2047, floor(score * {STEPS}))) AS step FROM scores),
bins AS (SELECT step, sum(CASE WHEN says = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN says = 'block' THEN 1 ELSE 0 END) AS b FROM (SELECT step, says FROM judged WHERE says IS NOT NULL UNION ALL SELECT 0, NULL) GROUP BY 1),
sides AS (SELECT step, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b, coalesce(sum(a) OVER w, 0) AS less_a, coalesce(sum(b) OVER w, 0) AS less_b FROM bins WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce((SELECT step FROM sides WHERE all_a > 0 AND all_b > 0 ORDER BY (all_a - less_a) * CAST(all_b AS DOUBLE) + less_b * CAST(all_a AS DOUBLE) DESC, abs(step), step LIMIT 1), 0) AS least)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.says, CASE WHEN step >= (SELECT least FROM best) THEN 'allow' ELSE 'block' END) AS verdict FROM f LEFT JOIN judged ON judged.text = f.text
"""


SQL = _sql()

"""Text of tickets, decoded sequences, and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.functions import decode as C
from orderweave.functions import text as X
from orderweave.operators import matching as M
from orderweave.operators.ranking import numbered
from orderweave.plans.base import DETS, TOKENS, query
from orderweave.sources.files import LineLogs
from orderweave.sources.sinks import event_messages
from orderweave.sources.tables import Tables, commands, natural_key
from orderweave.streaming.runner import finished, scratch


@query("normalize_text", r"SELECT conv_id, turn, replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), ' ', '') AS text FROM conversations")
def normalize_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.normalized(F.col("text")).alias("text"))


@query("order_number", "SELECT o_orderkey AS tray, coalesce(nullif(regexp_extract(trim(o_orderpriority || ' ' || o_orderkey), '[0-9]{3}$'), ''), '000') AS order_number FROM orders")
def order_number(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("tray"), F.coalesce(X.order_number(text), F.lit("000")).alias("order_number"))


@query("leading_qty", "SELECT DISTINCT CAST(l_quantity AS INTEGER) || ' ' || p_name AS text, TRY_CAST(nullif(regexp_extract(CAST(l_quantity AS INTEGER) || ' ' || p_name, '^([1-9][0-9]*).+', 1), '') AS INTEGER) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey")
def leading_qty(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    texts = rows.select(F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), "p_name").alias("text")).distinct()
    return texts.select("text", X.leading_number(F.col("text")).alias("quantity"))


@query("first_number", r"SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(text, '[1-9][0-9]*'), '') AS INTEGER) AS number FROM conversations")
def first_number(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.first_number(F.col("text")).alias("number"))


@query("digit_guard", "SELECT p_partkey AS pos, CASE WHEN regexp_matches(p_brand, '[1-9]') AND contains(p_brand, CAST(p_size AS VARCHAR)) THEN 1 ELSE p_size END AS quantity FROM part")
def digit_guard(t: Tables) -> DataFrame:
    """A number that is part of the item's name isn't its quantity."""
    part_of = F.col("p_brand").rlike("[1-9]") & F.contains("p_brand", F.col("p_size").cast("string"))
    return t.part.select(F.col("p_partkey").alias("pos"), F.when(part_of, 1).otherwise(F.col("p_size")).alias("quantity"))


_NOISY = "n AS (SELECT DISTINCT p_name AS name FROM part), x AS (SELECT name, left(name, length(name) - 1) || 'x' AS text FROM n)"


def _noisy(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.concat(F.expr("left(name, length(name) - 1)"), F.lit("x")).alias("text"))


@query("special_prefix_match", f"WITH {_NOISY}, k AS (SELECT length(name) AS len, left(name, 2) AS pre, count(*) AS c, min(name) AS sole FROM n GROUP BY 1, 2) SELECT text, CASE WHEN c = 1 THEN sole END AS matched, coalesce(c, 0) AS candidates FROM x LEFT JOIN k ON len = length(text) AND pre = left(text, 2)")
def special_prefix_match(t: Tables) -> DataFrame:
    """Candidates of the same length and first two characters: one alone is the match."""
    texts = _noisy(t)
    return M.by_prefix(texts.select("text"), texts.select("name"))


@query("fuzzy_best_part")
def fuzzy_best_part(t: Tables) -> DataFrame:
    """The most similar name above 40; SQL has no common subsequences, so tests hold it against a plain version."""
    texts = _noisy(t)
    menu = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return M.most_similar(texts.select("text"), menu).withColumn("score", F.round("score", 6))


@query("natural_order", "SELECT name, CAST(row_number() OVER (ORDER BY prefix, size, name) AS INTEGER) AS place FROM (SELECT DISTINCT p_type || p_size AS name, lower(p_type) AS prefix, p_size AS size FROM part)")
def natural_order(t: Tables) -> DataFrame:
    """File names in the order in which they are replayed."""
    names = t.part.select(F.concat("p_type", F.col("p_size").cast("string")).alias("name")).distinct()
    keyed = names.withColumn("key", natural_key(F.col("name")))
    return numbered(keyed, [F.col("key"), F.col("name")], "place").select("name", F.col("place").cast("int").alias("place"))


_COMMANDS = f"WITH {DETS} SELECT ts, cls AS cmd, CAST(tray AS VARCHAR) AS tray_id, cls AS type, score > 0.5 AS enable FROM dets WHERE cls <> 'error'"


def _feed(t: Tables) -> DataFrame:
    payload = F.to_json(F.struct(F.col("tray").cast("string").alias("tray_id"), F.col("cls").alias("type"), F.when(F.col("score") > 0.5, "True").otherwise("no").alias("enable")))
    return t.detections.select("ts", F.when(F.col("cls") == "error", F.lit("site/other")).otherwise(F.concat(F.lit("site/cmd/"), F.upper("cls"))).alias("topic"), payload.alias("payload"))


@query("command_feed", _COMMANDS)
def command_feed(t: Tables) -> DataFrame:
    return commands(_feed(t), "site")


@query("stream_command_log", _COMMANDS)
def stream_command_log(t: Tables) -> DataFrame:
    """The same commands, from logs that are read as streams of lines, whose offsets are bytes."""
    folder = scratch(t.spark)
    _feed(t).select(F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), "topic", "payload"))).write.text(f"{folder}/log")
    t.spark.dataSource.register(LineLogs)
    lines = t.spark.readStream.format("line_logs").option("path", f"{folder}/log").load()
    feed = lines.select(F.from_json("line", "ts timestamp_ntz, topic string, payload string").alias("m")).select("m.*")
    return finished(commands(feed, "site"))


@query("status_messages", "SELECT 'site/events' AS topic, CAST(json_object('tray', o_orderkey, 'status', o_orderstatus) AS VARCHAR) AS value FROM orders")
def status_messages(t: Tables) -> DataFrame:
    return event_messages(t.orders.select(F.col("o_orderkey").alias("tray"), F.col("o_orderstatus").alias("status")), "site", "events")


_ALPHABET = ["", "a", "b", "c", "d"]
_KEPT = f"{TOKENS}, k AS (SELECT crop, list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] <> 0 AND (i = 1 OR tokens[i - 1] <> tokens[i])) AS ix, tokens, best FROM toks)"


def _alphabet():
    return F.array(*(F.lit(c) for c in _ALPHABET))


@query("ctc_greedy", f"WITH {_KEPT} SELECT crop, array_to_string(list_transform(ix, lambda i: ['', 'a', 'b', 'c', 'd'][tokens[i] + 1]), '') AS text, round(coalesce(list_avg(list_transform(ix, lambda i: best[i])), 0), 6) AS score FROM k")
def ctc_greedy(t: Tables) -> DataFrame:
    k = t.tokens.select("crop", "best", C.collapsed(F.col("tokens")).alias("k"))
    return k.select("crop", C.decoded(F.col("k"), _alphabet()).alias("text"), F.round(C.confidence(F.col("k"), F.col("best")), 6).alias("score"))


@query("ctc_remapped", f"WITH {TOKENS}, m AS (SELECT crop, tokens, list_transform(tokens, lambda x: CASE x WHEN 3 THEN 1 ELSE x END) AS mapped FROM toks), k AS (SELECT crop, mapped, list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] <> 0 AND (i = 1 OR mapped[i - 1] <> tokens[i])) AS ix FROM m) SELECT crop, array_to_string(list_transform(ix, lambda i: ['', 'a', 'b', 'c', 'd'][mapped[i] + 1]), '') AS text FROM k")
def ctc_remapped(t: Tables) -> DataFrame:
    """Tokens that look alike are one; a repeat of a remapped token stays."""
    remap = F.create_map(F.lit(3), F.lit(1))
    return t.tokens.select("crop", C.decoded(C.collapsed(F.col("tokens"), remap=remap, strict=False), _alphabet()).alias("text"))


@query("digit_decode", f"WITH {TOKENS}, s AS (SELECT crop, list_transform(range(0, 16), lambda g: v[4 * g + 1 : 4 * g + 4]) AS steps FROM toks), p AS (SELECT crop, list_transform(steps, lambda x: list_position(x, list_max(x)) - 1) AS a FROM s) SELECT crop, array_to_string(list_transform(list_filter(range(1, 17), lambda i: a[i] <> 0 AND (i = 1 OR a[i - 1] <> a[i])), lambda i: CAST(a[i] AS VARCHAR)), '') AS digits FROM p")
def digit_decode(t: Tables) -> DataFrame:
    """Steps of four scores, blank and three digits: the best of each step, collapsed."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: C.argmax(F.slice("v", 4 * g + 1, 4)))
    return t.tokens.select("crop", C.decoded(C.collapsed(steps), F.array(*(F.lit(str(i)) for i in range(4)))).alias("digits"))


@query("argmax_class", f"WITH {TOKENS} SELECT crop, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS cls, round(list_max(v), 6) AS score FROM toks")
def argmax_class(t: Tables) -> DataFrame:
    return t.tokens.select("crop", C.argmax(F.col("v")).alias("cls"), F.round(F.array_max("v"), 6).alias("score"))


@query("dhash_bits", f"WITH {TOKENS} SELECT crop, array_to_string(list_transform(range(2, len(v) + 1), lambda i: CASE WHEN v[i] > v[i - 1] THEN '1' ELSE '0' END), '') AS bits FROM toks")
def dhash_bits(t: Tables) -> DataFrame:
    return t.tokens.select("crop", C.difference_bits(F.col("v")).alias("bits"))


_HAMMING = f"""WITH {TOKENS} SELECT a.crop, b.crop AS next,
  CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(range(1, greatest(len(a.v), len(b.v))), lambda i: CASE WHEN coalesce(a.v[i + 1] > a.v[i], false) <> coalesce(b.v[i + 1] > b.v[i], false) THEN 1 ELSE 0 END)), 0) AS INTEGER) END AS distance
FROM toks a JOIN toks b ON b.crop = a.crop + 1"""


@query("hamming_pairs", _HAMMING)
@query("hamming_whole", _HAMMING)
def hamming_whole(t: Tables) -> DataFrame:
    """Differences between the whole hashes, a bit for each pair of neighbours, of crops that follow each other."""
    h = t.tokens.select("crop", C.difference_words(F.col("v")).alias("h"))
    return h.join(h.select((F.col("crop") - 1).alias("crop"), F.col("crop").alias("next"), F.col("h").alias("g")), "crop").select("crop", "next", C.hamming_words(F.col("h"), F.col("g")).alias("distance"))

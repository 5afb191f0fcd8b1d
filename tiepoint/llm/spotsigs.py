"""SpotSigs document fingerprints, in DataFrame functions only.

A signature is an anchor (a common word) with the chain of content words that follows
it. A document's fingerprint is its set of signature numbers. Sets are compared by
Jaccard similarity; sets of too different lengths cannot be alike and are pruned
before any signature is looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiepoint.llm.common import connected_components, materialise

#: Common words that anchor chains (English, French, German, Spanish).
ANCHORS = (
    "the of and to in a is that for it with as was on are by be this from at or an "
    "le la les de des du un une et est que qui dans pour par sur au aux en avec pas "
    "der die das und den von zu mit sich auf für im dem nicht ein eine ist "
    "el los las y del con no una por se su para al lo"
).split()
#: Content words of a chain, and the words after the anchor among which they are sought.
CHAIN, REACH = 2, 8
SIMILARITY = 0.8
SEPARATOR = r"[^\p{L}\p{N}]+"
_NO_ID = -(1 << 63)


def _number(text: Column) -> Column:
    """60 bits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fingerprint(text: Column) -> Column:
    """The sorted set of a text's signature numbers.

    Null and empty texts have the empty set. A text without chains is taken by its
    words, one without words as a whole, so that different texts differ.
    """
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        content = F.transform(words, lambda w: F.when(~w.isin(ANCHORS), w))

        def of_content(marked: Column) -> Column:
            anchors = F.filter(F.transform(words, lambda w, i: F.when(F.get(marked, i).isNull(), i)), lambda i: i.isNotNull())
            chains = F.transform(anchors, lambda i: F.concat_ws(" ", F.get(words, i), F.slice(F.array_compact(F.slice(marked, i + 2, REACH)), 1, CHAIN)))
            return F.filter(chains, lambda c: F.instr(c, " ") > 0)

        return _let(content, of_content)

    words = F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")

    def numbered(pair: Column) -> Column:
        chains, words = pair["chains"], pair["words"]
        whole = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(chains) > 0, chains).when(F.size(words) > 0, words).otherwise(whole)

    found = _let(words, lambda ws: F.struct(of_words(ws).alias("chains"), ws.alias("words")))
    return F.array_sort(F.array_distinct(F.transform(_let(found, numbered), _number)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike, an empty and another are pruned."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def as_text(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), " ")


def length_partition(length: Column, similarity: float = SIMILARITY) -> Column:
    """Sets whose lengths' ratio is at least ``similarity`` lie in the same partition or in neighbouring ones."""
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / -math.log(similarity)).cast("int")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id``: the smallest id reachable over pairs of fingerprints at least ``similarity`` alike.

    Equal fingerprints are one class. The others are partitioned by set length and
    meet where they share one of their rarest signatures, of which two alike sets must
    share one; a pair is compared by Jaccard only if what is left of both sets there, in
    the order of rarity, can make them alike. Sets of a frequent chain and a tenth of
    chains of their own so never meet at it. Null texts are empty ones and all of one
    class; repeated rows come out as often as they occur. A null id is no class's smallest; a
    class of null ids alone has a null ``class_id``. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("sigs"))
    rows = materialise(rows.withColumn("fp", F.xxhash64("sigs")))
    sets = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("sigs").alias("sigs")))
    each = sets.select("fp", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("fp").orderBy("df", "sig")
    prefix = each.join(common, "sig").withColumn("at", F.row_number().over(rarest)).where(F.col("at") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n")) + 1)
    left = F.col("n") - F.col("at") + 1
    entered = prefix.select("fp", "n", left.alias("left"), "sig", length_partition(F.col("n"), similarity).alias("part"))
    near = F.explode(F.array(F.col("part"), F.col("part") + 1))
    a = entered.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), "sig", near.alias("part"))
    b = entered.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), "sig", "part")
    bound = F.least("la", "lb") >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = a.join(b, ["part", "sig"]).where((F.col("a") != F.col("b")) & bound).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (sets.select(F.col("fp").alias(x), F.col("sigs").alias(f"s{x}")) for x in "ab")
    alike = pairs.join(left, "a").join(right, "b").where(likeness(F.col("sa"), F.col("sb")) >= similarity)
    roots = connected_components(alike.select("a", "b")).withColumnRenamed("node", "fp")
    rooted = sets.select("fp", "first_id").join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return rows.select("doc_id", "fp").join(rooted.select("fp", "root").join(smallest, "root"), "fp").select("doc_id", "class_id")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, with their likeness.

    The next document is that of the next smaller id, after the smallest the largest.
    The edited text has its last half replaced by the start of the next document's.
    Rows of equal id follow in the order of their texts' hashes; rows without id come
    last, in that order too, and rows equal in both one after the other. A null text
    counts as empty; an empty table stays empty. Only ids and hashes are put in order;
    texts are dealt by them, and each row then meets one text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ids = rows.select("key", "tie", F.length("text").alias("n_chars"), F.monotonically_increasing_id().alias("row"))
    order = (F.desc("key"), F.asc("tie"), F.asc("row"))
    ordered = materialise(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order)
    here = F.struct("key", "tie")
    following = ordered.withColumn("next", F.lead(here).over(within))
    firsts = ordered.groupBy("part").agg(F.max_by(here, F.struct("key", -F.col("tie").cast("decimal(20,0)"), -F.col("row"))).alias("first"))
    in_turn = Window.orderBy("part")  # one row per range
    over_all = in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = firsts.withColumn("after", F.coalesce(F.lead("first").over(in_turn), F.first("first").over(over_all))).select("part", "after")
    following = following.join(F.broadcast(borders), "part").select("key", "tie", "n_chars", F.coalesce("next", "after").alias("next"))
    following = following.select(F.col("key").alias("own_key"), F.col("tie").alias("own_tie"), F.col("n_chars").alias("own_chars"), F.col("next.key").alias("key"), F.col("next.tie").alias("tie"))

    texts = rows
    if not ordered.groupBy("key", "tie").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["key", "tie"])  # rows equal in id and text share one text
    half = F.floor(F.col("own_chars") / 2).cast("int")
    heads = following.join(texts, ["key", "tie"])
    heads = heads.select(F.col("own_key").alias("key"), F.col("own_tie").alias("tie"), F.col("text").substr(F.lit(1), half).alias("head"), fingerprint(F.col("text")).alias("next_sigs"))
    n = F.length("text")
    both = heads.join(texts, ["key", "tie"])
    both = both.select("key", n.cast("long").alias("n_chars"), "text", F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head")).alias("edited"), "next_sigs")
    found = both.select("key", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("sigs"), fingerprint(F.col("edited")).alias("edited_sigs"), "next_sigs")
    return found.select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def edited_likeness_sql() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    anchors = "[" + ", ".join(f"'{w}'" for w in ANCHORS) + "]"

    def sigs(text: str) -> str:
        words = f"list_filter(regexp_split_to_array(lower({text}), '{SEPARATOR}'), lambda w: w <> '')"
        return f"""(SELECT list_sort(list_distinct(list_transform(CASE WHEN len(chains) > 0 THEN chains WHEN len(words) > 0 THEN words WHEN {text} <> '' THEN [{text}] ELSE []::VARCHAR[] END,
            lambda c: ('0x' || md5(c)[1:15])::BIGINT)))
          FROM (SELECT words, list_filter(list_transform(list_filter(range(1, len(words) + 1), lambda i: list_contains({anchors}, words[i])),
            lambda i: concat_ws(' ', words[i], array_to_string(list_filter(words[i + 1:i + {REACH}], lambda w: NOT list_contains({anchors}, w))[1:{CHAIN}], ' '))), lambda c: c[-1:] <> ' ') AS chains
          FROM (SELECT {words} AS words)))"""

    alike = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    nexts AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
    edits AS (SELECT *, text[1:n - n // 2] || following[1:n // 2] AS edited FROM nexts),
    sets AS (SELECT doc_id, n, edited, {sigs("text")} AS a, {sigs("edited")} AS b, {sigs("following")} AS c FROM edits)
    SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, ' ') AS fingerprint, array_to_string(b, ' ') AS edited_fingerprint,
      {alike("a", "b")} AS near_edited, {alike("a", "c")} AS near_next
    FROM sets"""

"""Line deduplication by a log-template tree of fixed depth (native).

A line descends by its number of tokens and by its leading tokens (tokens with a digit count as a
variable field) to a leaf. In a leaf, the commonest token of each place forms a template; lines that
agree with it in at least `similarity` of their places belong to it, places where they differ are
variable fields. The lines it leaves vote again, so a leaf holds as many templates as recur in it;
where a vote mixes several templates and takes no `min_docs` documents, the lines are parted by the
commonest token of their most voted differing place and each part votes for itself. Any other line
is a template of its own. Lines of templates that occur in at least `min_docs` documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import joined, read, stored

DEPTH, SIMILARITY, MIN_DOCS = 3, 0.7, 10
SPACE = r"[\x20\x09\x0B-\x0D]+"
#: A token with a digit; possessive, so that long tokens are read once.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A row's key is its id and text: repeated rows share it and their fate."""
    return docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text)))


def _named(*parts: Column | str) -> Column:
    """A name of 128 bits: two hashes of 64."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def _lines(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """__key, place, masked (variable fields as <*>), leaf and line (their names), for lines with a token.

    A step that changes few lines is taken only where a cheap look says so, and every step is a
    projection of its own: no line is read twice."""
    lines = docs.select("__key", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("place", "line")).filter(F.col("line").rlike(r"[^\x20\x09\x0B-\x0D]"))
    odd = [F.contains("line", F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")]
    single = F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.regexp_replace("line", SPACE, " ")).otherwise(F.col("line"))
    plain = lines.select("__key", "place", F.trim(single).alias("plain"))
    masked = plain.select("__key", "place", F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", VARIABLE, "<*>")).otherwise(F.col("plain")).alias("masked"))
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    leaf = _named(tokens, F.substring_index("masked", " ", depth))
    return masked.select("__key", "place", "masked", leaf.alias("leaf"), _named("masked").alias("line"))


def _members(lines: DataFrame, similarity: float, min_docs: int) -> DataFrame:
    """(line, template) of the lines that templates take; lines has group (at first the leaf), line,
    docs and tokens.

    Rounds end when no group is left that could hold a template of min_docs documents: for one, the
    votes of the commonest tokens, min_docs at most in each place, must reach the agreement of
    min_docs documents. That holds for parts of a group too, so nothing is left out by it.
    """
    found, rounds = [], 0
    while rounds == 0 or not lines.isEmpty():
        # Votes are summed up on the map side first, so a place of a hot leaf is no hot key.
        votes = lines.select("group", "docs", F.posexplode("tokens").alias("at", "token")).groupBy("group", "at", "token").agg(F.sum("docs").alias("votes"))
        top = votes.groupBy("group", "at").agg(F.max(F.struct("votes", "token")).alias("top"), F.sum("votes").alias("all"))
        # The place to split at: the most voted one of those where lines differ.
        differing = F.when(F.col("top.votes") < F.col("all"), F.struct("top.votes", (-F.col("at")).alias("at")))
        template = top.groupBy("group").agg(
            F.array_sort(F.collect_list(F.struct("at", "top.token"))).alias("common"), F.sum(F.least("top.votes", F.lit(min_docs))).alias("support"), F.max(differing).alias("split")
        )
        able = F.col("support") >= similarity * F.size("common") * min_docs - 1e-6
        template = stored(template.filter(able).select("group", F.col("common.token").alias("common"), (-F.col("split.at")).alias("split")), "templates")
        same = F.aggregate(F.zip_with("tokens", "common", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
        side = F.get("tokens", F.col("split")) == F.get("common", F.col("split"))
        shares = stored(joined(lines, template, "group").select("group", "line", "docs", "tokens", (same / F.size("tokens")).alias("share"), side.alias("side")), "shares")
        taking = shares.filter(F.col("share") >= similarity).groupBy("group").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("group", F.lit(True).alias("takes"))
        taking = stored(taking, "taking")
        placed = joined(shares, taking, "group", "left").withColumn("member", F.coalesce(F.col("takes") & (F.col("share") >= similarity), F.lit(False)))
        found.append(stored(placed.filter("member").select("line", F.struct("group", F.lit(rounds).alias("round")).alias("template")), "members"))
        parted = _named("group.a", "group.b", "side")
        left = placed.filter("not member").select("line", "docs", "tokens", F.when(F.col("takes"), F.col("group")).otherwise(parted).alias("group"))
        enough = stored(left.groupBy("group").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("group"), "enough")
        lines = stored(joined(left, enough, "group", "left_semi"), "left")
        rounds += 1
    member = found[0]
    for more in found[1:]:
        member = member.unionByName(more)
    return stored(member, "members") if rounds > 1 else member


def recurring_lines(docs: DataFrame, text: str, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__key, place) of the lines to drop; docs must have __key."""
    lines = stored(_lines(docs, text, depth), "lines")
    # A document counts once for a line, however often it holds it.
    seen = lines.groupBy("line", "leaf", "__key").agg(F.lit(1).alias("one"))
    by_line = stored(seen.groupBy("line", "leaf").agg(F.count("*").alias("docs")), "by_line")

    # Leaves where lines differ and which can reach min_docs at all; in others a line stands for itself.
    leaves = by_line.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")).filter((F.col("lines") > 1) & (F.col("docs") >= min_docs)).select("leaf")
    leaves = stored(leaves, "leaves")
    held = stored(joined(by_line, leaves, "leaf", "left_semi"), "held")
    # The texts of the lines there come from the first pass over the documents.
    texts = joined(lines.select("line", "leaf", "masked"), leaves, "leaf", "left_semi").groupBy("line").agg(F.first("masked").alias("masked"))
    tokens = texts.join(held, "line").select(F.col("leaf").alias("group"), "line", "docs", F.split("masked", " ").alias("tokens"))
    member = _members(stored(tokens, "tokens"), similarity, min_docs)

    alone = by_line.filter(F.col("docs") >= min_docs).join(member, "line", "left_anti").select("line")
    # Documents of a template are counted once, whichever of its lines they hold.
    several = joined(lines.select("line", "__key"), member, "line").groupBy("template", "__key").agg(F.lit(1).alias("one")).groupBy("template").count().filter(F.col("count") >= min_docs)
    together = member.join(several, "template", "left_semi").select("line")
    gone = stored(alone.unionByName(together), "gone")
    return joined(lines.select("__key", "place", "line"), gone, "line", "left_semi").select("__key", "place")


def drop_recurring_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **tree) -> DataFrame:
    """Adds clean_text, n_lines and n_dropped.

    Lines end at a line feed. Lines without a token are kept, and so are all lines of null texts
    (clean_text null, no lines) and empty texts (one empty line). Repeated rows count as one
    document. Other columns stay; columns of the added names are replaced.
    """
    added = ("clean_text", "n_lines", "n_dropped")
    kept = [c for c in docs.columns if c not in added]
    keyed = _keyed(docs.select(*kept), text, doc_id)
    dropped = recurring_lines(_keyed(docs.select(doc_id, text), text, doc_id).select("__key", text), text, **tree)
    dropped = stored(dropped.groupBy("__key").agg(F.collect_set("place").alias("__places")), "dropped")
    lines = F.split(F.col(text), "\n")
    left = F.expr("array_except(sequence(0, size(__lines) - 1), __places)")
    clean = F.when(F.col("__places").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    return joined(keyed, dropped, "__key", "left").withColumn("__lines", lines).select(
        *kept,
        clean.alias("clean_text"),
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("__places").isNull(), 0).otherwise(F.size("__places")).cast("bigint").alias("n_dropped"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_lines, n_dropped and the digest of the text without its
    recurring lines (null: that of the empty text)."""
    cleaned = drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d WHERE text IS NOT NULL),
plain AS (SELECT r, place, line, trim(regexp_replace(line, '{SPACE}', ' ', 'g'), ' ') AS plain FROM raw),
masked AS (SELECT r, place, list_transform(string_split(plain, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM plain WHERE plain <> ''),
keyed AS (SELECT m.*, array_to_string(tokens, ' ') AS line, len(tokens) || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf, doc_id, text FROM masked m JOIN d USING (r)),
by_line AS (SELECT line, leaf, any_value(tokens) AS tokens, count(DISTINCT (doc_id, text)) AS docs FROM keyed GROUP BY line, leaf),
leaves AS (SELECT leaf FROM by_line GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCS}),
tok AS (SELECT leaf, line, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM by_line JOIN leaves USING (leaf)),
votes AS (SELECT leaf, pos, token, sum(docs) AS votes FROM tok GROUP BY ALL),
template AS (SELECT leaf, pos, token AS common FROM votes QUALIFY row_number() OVER (PARTITION BY leaf, pos ORDER BY votes DESC, token DESC) = 1),
members AS (SELECT line FROM tok JOIN template USING (leaf, pos) GROUP BY line HAVING avg(CASE WHEN token = common THEN 1 ELSE 0 END) >= {SIMILARITY}),
several AS (SELECT leaf FROM keyed WHERE line IN (SELECT line FROM members) GROUP BY leaf HAVING count(DISTINCT (doc_id, text)) >= {MIN_DOCS}),
gone AS (SELECT line FROM by_line WHERE line NOT IN (SELECT line FROM members) AND docs >= {MIN_DOCS}
         UNION SELECT line FROM by_line WHERE line IN (SELECT line FROM members) AND leaf IN (SELECT leaf FROM several)),
flag AS (SELECT DISTINCT r, place FROM keyed WHERE line IN (SELECT line FROM gone)),
kept AS (SELECT raw.r, count(*) AS n_lines, count(flag.place) AS n_dropped, string_agg(CASE WHEN flag.place IS NULL THEN raw.line END, chr(10) ORDER BY raw.place) AS clean
         FROM raw LEFT JOIN flag ON raw.r = flag.r AND raw.place = flag.place GROUP BY raw.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(clean, '')) AS clean_sha256 FROM d LEFT JOIN kept USING (r)
"""
